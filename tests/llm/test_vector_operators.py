"""The embedding operators against brute force, with nulls, ties, repeats, empty tables and clashing names."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import covertree, forest, whitening
from weftline.llm import vectors as vector_columns

SCHEMA = "vec_id long, embedding array<float>, label int, nid long, leaf long, code string, n long"
G = np.random.default_rng(11)
BAD = [None, [float("nan")] + [0.0] * 15, [float("inf")] + [0.0] * 15, [None] + [1.0] * 15]


def frame(spark, vectors, ids=None, labels=None):
    """Vectors with extra columns whose names the operators use themselves."""
    rows = [(int(i) if i is not None else None, None if v is None else [None if x is None else float(x) for x in v], label, 1, 2, "x", 3) for i, v, label in zip(ids if ids is not None else range(len(vectors)), vectors, labels if labels is not None else [0] * len(vectors))]
    return spark.createDataFrame(rows, SCHEMA)


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def lloyd(rows, parts, size, rounds):
    """Plain Lloyd rounds over ``(id, vector, label)``, every part with every entry."""
    kept = sorted([r for r in rows if good(r[1])], key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.floor(256 * np.array([np.float32(r[1]) for r in kept], float)).astype(int)
    w = x.shape[1] // parts
    books = [x[:size, p * w : (p + 1) * w].copy() for p in range(parts)]
    for turn in range(rounds + 1):
        code, error = np.zeros((len(x), parts), int), np.zeros(len(x), int)
        for p in range(parts):
            own = x[:, p * w : (p + 1) * w]
            for i, v in enumerate(own):
                d = ((books[p] - v) ** 2).sum(axis=1)
                code[i, p] = int(np.argmin(d))
                error[i] += d.min()
            if turn < rounds:
                books[p] = np.array([own[code[:, p] == e].sum(axis=0) // max(1, (code[:, p] == e).sum()) if (code[:, p] == e).any() else b for e, b in enumerate(books[p])])
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1)).encode()).hexdigest()
    return [(r[0], "".join(f"{c:02x}" for c in code[i]), int(error[i]), sum(int(error[k]) for k, q in enumerate(kept) if q[2] == r[2]), digest) for i, r in enumerate(kept)]


def test_codes_against_plain_lloyd(spark):
    vectors = [list(v) for v in G.normal(size=(260, 32)) / 3] + [[0.25] * 32] * 40 + BAD
    ids = [int(i) for i in G.permutation(len(vectors) - 1)] + [None]
    labels = [None if i % 7 == 0 else i % 3 for i in range(len(vectors))]
    got = covertree.result(frame(spark, vectors, ids, labels).repartition(3)).collect()
    want = lloyd(list(zip(ids, vectors, labels)), 16, 64, 2)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_codes_of_repeated_and_null_ids_and_ties(spark):
    """Equal first vectors: the higher of equal entries is unused and stays."""
    vectors = [[0.5] * 16] * 3 + [[x / 8] * 16 for x in range(-6, 7)]
    ids = [1, 1, None, *range(2, 15)]
    got = covertree.result(frame(spark, vectors, ids)).collect()
    want = lloyd([(i, v, 0) for i, v in zip(ids, vectors)], 16, 64, 2)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert len({r.code for r in got if r.vec_id in (1, None)}) == 1


def test_codes_of_nothing_and_of_odd_lengths(spark):
    assert covertree.result(frame(spark, [])).collect() == []
    assert covertree.result(frame(spark, BAD)).collect() == []
    with pytest.raises(ValueError):
        covertree.result(frame(spark, [[1.0] * 15]))


def test_cover_trees_hold_every_point_once():
    for points in (G.integers(-50, 50, (3000, 4)), np.repeat(G.integers(-9, 9, (5, 4)), 200, axis=0), np.zeros((1, 4), int), np.zeros((0, 4), int)):
        order, nodes = covertree.cover_tree(points)
        assert sorted(order.tolist()) == list(range(len(points)))
        for node in nodes:
            own = points[order[node["start"] : node["end"]]]
            d = np.sqrt(((own - points[node["centre"]]) ** 2).sum(axis=1))
            assert d.max() <= node["radius"] + 1e-9
            kids = nodes[node["child"] : node["last"]]
            if len(kids):
                assert kids["start"][0] == node["start"] and kids["end"][-1] == node["end"] and (kids["start"][1:] == kids["end"][:-1]).all()
                between = np.sqrt(((points[kids["centre"]][:, None] - points[kids["centre"]][None]) ** 2).sum(axis=2))
                assert (between[np.triu_indices(len(kids), 1)] > node["radius"] / 2).all()
        book = G.integers(-50, 50, (20, 4))
        book[7] = book[3]
        code, error = covertree.block_codes(points, order, nodes, book)
        best, d2 = covertree.nearest(points, book)
        assert (code == best).all() and (error == d2.min(axis=1)).all()
        sums, counts = covertree.block_totals(points, order, nodes, book)
        assert counts.sum() == len(points) and all((sums[e] == points[best == e].sum(axis=0)).all() for e in range(20))


def test_whole_subtrees_are_assigned_without_their_points():
    points = np.concatenate([G.integers(-5, 5, (2000, 4)), G.integers(-5, 5, (2000, 4)) + 1000])
    order, nodes = covertree.cover_tree(points)
    start, end, _ = covertree.assigned(points, order, nodes, np.array([[0] * 4, [1000] * 4]))
    assert len(start) <= 4 and (end - start).sum() == 4000


def spectrum(vectors):
    """``(x, values, vectors)`` of the covariance of whole-number vectors, by numpy's solver on exactly centred rows."""
    x = np.floor(64 * np.array([np.float32(v) for v in vectors], float)).astype(np.int64) + 1_000_000
    y = (x * len(x) - x.sum(axis=0)) / len(x)
    values, q = np.linalg.eigh(y.T @ y / len(x))
    return x, y, values[::-1], q[:, ::-1]


def test_whitening_against_numpy(spark):
    vectors = [list(v) for v in G.normal(size=(700, 40)) * np.geomspace(3, 0.2, 40)] + [[9.0] * 40] * 20 + [[0.5] * 40]
    bad = [None, [None] * 40, [float("nan")] * 40]
    ids = [*range(len(vectors) - 1), None, 1, 2, 3]
    got = whitening.result(frame(spark, vectors + bad, ids).repartition(5)).toPandas()
    x, y, values, q = spectrum(vectors)
    n = len(x)
    assert len(got) == n * 32 and set(got.n) == {n} and sorted(got.component.unique()) == list(range(1, 33))
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    deviation = {i: sum((int(n * a) - int(s)) ** 2 for a, s in zip(row, x.sum(axis=0))) for i, row in zip(ids, x)}
    for c in range(1, 33):
        own = got[got.component == c]
        assert np.allclose(own.explained, values[c - 1] / values.sum(), rtol=1e-10)
        white = y @ q[:, c - 1] / np.sqrt(values[c - 1])
        found = {None if i != i else int(i): w for i, w in zip(own.vec_id, own.whitened)}
        want = {i: w for i, w in zip(ids, white)}
        sign = np.sign(found[5] * want[5])
        assert all(abs(found[i] - sign * want[i]) < 1e-8 for i in want)
    assert all(deviation[None if r.vec_id != r.vec_id else int(r.vec_id)] == r.deviation for r in got[got.component == 1].itertuples())


def test_whitening_of_few_and_of_equal_rows(spark):
    assert whitening.result(frame(spark, [])).collect() == []
    assert whitening.result(frame(spark, BAD)).collect() == []
    one = whitening.result(frame(spark, [[0.5, 1.0]])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    flat = whitening.result(frame(spark, [[0.5, 1.0], [0.5, 2.0], [0.5, 2.0]])).collect()
    by = {(r.vec_id, r.component): r for r in flat}
    assert by[0, 2].whitened is None and abs(by[0, 1].explained - 1) < 1e-12 and abs(abs(by[0, 1].whitened) - math.sqrt(2)) < 1e-12 and by[0, 1].identity_error < 1e-12


@pytest.mark.parametrize("kind", ["normal", "graded", "short", "equal", "clusters", "zero", "repeated"])
def test_bidiagonal_solver(kind):
    rot = np.linalg.qr(G.normal(size=(300, 48)))[0]
    a = {
        "normal": G.normal(size=(300, 48)), "graded": G.normal(size=(300, 48)) * np.geomspace(1, 1e-7, 48), "short": G.normal(size=(9, 48)), "equal": rot,
        "clusters": rot @ np.diag([5.0] * 10 + [2.0] * 20 + [1e-3] * 18), "zero": np.zeros((4, 48)), "repeated": np.concatenate([G.normal(size=(90, 24))] * 2, axis=1),
    }[kind]
    values, z = whitening.eigen(whitening.stacked([a[:100], a[100:]] if len(a) > 100 else [a], 48))
    want = np.zeros(48)
    s = np.linalg.svd(a, compute_uv=False)
    want[: len(s)] = s**2
    assert np.abs(values - want).max() <= 1e-13 * max(want[0], 1)
    assert np.abs(z.T @ z - np.eye(48)).max() < 1e-11
    assert np.abs(a.T @ (a @ z) - z * values).max() <= 1e-13 * max(want[0], 1)
    if kind == "graded":
        assert np.abs(values / want - 1).max() < 1e-12  # small values keep their digits


def test_triangles_and_moments_merge_over_many_partitions(spark, monkeypatch):
    vectors = [list(v) for v in G.normal(size=(300, 16))]
    rows = frame(spark, vectors).select("vec_id", vector_columns.entries().alias("embedding"))
    monkeypatch.setattr(whitening, "FAN", 3)
    n, sums = whitening.exact_sums(rows, 16)
    fit = whitening.fitted(rows.repartition(20), 16)
    x, _, values, _ = spectrum(vectors)
    assert (n, sums) == (300, x.sum(axis=0).tolist()) and np.allclose(fit.e, values, rtol=1e-10)
    assert whitening.identity_error(rows.repartition(20), 16, fit) < 1e-10


def test_exact_deviations_beyond_64_bits():
    y = whitening.times_n_less_sums(np.array([[1 << 40, 5]]), 1 << 30, [0, 0])
    assert y.tolist() == [[1 << 70, 5 << 30]] and whitening.squares(y) == [None]
    assert whitening.squares(np.array([[3, -4]])) == [25]


def unit(a):
    return a / np.linalg.norm(a, axis=1)[:, None]


def linked(vectors, limit=0.9):
    """``(links, smallest row reached)`` by all cosines."""
    x = unit(np.array([np.float32(v) for v in vectors], float))
    c = x @ x.T >= limit
    np.fill_diagonal(c, False)
    label = np.arange(len(c))
    while True:
        new = np.array([min([label[i], *label[np.flatnonzero(c[i])]]) for i in range(len(c))])
        if (new == label).all():
            return c.sum(axis=1), label
        label = new


def clouds():
    base = unit(G.normal(size=(260, 64)))
    return np.concatenate([
        base, unit(base[:1] + 0.22 * unit(G.normal(size=(150, 64)))), unit(base[1:2] + 0.3 * unit(G.normal(size=(90, 64)))),
        unit(base[60:160] + G.uniform(0.05, 0.4, (100, 1)) * unit(G.normal(size=(100, 64)))), np.repeat(base[3:4], 30, axis=0), 7 * base[4:5],
        unit(base[:1] + np.linspace(0.2, 0.6, 40)[:, None] * unit(G.normal(size=(40, 64)))),
    ])


@pytest.mark.parametrize("leaf, least", [(512, 256), (64, 10_000), (64, 30)])
def test_links_against_all_cosines(spark, leaf, least):
    """In one leaf (exact), in many, and with balls whose borders other vectors cross."""
    vectors = clouds()
    ids = G.permutation(len(vectors))
    vectors = vectors[np.argsort(ids)]
    got = forest.near_duplicates(frame(spark, vectors.tolist()).repartition(3), leaf=leaf, least=least).toPandas().set_index("vec_id").sort_index()
    n, label = linked(vectors)
    assert len(got) == len(vectors) and (got.n_links.to_numpy() <= n).all()
    assert got.n_links.sum() >= (1.0 if leaf == 512 else 0.999) * n.sum()
    assert (got.component_id.to_numpy() == label).mean() >= 0.999 and (got.kept == (got.index == got.component_id)).all()
    hot = forest.balls(frame(spark, vectors.tolist()).select(F.col("vec_id").alias("nid"), vector_columns.entries().alias("v")), 64, leaf, 0.9, least)
    assert (hot is not None) == (least == 30)


def test_links_without_rows_or_numbers(spark):
    assert forest.result(frame(spark, [])).collect() == []
    rows = [*BAD, [0.0] * 16, [1.0] + [0.0] * 15, [1.0] + [0.0] * 15, [1.0], []]
    ids = [0, 1, 2, 3, 4, 5, 5, 6, None]
    got = sorted(map(tuple, forest.result(frame(spark, rows, ids)).collect()), key=str)
    alone = [(i, 0, i, True) for i in (0, 1, 2, 3, 4, None)]
    assert got == sorted([*alone, (5, 2, 5, True), (5, 2, 5, True), (6, 2, 5, False)], key=str)


def test_links_of_null_ids_and_of_repeated_ids(spark):
    """One id may stand for different vectors; a null id counts for no component."""
    a, b = [1.0] + [0.0] * 15, [0.0, 1.0] + [0.0] * 14
    near = [1.0, 0.1] + [0.0] * 14
    got = sorted(map(tuple, forest.result(frame(spark, [a, b, near, b, [0.0] * 15 + [1.0]], [7, 7, 3, None, None])).collect()), key=str)
    assert got == sorted([(7, 1, 3, False), (7, 1, 7, True), (3, 1, 3, True), (None, 1, 7, False), (None, 0, None, True)], key=str)


def test_lengths_of_any_size(spark):
    """Cosines of vectors near the ends of the range of doubles."""
    schema = "vec_id long, embedding array<double>"
    rows = [(0, [1e300, 1e300]), (1, [1e-300, 1.1e-300]), (2, [-1e300, 1e300])]
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in forest.result(spark.createDataFrame(rows, schema)).collect()) == [(0, 1, 0), (1, 1, 0), (2, 0, 2)]


def test_trees_keep_every_row_and_split_again(spark, monkeypatch):
    monkeypatch.setattr(forest, "SAMPLE", 100)
    vectors = unit(G.normal(size=(900, 8)))
    nodes = frame(spark, vectors.tolist()).select(F.col("vec_id").alias("nid"), vector_columns.entries().alias("v"))
    got = forest.grown(nodes, 8, 3, 0.05, 5, leaf=20).toPandas()
    assert set(got.leaf // 2**forest.PATH) == {0, 1, 2} and not got.tight.any() and got.groupby("leaf").size().max() <= 20
    assert all(set(own.nid) == set(range(900)) for _, own in got.groupby(got.leaf // 2**forest.PATH))


def test_a_pair_is_counted_in_its_first_leaf_only():
    lists = [np.array(x) for x in ([1, 5, 9], [5, 9], [9])]
    assert forest.shared_before(lists, lists, 9).tolist() == [[True, True, False], [True, True, False], [False, False, False]]
    assert not forest.shared_before(lists, lists, 1).any()


def test_splits_avoid_the_thick_of_the_rows():
    p = np.sort(np.concatenate([np.full(500, 0.0), G.uniform(-1, 1, 500)]))
    low, at, high = forest.cut(p, 0.05)
    left, right = forest.sides(p, low, at, high)
    assert low <= at <= high and 0 < left.sum() < 1000 and (left | right).all() and (left & right).sum() <= 101
    assert forest.cut(np.zeros(9), 0.05) is None
