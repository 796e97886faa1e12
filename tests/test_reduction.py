"""Chunk reduction, bitset persistence, Rips complexes and ranks by ranges against the plain ways."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import chunks, ranking, topology

SCHEMA = "t long, ord int, dim int, i int, j int, k int, w double, arrival long"


def complex_of(seed, n=9, dense=0.9, ties=False):
    """A random filtration of edges and triangles whose faces come before them: ``(dim, i, j, k, w, arrival)``."""
    g = np.random.default_rng(seed)
    value = {e: float(g.integers(0, 5) if ties else g.random()) for e in itertools.combinations(range(n), 2) if g.random() < dense}
    rows = [(1, *e, -1, -v) for e, v in value.items()]
    for a, b, c in itertools.combinations(range(n), 3):
        if {(a, b), (a, c), (b, c)} <= set(value) and g.random() < 0.7:
            low = max(value[a, b], value[a, c], value[b, c])
            rows.append((2, a, b, c, -(low + (0.0 if g.random() < 0.3 else float(g.random())))))
    steps = {v: n + 1 for n, v in enumerate(sorted({-r[4] for r in rows}))}
    return [(*r, steps[-r[4]]) for r in rows]


def frames(spark, complexes):
    return spark.createDataFrame([(t, 0, *r) for t, rows in enumerate(complexes) for r in rows], SCHEMA)


def plain(rows):
    """``(columns, dims, pairs)`` in filtration order, by the standard reduction."""
    nodes = sorted({x for r in rows for x in r[1:3]})
    simplices = [(x,) for x in nodes] + [tuple(x for x in r[1:4] if x >= 0) for r in sorted(rows, key=lambda r: (r[5], r[0], r[1:4]))]
    columns, dims = topology.boundary_of(simplices)
    return columns, dims, topology.reduce_columns(columns, dims, "standard")


COMPLEXES = [complex_of(s) for s in range(4)] + [complex_of(9, ties=True), complex_of(10, 14, 1.0), complex_of(11, 5, 0.5)]


@pytest.mark.parametrize("block", [1, 7, 40, 4096])
def test_chunks_give_the_standard_pairs(spark, block):
    """Frames lie in many blocks, down to one column each."""
    kept = frames(spark, COMPLEXES)
    columns = chunks.boundary(kept)
    for r in columns.collect():
        want = plain(COMPLEXES[r.t])
        assert (r.dim, r.rows) == (want[1][r.col], sorted(want[0][r.col]))
    got = {(r.t, r.birth, r.death) for r in chunks.pairs(columns, block).collect()}
    assert got == {(t, b, d) for t, rows in enumerate(COMPLEXES) for b, d in plain(rows)[2]}


def test_chunks_of_the_golden_triangle(spark):
    rows = [(0, c, d, r) for c, (r, d) in enumerate(zip([[], [], [], [0, 1], [0, 2], [1, 2], [3, 4, 5]], [0, 0, 0, 1, 1, 1, 2]))]
    columns = spark.createDataFrame(rows, "t long, col long, dim int, rows array<long>")
    assert sorted((r.birth, r.death) for r in chunks.pairs(columns, 2).collect()) == [(1, 3), (2, 4), (5, 6)]


def test_chunks_of_any_dimension_and_of_nothing(spark):
    """All faces of a simplex with seven corners, in a shuffled order that keeps faces first."""
    g = np.random.default_rng(4)
    faces = [c for n in range(1, 8) for c in itertools.combinations(range(7), n)]
    weight = {c: g.random() for c in faces}
    entry = {c: max(weight[f] for n in range(1, len(c) + 1) for f in itertools.combinations(c, n)) for c in faces}
    order = sorted(faces, key=lambda c: (entry[c], len(c), c))
    columns, dims = topology.boundary_of(order)
    df = spark.createDataFrame([(5, c, d, r) for c, (r, d) in enumerate(zip(columns, dims))], "t long, col long, dim int, rows array<long>")
    assert sorted((r.birth, r.death) for r in chunks.pairs(df, 16).collect()) == topology.reduce_columns(columns, dims, "standard")
    assert chunks.pairs(df.limit(0), 16).collect() == [] and chunks.persistence(frames(spark, [complex_of(1)]).limit(0)).collect() == []


def test_local_pairs_of_a_block_are_final():
    columns, dims, pairs = plain(COMPLEXES[5])
    start, stop = 30, 90
    local, rest = chunks.reduce_block({c: (dims[c], columns[c]) for c in range(start, stop)}, start)
    assert {(b, d) for b, (d, _) in local.items()} == {(b, d) for b, d in pairs if start <= b and d < stop}
    deaths = {d for d, _ in local.values()}
    for work in [w - {b} for b, (_, w) in local.items()] + list(rest.values()):
        assert not {r for r in work if r >= start} & (set(local) | deaths)


def test_diagrams_of_both_ways_agree(spark):
    kept = frames(spark, COMPLEXES).cache()
    for dim in (0, 1):
        a = sorted(map(tuple, topology.persistence(kept, dim).collect()))
        b = sorted(map(tuple, chunks.persistence(kept, dim, 13).collect()))
        assert [tuple(abs(x) if x == 0 else x for x in r) for r in a] == [tuple(abs(x) if x == 0 else x for x in r) for r in b]
    for t, rows in enumerate(COMPLEXES):
        columns, dims, pairs = plain(rows)
        dead, ended = {d for _, d in pairs}, {b for b, _ in pairs}
        want = {dim: sum(1 for c in range(len(columns)) if dims[c] == dim and c not in dead and c not in ended) for dim in (0, 1)}
        got = {r.dim: r.betti for r in topology.betti_numbers(kept.where(F.col("t") == t)).collect()}
        assert got[0] == want[0] and got.get(1, 0) == want[1]


def test_scaffold_weighs_the_reduced_cycles(spark):
    rows = COMPLEXES[5]
    columns, dims, pairs = plain(rows)
    _, reduced, _ = topology.reduce_columns(columns, dims, "standard", basis=True)
    order = sorted(rows, key=lambda r: (r[5], r[0], r[1:4]))
    nodes = len({x for r in rows for x in r[1:3]})
    want = {}
    for b, d in pairs:
        if dims[b] == 1 and order[d - nodes][5] > order[b - nodes][5]:
            for e in reduced[d]:
                n, p = want.get(order[e - nodes][1:3], (0, 0))
                want[order[e - nodes][1:3]] = (n + 1, p + order[d - nodes][5] - order[b - nodes][5])
    got = {(r.i, r.j): (r.n, r.persistence) for r in topology.scaffold(frames(spark, [rows])).collect()}
    assert got == want


def test_nodes_enter_with_the_frames_weight(spark):
    kept = frames(spark, [COMPLEXES[0]])
    weights = spark.createDataFrame([(0, 2.5, 3.0)], "t long, max_weight double, node_weight double")
    assert {r.birth for r in topology.persistence(kept, 0, weights).collect()} == {-3.0}


def test_rips_complex_against_brute_force(spark):
    v = np.random.default_rng(8).random((45, 5)) * [1, 0.1, 2, 1, 0.5]
    df = spark.createDataFrame([(n, x.tolist()) for n, x in enumerate(v)], "id int, v array<double>")
    d = np.linalg.norm(v[:, None] - v[None], axis=2)
    want = {c: max((d[a, b] for a, b in itertools.combinations(c, 2)), default=0.0) for n in (1, 2, 3, 4) for c in itertools.combinations(range(45), n)}
    want = {c: x for c, x in want.items() if x <= 0.6}
    got = {tuple(r.members): r.d for r in topology.rips_complex(df, 0.6, 3).collect()}
    assert set(got) == set(want) and all(abs(got[c] - want[c]) < 1e-12 for c in want)


def test_rips_of_repeated_points(spark):
    """Points in one place are at distance zero; ids tell them apart."""
    df = spark.createDataFrame([(n, [0.5, 0.5]) for n in range(4)], "id int, v array<double>")
    assert sorted((r.a, r.b, r.d) for r in topology.rips_edges(df, 0.1).collect()) == [(a, b, 0.0) for a, b in itertools.combinations(range(4), 2)]
    with pytest.raises(ValueError):
        topology.rips_edges(df, 0.0)


def test_loops_of_a_circle_of_points(spark):
    """A circle has one long loop; the filtration goes by diameters."""
    angle = np.linspace(0, 2 * np.pi, 24, endpoint=False)
    df = spark.createDataFrame([(n, [float(np.cos(a)), float(np.sin(a))]) for n, a in enumerate(angle)], "id int, v array<double>")
    kept = topology.clique_filtration(topology.rips_complex(df, 2.1)).cache()
    got = [(r.birth, r.death) for r in chunks.persistence(kept, 1, 200).collect()]
    birth, death = max(got, key=lambda x: x[1] - x[0])
    assert abs(birth - 2 * np.sin(np.pi / 24)) < 1e-9 and 1.6 < death < 1.9
    assert sorted(got) == sorted((r.birth, r.death) for r in topology.persistence(kept, 1).collect())


def test_ranks_by_ranges(spark):
    g = np.random.default_rng(2)
    rows = [(int(k), float(x), n) for n, (k, x) in enumerate(zip(g.integers(0, 3, 400), g.integers(0, 20, 400)))]
    df = spark.createDataFrame(rows, "k int, x double, n int").repartition(7)
    got = {r.n: r["rank"] for r in ranking.ranked(df, ["k"], [F.col("x"), F.col("n")]).collect()}
    for k in range(3):
        own = sorted((x, n) for kk, x, n in rows if kk == k)
        assert all(got[n] == place + 1 for place, (_, n) in enumerate(own))
    every = {r.n: r["rank"] for r in ranking.ranked(df, [], [F.desc("x"), F.col("n")]).collect()}
    assert [n for n, _ in sorted(every.items(), key=lambda p: p[1])] == [n for _, n in sorted((-x, n) for _, x, n in rows)]
