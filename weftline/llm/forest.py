"""Embedding near-duplicates by a forest of random-projection trees.

Equal vectors are one node. A tree splits its nodes by the projection on a random
direction, at the place between the 30th and 70th percentile around which fewest
rows lie; rows within ``SPILL`` of the rows beside the split go to both sides. Trees are
fitted on bounded samples of the rows of each open leaf and all rows follow them; leaves
that come out larger than ``LEAF`` are split again in the next round, so depth grows with
the rows. A leaf that is one tight group, or whose rows can't be told apart, isn't split,
whatever its size: its rows are compared in blocks of ``FEW``, each pair of blocks in a
task of its own.

A pair is counted in the first leaf that it shares, told from the lists of leaves that both
carry, so counts need no table of pairs; for components each leaf sends one edge a row.

Groups of very many near copies are found first, by one tree without spill: the members
of a tight leaf within half the angle of the threshold around its mean direction are all
linked to each other and become one *ball*. A ball goes through the forest as its centre,
with its radius. Where centre and radius leave open whether another item links with
the members, these are compared one by one, in blocks.

Pairs are found with a chance: one exactly at cosine 0.9 is lost in a tree of eight levels
in about four of ten cases, in all ``TREES`` in less than one of a million. Every pair found is
verified in double precision.

Defined results: vectors that are null, zero or hold null or non-finite entries link with
nothing; shorter vectors are filled up with zeros to the longest. Rows that repeat are linked
to each other. A null ``vec_id`` counts for no component id; a group of only such rows has a
null component, and its rows are kept. An empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_or_shuffled, written
from .graph import components
from .vectors import entries, matrix, whole

LIMIT = 0.9
TREES, SPILL, LEAF = 16, 0.05, 512
#: Rows (about) that a subtree is fitted on, and rows of a block that is routed or summed at once.
SAMPLE, BLOCK = 4096, 16384
#: A node is tight if nine of ten rows are within this share of the threshold's angle around their mean.
TIGHT, MOST = 1.0, 0.9
#: Members of a tight leaf from which it becomes a ball, and rows of a block of tight leaves and balls.
BALL, FEW = 256, 2048
PATH = 56


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length one, without overflow or underflow on the way; a zero row stays."""
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True, initial=0), np.finfo(float).tiny)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def root(tree: int) -> int:
    """The code of a tree's first node: the tree, then a path of bits behind a leading 1."""
    return tree << PATH | 1


def children(code: int) -> tuple[int, int]:
    tree, path = code >> PATH, code & ((1 << PATH) - 1)
    return tree << PATH | path << 1, tree << PATH | path << 1 | 1


def direction(code: int, d: int, seed: int) -> np.ndarray:
    g = np.random.default_rng([seed, code]).normal(size=d)
    return g / np.linalg.norm(g)


def cut(p: np.ndarray, spill: float) -> tuple[float, float, float] | None:
    """``(low, at, high)`` of sorted projections: the split and the values up to which rows go to both sides."""
    n = len(p)
    k = max(1, round((spill or 0.02) * n))
    places = np.unique(np.linspace(0.3 * n, 0.7 * n, 17).astype(int).clip(1, n - 1))
    places = places[p[places - 1] < p[places]]
    if not len(places):
        steps = np.flatnonzero(p[:-1] < p[1:]) + 1
        if not len(steps):
            return None
        places = steps[[np.abs(steps - n / 2).argmin()]]
    i = int(places[(p[np.minimum(places + k, n - 1)] - p[np.maximum(places - k, 0)]).argmax()])
    at = (p[i - 1] + p[i]) / 2
    at = at if p[i - 1] < at else p[i]
    return (p[max(0, i - 1 - k)], at, p[min(n - 1, i + k)]) if spill else (at, at, at)


def sides(p: np.ndarray, low: float, at: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    return (p < at) | (p < high), (p >= at) | (p > low)


def subtree(x: np.ndarray, n: int, code: int, spill: float, seed: int, leaf: int, tight: float) -> tuple[dict, set]:
    """``(splits, tight codes)`` below ``code``, from sampled unit rows of its ``n`` rows."""
    splits, closed, todo = {}, set(), [(code, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        if at != code and (n * len(rows) / max(1, len(x)) <= 0.6 * leaf or len(rows) < 32):
            continue
        own = x[rows]
        mean = own.mean(axis=0)
        near = (own @ (mean / max(np.linalg.norm(mean), 1e-300)) >= math.cos(tight)).mean() >= MOST
        place = None if near or (at & ((1 << PATH) - 1)) >> (PATH - 2) else cut(np.sort(own @ direction(at, x.shape[1], seed)), spill)
        if place is None:
            closed.add(at)
            continue
        splits[at] = place
        for child, side in zip(children(at), sides(own @ direction(at, x.shape[1], seed), *place)):
            todo.append((child, rows[side]))
    return splits, closed


def routed(x: np.ndarray, code: int, splits: dict, seed: int) -> list[tuple[int, np.ndarray]]:
    """``(leaf, rows)``: where the splits send unit rows."""
    out, todo = [], [(code, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        if at not in splits:
            out.append((at, rows))
        elif len(rows):
            todo += [(child, rows[side]) for child, side in zip(children(at), sides(x[rows] @ direction(at, x.shape[1], seed), *splits[at]))]
    return out


def grown(nodes: DataFrame, d: int, trees: int, spill: float, seed: int, leaf: int = LEAF, limit: float = LIMIT) -> DataFrame:
    """``(nid, leaf, tight)``: the leaves of every row of ``nodes(nid, v)`` in all trees; only tight leaves have more than ``leaf`` rows."""
    tight = TIGHT * math.acos(limit)

    def fit(key, rows):
        code, n = key[0].as_py(), key[1].as_py()
        splits, closed = subtree(units(matrix(rows["v"].combine_chunks(), d)), n, code, spill, seed, leaf, tight)
        flat = [[code], [n], [list(splits)], [[x for s in splits.values() for x in s]], [sorted(closed)]]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(flat, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.int64())))], names=["leaf", "n", "codes", "places", "closed"])

    def follow(rows, tree):
        empty = pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.bool_())], names=["nid", "leaf", "tight"])
        if not rows.num_rows or not tree.num_rows:
            return empty
        places = np.array(tree["places"][0].as_py(), float).reshape(-1, 3).tolist()
        splits, closed = dict(zip(tree["codes"][0].as_py(), map(tuple, places))), set(tree["closed"][0].as_py())
        ids, x = rows["nid"].to_numpy(), units(matrix(rows["v"].combine_chunks(), d))
        found = [(ids[own], code) for code, own in routed(x, tree["leaf"][0].as_py(), splits, seed) if len(own)]
        return pa.Table.from_arrays(
            [pa.array(np.concatenate([i for i, _ in found])), pa.array(np.concatenate([np.full(len(i), c, np.int64) for i, c in found])), pa.array(np.concatenate([np.full(len(i), c in closed) for i, c in found]))], names=["nid", "leaf", "tight"]
        )

    members = nodes.select("nid", F.explode(F.array(*[F.lit(root(t)) for t in range(trees)])).alias("leaf"), F.lit(False).alias("tight"))
    done = None
    while True:
        big = written(members.where("NOT tight").groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf), "open")
        some = big.limit(1).count() > 0
        closed = members.join(small_or_shuffled(big), "leaf", "left_anti").select("nid", "leaf", "tight") if some else members
        done = closed if done is None else done.unionByName(closed)
        if not some:
            return done
        rows = members.select("nid", "leaf").join(small_or_shuffled(big), "leaf").join(nodes, "nid")
        part = F.pmod(F.xxhash64("nid", "leaf", F.lit(seed)), F.lit(1 << 30)) < F.lit(float(SAMPLE * (1 << 30))) / F.col("n")
        trees_fit = written(rows.where(part).groupBy("leaf", "n").applyInArrow(fit, "leaf long, n long, codes array<long>, places array<double>, closed array<long>"), "splits")
        salt = F.pmod(F.xxhash64("nid"), F.ceil(F.col("n") / BLOCK))
        left = rows.select("leaf", salt.alias("salt"), "nid", "v")
        right = trees_fit.select("leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / BLOCK) - 1)).alias("salt"), "codes", "places", "closed")
        members = written(left.groupBy("leaf", "salt").cogroup(right.groupBy("leaf", "salt")).applyInArrow(follow, "nid long, leaf long, tight boolean"), "members")


def balls(nodes: DataFrame, d: int, leaf: int = LEAF, limit: float = LIMIT, least: int = BALL) -> DataFrame | None:
    """``(nid, item, v, r)``: members of balls with the ball's id (its smallest node), centre and radius; None if there is none."""
    found = written(grown(nodes, d, 1, 0.0, 101, leaf, limit).where("tight").select("nid", "leaf"), "tight")
    sizes = written(found.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least), "sizes")
    if not sizes.limit(1).count():
        return None
    rows = found.join(small_or_shuffled(sizes), "leaf").join(nodes, "nid")
    half = math.acos(limit) / 2 - 1e-6

    def partial(key, table):
        total = units(matrix(table["v"].combine_chunks(), d)).sum(axis=0)
        return pa.Table.from_arrays([pa.array([key[0].as_py()]), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["leaf", "s"])

    def mean(key, table):
        total = units(matrix(table["s"].combine_chunks(), d).sum(axis=0)[None])[0]
        return pa.Table.from_arrays([pa.array([key[0].as_py()]), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["leaf", "centre"])

    sums = rows.groupBy("leaf", F.pmod(F.xxhash64("nid"), F.ceil(F.col("n") / BLOCK))).applyInArrow(partial, "leaf long, s array<double>")
    centres = written(sums.groupBy("leaf").applyInArrow(mean, "leaf long, centre array<double>"), "centres")

    def angles(batches):
        for batch in batches:
            cosine = (units(matrix(batch["v"], d)) * matrix(batch["centre"], d)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch["nid"], batch["leaf"], pa.array(np.arccos(cosine.clip(-1, 1)))], names=["nid", "leaf", "angle"])

    near = written(rows.select("nid", "leaf", "v").join(small_or_shuffled(centres), "leaf").mapInArrow(angles, "nid long, leaf long, angle double").where(F.col("angle") <= half), "near")
    stats = near.groupBy("leaf").agg(F.min("nid").alias("item"), F.max("angle").alias("r"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("n").join(centres, "leaf")
    stats = written(stats.select("leaf", "item", F.col("centre").alias("v"), "r"), "balls")
    return written(near.select("nid", "leaf").join(small_or_shuffled(stats), "leaf").select("nid", "item", "v", "r"), "balled") if stats.limit(1).count() else None


def shared_before(a: list, b: list, leaf: int) -> np.ndarray:
    """Which rows of ``a`` and ``b`` (arrays of leaves) share a leaf that comes before ``leaf``."""
    out, where = np.zeros((len(a), len(b)), bool), {}
    for k, lists in enumerate((a, b)):
        for i, own in enumerate(lists):
            for x in own[own < leaf].tolist():
                where.setdefault(x, ([], []))[k].append(i)
    for left, right in where.values():
        if left and right:
            out[np.ix_(left, right)] = True
    return out


def groups(link: np.ndarray) -> np.ndarray:
    """The smallest row that each row of a symmetric matrix of links reaches."""
    label = np.arange(len(link))
    while True:
        least = np.where(link, label[None], len(link)).min(axis=1, initial=len(link))
        new = np.minimum(label, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compared(leaf: int, ids, x, r, w, sig, first: np.ndarray, second: np.ndarray, limit: float) -> tuple[list, list, list]:
    """``(degrees, edges, open)`` of the rows ``first`` against ``second`` (the same rows: each pair once)."""
    same = first is second
    cosine = x[first] @ x[second].T
    reach = r[first][:, None] + r[second][None]
    theta = math.acos(limit)
    angle = np.arccos(cosine.clip(-1, 1)) if reach.any() else None
    link = cosine >= limit
    unsure = np.zeros_like(link)
    if angle is not None:
        ball = reach > 0
        sure = angle + reach <= theta - 1e-9
        unsure = ball & ~sure & (angle - reach <= theta + 1e-9)
        link = np.where(ball, sure, link)
    if same:
        np.fill_diagonal(link, False)
        np.fill_diagonal(unsure, False)
    a, b = np.flatnonzero((link | unsure).any(axis=1)), np.flatnonzero((link | unsure).any(axis=0))
    if not len(a):
        return [], [], []
    link, unsure = link[np.ix_(a, b)], unsure[np.ix_(a, b)]
    a, b = first[a], second[b]
    new = ~shared_before([sig[i] for i in a], [sig[i] for i in b], leaf)
    counted = link & new
    degrees = list(zip(ids[a].tolist(), (counted @ w[b]).tolist()))
    if same:
        label = groups(link)
        edges = [(int(ids[a[i]]), int(ids[a[k]])) for i, k in enumerate(label) if i != k]
        unsure = np.triu(unsure, 1)
    else:
        degrees += list(zip(ids[b].tolist(), (w[a] @ counted).tolist()))
        both = np.zeros((len(a) + len(b),) * 2, bool)
        both[: len(a), len(a) :], both[len(a) :, : len(a)] = link, link.T
        every = np.concatenate([ids[a], ids[b]])
        edges = [(int(every[i]), int(every[k])) for i, k in enumerate(groups(both)) if i != k]
    i, k = np.nonzero(unsure & new)
    return degrees, edges, list(zip(ids[a[i]].tolist(), ids[b[k]].tolist()))


FOUND = "kind int, a long, b long, n long"


def _found(*lists) -> pa.Table:
    """Degrees, edges and open pairs as rows ``(kind, a, b, n)``."""
    degrees, edges, unsure = lists
    kind = [0] * len(degrees) + [1] * len(edges) + [2] * len(unsure)
    a = [x[0] for part in lists for x in part]
    b = [0] * len(degrees) + [x[1] for part in (edges, unsure) for x in part]
    n = [x[1] for x in degrees] + [0] * (len(edges) + len(unsure))
    return pa.Table.from_arrays([pa.array(kind, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["kind", "a", "b", "n"])


def leaf_links(items: DataFrame, d: int, trees: int, spill: float, leaf: int = LEAF, limit: float = LIMIT, few: int = FEW) -> DataFrame:
    """``(kind, a, b, n)`` of ``items(nid, v, r, w)``: 0 for ``n`` links of ``a``, 1 for an edge, 2 for a pair that its centres leave open."""
    members = written(grown(items.select("nid", "v"), d, trees, spill, 7, leaf, limit).select("nid", "leaf"), "leaves")
    listed = members.groupBy("nid").agg(F.sort_array(F.collect_list("leaf")).alias("sig"))
    large = written(members.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf).select("leaf", F.ceil(F.col("n") / max(leaf, few)).alias("chunks")), "large")
    rows = items.join(listed, "nid").select("*", F.explode("sig").alias("leaf")).join(small_or_shuffled(large), "leaf", "left").fillna(1, ["chunks"])
    rows = rows.withColumn("c", F.pmod(F.xxhash64("nid"), F.col("chunks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("o")
    rows = rows.select("nid", "v", "r", "w", "sig", "leaf", "c", other).withColumns({"low": F.least("c", "o"), "high": F.greatest("c", "o")}).drop("o")

    def one(key, table):
        code, low, high = (k.as_py() for k in key)
        ids, c = table["nid"].to_numpy(), table["c"].to_numpy()
        order = np.argsort(ids, kind="stable")
        x = units(matrix(table["v"].combine_chunks(), d))
        sig = [s.values.to_numpy() for s in table["sig"]]
        first = order if low == high else order[c[order] == low]
        second = first if low == high else order[c[order] == high]
        return _found(*compared(code, ids, x, table["r"].to_numpy(), table["w"].to_numpy(), sig, first, second, limit))

    return rows.groupBy("leaf", "low", "high").applyInArrow(one, FOUND)


def member_links(unsure: DataFrame, items: DataFrame, nodes: DataFrame, members: DataFrame, d: int, limit: float = LIMIT, few: int = FEW) -> DataFrame:
    """``(kind, a, b, n)`` of pairs of items that only their members decide: 0 for ``n`` links of node ``a``, 1 for an edge of items."""
    sizes = members.groupBy("item").agg(F.count(F.lit(1)).alias("m"))
    s = sizes.select(F.col("item").alias("a"), F.col("m").alias("ma"))
    t = sizes.select(F.col("item").alias("b"), F.col("m").alias("mb"))
    pairs = unsure.join(s, "a", "left").join(t, "b", "left").fillna(1, ["ma", "mb"])
    pairs = written(pairs.select("a", "b", F.ceil(F.col("ma") / few).alias("ca"), F.ceil(F.col("mb") / few).alias("cb")), "unsure")
    node = nodes.select("nid", "v", F.col("n").alias("w"))
    every = members.select("nid", "item").unionByName(items.where("r = 0").select("nid", F.col("nid").alias("item"))).join(node, "nid")
    count = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))

    def side(name, own, rest):
        rows = pairs.join(every.withColumnRenamed("item", name), name)
        rows = rows.withColumn(f"k{name}", F.pmod(F.xxhash64("nid"), F.col(own)))
        return rows.withColumn("k" + ("b" if name == "a" else "a"), count(rest)).select("a", "b", "ka", "kb", F.lit(name).alias("side"), "nid", "v", "w")

    both = side("a", "ca", "cb").unionByName(side("b", "cb", "ca"))

    def one(key, table):
        a, b = key[0].as_py(), key[1].as_py()
        at, ids, w = table["side"].to_numpy(zero_copy_only=False), table["nid"].to_numpy(), table["w"].to_numpy()
        x = units(matrix(table["v"].combine_chunks(), d))
        left, right = np.flatnonzero(at == "a"), np.flatnonzero(at == "b")
        link = x[left] @ x[right].T >= limit
        degrees = list(zip(ids[left].tolist(), (link @ w[right]).tolist())) + list(zip(ids[right].tolist(), (w[left] @ link).tolist()))
        return _found([x for x in degrees if x[1]], [(a, b)] if link.any() else [], [])

    return both.groupBy("a", "b", "ka", "kb").applyInArrow(one, FOUND)


def near_duplicates(vectors: DataFrame, limit: float = LIMIT, trees: int = TREES, spill: float = SPILL, leaf: int = LEAF, least: int = BALL) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row of ``vectors(vec_id, embedding)``."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(whole(), entries()).alias("v"))
    fine = F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    grouped = rows.where(fine).groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("low"))
    nodes = written(grouped.withColumn("nid", F.monotonically_increasing_id()), "nodes")
    d = nodes.agg(F.max(F.size("v"))).first()[0] or 0
    single = nodes.select("nid", "v", F.lit(0.0).alias("r"), F.col("n").alias("w"))
    hot = balls(nodes.select("nid", "v"), d, leaf, limit, least) if d else None
    if hot is not None:
        whole_ball = hot.join(nodes.select("nid", "n"), "nid").groupBy("item").agg(F.first("v").alias("v"), F.first("r").alias("r"), F.sum("n").alias("w"))
        alone = single.join(hot.select("nid"), "nid", "left_anti")
        # A ball of radius zero holds one direction in several lengths; its radius is kept above zero, as it is still a ball.
        items = written(alone.unionByName(whole_ball.select(F.col("item").alias("nid"), "v", F.greatest("r", F.lit(1e-12)).alias("r"), "w")), "items")
    else:
        items = single
    found = written(leaf_links(items, d, trees, spill, leaf, limit), "found")
    edges = found.where("kind = 1").select("a", "b")
    degree = found.where("kind = 0").groupBy(F.col("a").alias("item")).agg(F.sum("n").alias("links"))
    if hot is not None:
        own = nodes.select("nid", "n", "low").join(hot.select("nid", "item"), "nid", "left").withColumn("item", F.coalesce("item", "nid"))
        more = written(member_links(found.where("kind = 2").select("a", "b"), items, nodes, hot, d, limit), "more")
        edges = edges.unionByName(more.where("kind = 1").select("a", "b"))
        extra = more.where("kind = 0").groupBy(F.col("a").alias("nid")).agg(F.sum("n").alias("extra"))
        own = own.join(extra, "nid", "left").join(items.select(F.col("nid").alias("item"), "w"), "item")
    else:
        own = nodes.select("nid", "low", F.col("nid").alias("item"), F.lit(0).cast("long").alias("extra"), F.col("n").alias("w"))
    labels = components(edges.distinct()).select(F.col("node").alias("item"), "label")
    placed = own.join(degree, "item", "left").join(labels, "item", "left")
    placed = written(placed.select("nid", "low", F.coalesce("label", "item").alias("label"), (F.col("w") - 1 + F.coalesce("links", F.lit(0)) + F.coalesce("extra", F.lit(0))).alias("n_links")), "placed")
    lowest = placed.groupBy("label").agg(F.min("low").alias("component_id"))
    named = placed.join(lowest, "label").select("nid", "n_links", "component_id").join(nodes.select("nid", "v"), "nid")
    named = written(named.select(F.xxhash64("v").alias("h"), F.col("v").alias("u"), "n_links", "component_id"), "named")
    linked = rows.where(fine).withColumn("h", F.xxhash64("v")).join(named, "h").where("v = u").select("vec_id", "n_links", "component_id")
    rest = rows.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def result(vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors)


#: The same result in DuckDB, for vectors of one length and ids that don't repeat: all pairs compared.
SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= {LIMIT}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
own AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT own.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, own.vec_id = component_id AS kept FROM own LEFT JOIN degree USING (vec_id)
"""
