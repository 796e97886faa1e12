"""Near copies by exact word-shingle similarity, with candidates from banded minimum hashes.

Each text is the set of its distinct k-word shingles. Texts of equal sets are
one node. Of 128 minimum hashes, 25 bands of five each form a key; two sets of
similarity s share a key with a chance of ``1 - (1 - s^5)^25`` (0.99995 at 0.8).
Candidates are the pairs of a cell (a key's nodes) whose one-bit signatures
differ in at most ``SIGNS`` of 128 bits (at 0.8 they differ in 13, with a
standard deviation of 3.4); a candidate is a link if the intersection of the
two sets over their union is at least ``SIMILARITY``.

A cell of more than ``CAP`` nodes first compares all nodes with one of them
only, another one in each cell, so a node of many cells meets many others.
Where that leaves several components in a cell, every node outside the cell's
largest component is compared with the least edited node of that component
(by the share of shingles that no other node has). Where several components are
left even so, it is compared with all nodes of other components, so no link
between components of a cell is left out. There, two things bound the
similarity: shingles that only one node has are in no intersection and in each
union, and what either of two nodes lacks of the least edited one is in no
intersection (kept as 128 bits; several shingles of one bit count once).

The first pass over the texts keeps keys and signatures only. Sets are taken in
a second pass, from one text of each node that has a candidate, and tables are
deleted as soon as nothing reads them.

Defined results: null, empty and white texts have no shingle and are one group;
fewer words than a shingle make one shingle; a text of any length is taken whole, a
long one piece by piece; letters A to Z count as a to z.
Shingles are compared by 64-bit hashes. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, doc_text, small_or_shuffled, written
from .graph import components, extended
from .simhash import SEED, _hashes, long_shingles, shingle_spans
from .textops import column_bytes, giving_back, lower, slices

SIMILARITY = 0.8
BANDS, ROWS, HASHES = 25, 5, 128
#: Bits in which one-bit signatures of a candidate pair may differ.
SIGNS = 32
#: Cells up to this many nodes are compared pair by pair at once.
CAP = 8
#: Rows that share one copy of a set or cell in a join.
SHARED = 64
SKETCH = "doc_id long, text_hash long, node long, keys array<long>, s0 long, s1 long"

_draws = np.random.default_rng(SEED)
_ADD = _draws.integers(0, 2**64, HASHES, dtype=np.uint64)
_TIMES = _draws.integers(0, 2**64, HASHES, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _minima(h: np.ndarray, head: np.ndarray) -> np.ndarray:
    """The minimum hashes of runs of shingle hashes that begin at ``head``, one row a run."""
    return np.stack([np.minimum.reduceat((h ^ x) * y, head) for x, y in zip(_ADD, _TIMES)], axis=1)


def _long_set(raw: np.ndarray, k: int, minima: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """``(hashes, minima)`` of the distinct shingles of one long text; minima are combined over its pieces."""
    found, low = [], None
    for shingles in long_shingles(raw, k):
        h = np.unique(_hashes(shingles))
        if minima:
            own = _minima(h, np.zeros(1, np.int64))
            low = own if low is None else np.minimum(low, own)
        found.append(h)
    return (np.unique(np.concatenate(found)), low) if found else (np.zeros(0, np.uint64), np.zeros((0, HASHES), np.uint64))


def sketch(column: pa.Array, k: int, minima: bool = True) -> tuple[np.ndarray, list, np.ndarray, list]:
    """``(node, keys, signature, shingles)`` of the texts of one batch; keys and shingles are empty for texts without words.

    Without ``minima`` there are no keys and signatures.
    """
    n = len(column)
    nodes, signs = np.zeros(n, np.uint64), np.zeros((n, 2), np.uint64)
    none = np.zeros(0, np.int64)
    keys, sets = [none] * n, [none] * n
    offsets, data = column_bytes(column)
    for a, b in slices(offsets, 1 << 19):
        at = offsets[a : b + 1]
        if at[-1] - at[0] > 1 << 19:
            h, low = _long_set(data[at[0] : at[-1]], k, minima)
            row = np.zeros(len(h), np.int64)
        else:
            tidy, s, e, row = shingle_spans(lower(data[at[0] : at[-1]]), at - at[0], k)
            h = _hashes([tidy[i:j] for i, j in zip(s.tolist(), e.tolist())])
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            h, row = h[fresh], row[fresh]
            low = None
        if not len(h):
            continue
        head = np.flatnonzero(np.diff(row, prepend=-1))
        for i, first, last in zip((a + row[head]).tolist(), head.tolist(), [*head[1:].tolist(), len(h)]):
            sets[i] = h[first:last].view(np.int64)
            nodes[i] = xxhash.xxh3_64_intdigest(h[first:last].tobytes(), SEED)
        if not minima:
            continue
        low = _minima(h, head) if low is None else low
        bits = (low * _MIX >> np.uint64(63)).astype(np.uint8)
        signs[a + row[head]] = np.packbits(bits, axis=1).copy().view(np.uint64)
        for i, mins in zip((a + row[head]).tolist(), low):
            # The seed is the band, so keys of different bands don't meet.
            keys[i] = np.array([xxhash.xxh3_64_intdigest(mins[ROWS * g : ROWS * (g + 1)].tobytes(), g) for g in range(BANDS)], np.uint64).view(np.int64)
    return nodes.view(np.int64), keys, signs.view(np.int64), sets


def _lists(parts: list) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))


def _hashed(docs: DataFrame) -> DataFrame:
    return doc_text(docs).withColumn("text_hash", F.xxhash64("text"))


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """One row a document: its set's hash, band keys and signature."""

    def run(batches):
        for whole in batches:
            for a, b in slices(column_bytes(whole.column(1))[0]):
                batch = whole.slice(a, b - a)
                node, keys, signs, _ = sketch(batch.column(1), k)
                cols = [batch.column(0), batch.column(2), pa.array(node), _lists(keys), pa.array(signs[:, 0].copy()), pa.array(signs[:, 1].copy())]
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in SKETCH.split(", ")])

    return _hashed(docs).mapInArrow(giving_back(run), SKETCH)


def shingle_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``(node, shingles)`` of the nodes of ``wanted(doc_id, text_hash)``, from the texts of these documents.

    Shingles take more bytes than their text, so each slice of texts is sent by itself.
    """

    def run(batches):
        for whole in batches:
            for a, b in slices(column_bytes(whole.column(0))[0]):
                node, _, _, sets = sketch(whole.slice(a, b - a).column(0), k, minima=False)
                yield pa.RecordBatch.from_arrays([pa.array(node), _lists(sets)], names=["node", "shingles"])

    uid = F.xxhash64("doc_id", "text_hash").alias("uid")
    named = written(wanted.select(uid).distinct(), "wanted")
    texts = _hashed(docs).select("text", uid).join(small_or_shuffled(named), "uid", "left_semi").select("text")
    out = written(texts.mapInArrow(giving_back(run), "node long, shingles array<long>").dropDuplicates(["node"]), "sets")
    discard(named)
    return out


def _alike(x, y) -> Column:
    """Whether the signatures of two nodes are near enough for a candidate pair."""
    return F.bit_count(x("s0").bitwiseXOR(y("s0"))) + F.bit_count(x("s1").bitwiseXOR(y("s1"))) <= SIGNS


def _parts(n: Column) -> Column:
    return F.ceil(n / SHARED).cast("int")


def _numbers(parts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), parts - 1))


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs(a, b, parts)`` with their sets; the set of ``a`` is dealt in ``parts`` copies, so no frequent one lies in one task."""
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.col("parts").cast("long")).cast("int"))
    copies = pairs.groupBy("a").agg(F.max("parts").alias("parts")).join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a")
    copies = copies.select("a", "of_a", _numbers(F.col("parts")).alias("salt"))
    return pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b").join(copies, ["a", "salt"])


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs(a, b, parts)`` whose sets are similar."""
    common = F.size(F.array_intersect("of_a", "of_b"))
    return _with_sets(pairs, sets).where(common / (F.size("of_a") + F.size("of_b") - common) >= similarity).select("a", "b")


def _bits(shingles: Column, half: int) -> Column:
    """The bits of one half of 128 that any of the shingles sets."""
    mine = F.filter(shingles, lambda s: F.shiftright(s, 6).bitwiseAND(F.lit(1)) == half)
    return F.aggregate(mine, F.lit(0).cast("long"), lambda seen, s: seen.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), s.bitwiseAND(F.lit(63)).cast("int"))))


def _against(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(a, b, all, size, common, lack0, lack1)``: sizes of both sets, what they share, and the bits of what ``b`` lacks of ``a``."""
    both = _with_sets(pairs, sets).withColumn("lack", F.array_except("of_a", "of_b"))
    all_, size = F.size("of_a"), F.size("of_b")
    return both.select("a", "b", all_.alias("all"), size.alias("size"), (all_ - F.size("lack")).alias("common"), _bits(F.col("lack"), 0).alias("lack0"), _bits(F.col("lack"), 1).alias("lack1"))


def _unshared(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, size, own)`` of ``nodes(node)``: the size of each set and how many of its shingles no other of these nodes has."""
    held = sets.join(nodes.distinct(), "node", "left_semi")
    single = held.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"))
    own = single.where("n = 1").groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    return held.select("node", F.size("shingles").alias("size")).join(own, "node", "left").select("node", "size", F.coalesce("own", F.lit(0)).alias("own"))


def _most(x, y) -> Column:
    """The largest similarity that two nodes of a cell can have, by what they share with its least edited node and what no other has."""
    lack = F.bit_count(x("lack0").bitwiseOR(y("lack0"))) + F.bit_count(x("lack1").bitwiseOR(y("lack1")))
    extra = lambda z: F.greatest(z("size") - z("common") - z("own"), F.lit(0))
    common = F.least(x("size") - x("own"), y("size") - y("own"), x("all") - lack + F.least(extra(x), extra(y)))
    return common / F.greatest(x("size") + y("own"), y("size") + x("own"), x("size") + y("size") - common)


def _split(crowded: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of crowded cells with their labels, and ``(key, main, parts)`` of the cells of several components, both written."""
    placed = written(crowded.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "placed")
    sizes = placed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"))
    split = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("classes"), F.max_by("label", F.struct("m", "label")).alias("main"), (F.sum("m") - F.max("m")).alias("others")).where("classes > 1")
    return placed, written(split.select("key", "main", _parts(F.col("others")).alias("parts")), "split")


def _across(open_: DataFrame, similarity: float) -> DataFrame:
    """``(a, b, parts)``: all pairs of nodes of a cell and different components, one of them not of the largest, that may be similar."""
    left = open_.where("label <> main").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int"))
    right = open_.withColumn("salt", _numbers(F.col("parts"))).drop("parts")
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    cross = left.alias("x").join(right.alias("y"), (x("key") == y("key")) & (x("salt") == y("salt")))
    once = (y("label") == x("main")) | (x("node") < y("node"))
    cross = cross.where((x("label") != y("label")) & once & _alike(x, y) & (_most(x, y) >= similarity))
    return cross.groupBy(x("node").alias("a"), y("node").alias("b")).agg(F.max("x.parts").alias("parts"))


def linked(docs: DataFrame, nodes: DataFrame, k: int = 5, similarity: float = SIMILARITY, cap: int = CAP) -> DataFrame:
    """``(node, label)`` of all nodes with a link; ``nodes(node, doc_id, text_hash, keys, s0, s1)`` names one document of ``docs`` a node."""
    keyed = nodes.select(F.explode("keys").alias("key"), "node", "s0", "s1")
    # The node that stands for a crowded cell differs from cell to cell.
    stands = F.min_by("node", F.struct(F.xxhash64("node", "key"), "node")).alias("pivot")
    cells = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), stands).where("n > 1"), "cells")
    met = written(keyed.join(cells, "key"), "met")
    discard(cells)

    gathered = met.where(F.col("n") <= cap).groupBy("key").agg(F.collect_list(F.struct("node", "s0", "s1")).alias("all"))
    one = gathered.select(F.explode("all").alias("x"), "all")
    one = one.select("x", F.explode(F.filter("all", lambda y: y["node"] > F.col("x.node"))).alias("y"))
    small = one.where(_alike(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"))).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.lit(1).alias("parts"))
    crowded = met.where(F.col("n") > cap)
    star = crowded.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"), _parts(F.col("n")).alias("parts"))
    pairs = written(small.unionByName(star).groupBy("a", "b").agg(F.max("parts").alias("parts")), "pairs")
    # Only the sets of nodes with a candidate are taken.
    either = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = shingle_sets(docs, nodes.select("node", "doc_id", "text_hash").join(either, "node", "left_semi"), k)
    links = written(verified(pairs, sets, similarity), "links")
    labels = components(links)

    met_again = written(crowded.select("key", "node", "n", "s0", "s1"), "crowded")
    discard(met, pairs)
    placed, split = _split(met_again, labels)
    used = [sets, links, met_again]
    if split.limit(1).count():
        own = written(_unshared(sets, placed.join(split, "key").select("node")), "own")
        open_ = placed.join(split, "key").join(own, "node")
        order = F.struct(F.col("own") / F.col("size"), "node")
        least = written(open_.where("label = main").groupBy("key").agg(F.min_by("node", order).alias("a")), "least")
        star = open_.join(least, "key").groupBy("a", F.col("node").alias("b")).agg(F.max(_parts(F.col("n"))).alias("parts"))
        star = written(_against(star, sets), "star")
        more = written(star.where(F.col("common") / (F.col("all") + F.col("size") - F.col("common")) >= similarity).where("a <> b").select("a", "b"), "links")
        used += [own, least, star, more]
        if more.limit(1).count():
            discard(placed, split)
            labels = extended(labels, more)
            placed, split = _split(met_again, labels)
        seen = star.withColumnRenamed("b", "node").join(own.select("node", "own"), "node")
        rest = written(_across(placed.join(split, "key").join(least, "key").join(seen, ["a", "node"]), similarity), "pairs")
        more = written(verified(rest, sets, similarity), "links")
        used += [rest, more]
        if more.limit(1).count():
            labels = extended(labels, more)
    discard(placed, split, *used)
    return labels


def near_copies(docs: DataFrame, k: int = 5, similarity: float = SIMILARITY, cap: int = CAP) -> DataFrame:
    """``(doc_id, text_hash, label)`` of every document, as a written table; documents reachable over links have equal labels."""
    rows = written(sketches(docs, k), "sketches")
    # Documents of one node have equal keys and signatures.
    nodes = written(rows.where("size(keys) > 0").dropDuplicates(["node"]), "nodes")
    labels = linked(docs, nodes, k, similarity, cap)
    out = written(rows.select("doc_id", "text_hash", "node").join(labels, "node", "left").select("doc_id", "text_hash", F.coalesce("label", "node").alias("label")), "copies")
    discard(rows, nodes, labels)
    return out
