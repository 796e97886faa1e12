"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint has a bit set where more than half of the document's shingle
hashes have it. Its embedding is the number of set bits in each segment of two
bits, kept in unary form in one long, so that the Manhattan distance of two
embeddings is the popcount of their XOR. That distance is never larger than
the Hamming distance. A distance of at most r changes at most r of r + 3 groups
of segments, so two linked fingerprints share a grid cell formed by three whole
groups; cells are joined, the Manhattan bound is checked, then the exact
distance.

Equal fingerprints are one node. A cell with more than ``CAP`` nodes is not
paired: its nodes are linked through the values at half the radius around them
(two values within distance 2 have a common value one bit away from both), a
number of rows in proportion to the nodes. Either way no link is lost.

Defined results: null and empty texts and texts of white space have fingerprint
zero and link like others; fewer words than a shingle make one shingle; a text
of any length is hashed whole, a long one piece by piece; a bit set in exactly half of the hashes is 0; rows
that repeat are linked; a null ``doc_id`` counts for no component id. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_text, written
from .graph import components
from .textops import _SPACE, column_bytes, lower, slices, words

SEED = 42
RADIUS = 2
#: Cells up to this many fingerprints are compared pair by pair.
CAP = 16
_ODD = 0x5555555555555555


def shingle_spans(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """``(bytes, start, end, row)``: words joined by one space, and the span of each k-word shingle in them."""
    full = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    keep = full.copy()
    keep[1:] |= full[:-1] & ~first[1:-1]
    start, end, row = words(data, offsets)
    at = np.concatenate([[0], np.cumsum(keep)])
    tidy = np.where(full, data, 32)[keep].tobytes()
    start, end = at[start], at[end]
    if not len(row):
        return tidy, start, end, row
    head = np.flatnonzero(np.diff(row, prepend=-1))
    size = np.diff(np.append(head, len(row)))
    short = size < k
    i = np.arange(len(row))
    whole = np.flatnonzero(i + k <= (head + size)[np.searchsorted(head, i, side="right") - 1])
    s = np.concatenate([start[whole], start[head[short]]])
    e = np.concatenate([end[whole + k - 1], end[(head + size - 1)[short]]])
    r = np.concatenate([row[whole], row[head[short]]])
    order = np.argsort(r, kind="stable")
    return tidy, s[order], e[order], r[order]


#: Bytes of a text from which its shingles are taken in pieces of about as many.
PIECE = 1 << 19


def long_shingles(raw: np.ndarray, k: int, limit: int | None = None) -> Iterator[list[bytes]]:
    """The k-word shingles of one long text, some at a time.

    The text is cut at white space, and each piece begins with the last k - 1 words of the one before.
    """
    limit = limit or PIECE
    carried, words_before, a = b"", 0, 0
    while a < len(raw):
        b = min(len(raw), a + limit)
        while b < len(raw) and not _SPACE[raw[b]]:
            ahead = np.flatnonzero(_SPACE[raw[b : b + limit]])
            b = b + int(ahead[0]) if len(ahead) else min(len(raw), b + limit)
        piece = np.frombuffer(carried + b" " + lower(raw[a:b]).tobytes(), np.uint8)
        tidy, s, e, _ = shingle_spans(piece, np.array([0, len(piece)]), k)
        a = b
        held = tidy.split()
        n = len(held)
        if n >= k:
            yield [tidy[i:j] for i, j in zip(s.tolist(), e.tolist())]
            words_before, held = k, held[n - k + 1 :]
        elif a == len(raw) and words_before < k and n:
            yield [b" ".join(held)]
        carried = b" ".join(held)


def _hashes(shingles: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))


def long_fingerprint(raw: np.ndarray, k: int) -> np.uint64:
    """The fingerprint of one long text: counts of set bits add up over its pieces."""
    count, total = np.zeros(64, np.int64), 0
    for shingles in long_shingles(raw, k):
        bits = np.unpackbits(_hashes(shingles).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        count += bits.sum(axis=0, dtype=np.int64)
        total += len(shingles)
    return np.packbits(2 * count > total).view(">u8").astype(np.uint64)[0]


def fingerprint_column(column: pa.Array, k: int) -> np.ndarray:
    """Signed 64-bit fingerprints of the texts of one batch."""
    out = np.zeros(len(column), np.uint64)
    offsets, data = column_bytes(column)
    for a, b in slices(offsets, 1 << 20):
        at = offsets[a : b + 1]
        if at[-1] - at[0] > 1 << 20:
            out[a] = long_fingerprint(data[at[0] : at[-1]], k)
            continue
        tidy, s, e, row = shingle_spans(lower(data[at[0] : at[-1]]), at - at[0], k)
        if not len(s):
            continue
        h = _hashes([tidy[i:j] for i, j in zip(s.tolist(), e.tolist())])
        head = np.flatnonzero(np.diff(row, prepend=-1))
        size = np.diff(np.append(head, len(row)))
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        majority = 2 * np.add.reduceat(bits, head, axis=0, dtype=np.int64) > size[:, None]
        out[a + row[head]] = np.packbits(majority, axis=1).reshape(-1, 8).copy().view(">u8").reshape(-1).astype(np.uint64)
    return out.view(np.int64)


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """``(doc_id, fp)``; fp is the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprint_column(batch.column(1), k))], names=["doc_id", "fp"])

    return doc_text(docs).mapInArrow(run, "doc_id long, fp long")


def unary_popcounts(fp: Column) -> Column:
    """The set bits of each segment of two bits, in unary form (00, 01 or 11)."""
    high = F.shiftrightunsigned(fp, 1)
    some, both = fp.bitwiseOR(high).bitwiseAND(F.lit(_ODD)), fp.bitwiseAND(high).bitwiseAND(F.lit(_ODD))
    return some.bitwiseOR(F.shiftleft(both, 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def grid_masks(radius: int) -> list[int]:
    """Bit masks of three whole groups each, out of radius + 3 groups of segments."""
    groups = radius + 3
    edges = [round(i * 32 / groups) for i in range(groups + 1)]
    masks = [((1 << 2 * (b - a)) - 1) << 2 * a for a, b in zip(edges, edges[1:])]
    return [_signed(sum(c)) for c in combinations(masks, 3)]


def links(nodes: DataFrame, radius: int = RADIUS, cap: int = CAP) -> DataFrame:
    """``(a, b)``: links between the distinct fingerprints ``nodes(fp)`` that connect all within ``radius`` bits.

    Pairs from small cells are exact; nodes in crowded cells are linked to the
    smallest node around each common value instead of to each other, which
    connects the same components (for a radius of 2 at most).
    """
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("g"), F.col("e").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(grid_masks(radius))])).alias("c")
    keyed = nodes.select("fp", unary_popcounts(F.col("fp")).alias("e")).select("fp", "e", cells).select("c.g", "c.cell", "fp", "e")
    # Counts come first: only small cells are gathered.
    sizes = keyed.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = written(sizes, "cells")
    small = keyed.join(sized.where(F.col("n") <= cap), ["g", "cell"]).groupBy("g", "cell").agg(F.sort_array(F.collect_list(F.struct("fp", "e"))).alias("all"))
    one = small.select("all", F.explode("all").alias("x"))
    pairs = one.select(F.col("x.fp").alias("a"), F.col("x.e").alias("e"), F.explode(F.filter("all", lambda y: y["fp"] > F.col("x.fp"))).alias("y")).where(
        (F.bit_count(F.col("e").bitwiseXOR(F.col("y.e"))) <= radius) & (F.bit_count(F.col("a").bitwiseXOR(F.col("y.fp"))) <= radius)
    )
    pairs = pairs.select("a", F.col("y.fp").alias("b"))
    crowded = keyed.join(sized.where(F.col("n") > cap), ["g", "cell"], "left_semi").select("fp").distinct()
    if radius > 2:
        raise ValueError("crowded cells are linked exactly for a radius of 2 at most")
    around = F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64 if radius == 2 else 0)])).alias("near")
    near = crowded.select("fp", around)
    # The smallest of a value's neighbours and the others: at most 65 rows a value.
    star = near.select("fp", F.min("fp").over(Window.partitionBy("near")).alias("low")).where("fp > low")
    return pairs.unionByName(star.select(F.col("low").alias("a"), F.col("fp").alias("b")))


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fp, component_id)``: the smallest ``doc_id`` reachable over links, for every document."""
    prints = written(fingerprints(docs, k), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "nodes")
    labels = components(links(nodes.select("fp"), radius))
    placed = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "doc_id", F.coalesce("label", "fp").alias("label"))
    placed = written(placed, "placed")
    lowest = placed.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = written(placed.join(lowest, "label").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def result(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
