"""Vector codes from one codebook a part, by Lloyd rounds over cover trees.

Vectors are cut into equal parts. Rows are gathered in blocks, and each block
has a cover tree for each part position: a node's children are points of it that
lie more than half its radius apart, and each takes the points within that half.
The points of a subtree are a range of the block's order, so cumulative sums give
the sum of any subtree. Blocks with their trees are written once; a round sends
the codebooks (some kilobytes, whatever the number of rows) to all tasks and gets
sums and counts a codebook entry back. A subtree belongs to an entry as a whole if
that entry is nearer to its centre than any other by more than twice its radius;
else its children are looked at, and of small ambiguous nodes each point is
compared exactly, in whole numbers.

Defined results: rows whose vector is null or holds null or non-finite entries
are dropped; shorter vectors are filled up with zeros to the longest; a length that
the parts don't divide, and entries beyond 2**29 after scaling, are errors. Codebooks
start from the rows with the smallest ids (ties of ids in the order of their vectors,
null ids last); of fewer rows than entries all are taken. Equal distances go to the
lower index, so equal entries leave the higher one unused, and it stays. Rows that
repeat get equal codes; null labels are one group. An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_or_shuffled, written
from .vectors import entries, matrix, whole, width

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows of a block, and points of a node that isn't split further.
BLOCK, BUCKET = 4096, 8
LARGEST = 1 << 29
NODE = np.dtype([("start", "i4"), ("end", "i4"), ("child", "i4"), ("last", "i4"), ("centre", "i4"), ("radius", "f8")])


def cover_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(order, nodes)``: node k has the points ``order[start:end]`` and the child nodes ``child`` to ``last``, none if these are equal."""
    order, nodes, queue = np.arange(len(points)), [], deque()

    def add(start, end, centre, d2):
        queue.append(len(nodes))
        nodes.append([start, end, 0, 0, centre, float(np.sqrt(d2.max()))])

    gap = lambda rows, centre: ((points[rows] - points[centre]) ** 2).sum(axis=1)
    if len(points):
        add(0, len(points), 0, gap(order, 0))
    while queue:
        at = queue.popleft()
        start, end, _, _, centre, radius = nodes[at]
        if end - start <= BUCKET or radius == 0:
            continue
        rest, place, most = order[start:end].copy(), start, (radius / 2) ** 2
        nodes[at][2] = len(nodes)
        while len(rest):
            d2 = gap(rest, centre)
            near = d2 <= most
            own = rest[near]
            order[place : place + len(own)] = own
            add(place, place + len(own), centre, d2[near])
            place, rest = place + len(own), rest[~near]
            centre = rest[0] if len(rest) else 0
        nodes[at][3] = len(nodes)
    return order.astype(np.int32), np.array([tuple(x) for x in nodes], NODE)


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each point's nearest entry (ties: the lower) and all squared distances, exactly."""
    d2 = ((points[:, None, :] - book[None]) ** 2).sum(axis=2)
    return d2.argmin(axis=1), d2


def assigned(points: np.ndarray, order: np.ndarray, nodes: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, entry)``: ranges of ``order`` that belong to an entry as a whole; they cover all points."""
    found, front = [], np.arange(min(1, len(nodes)))
    while len(front):
        here = nodes[front]
        best, d2 = nearest(points[here["centre"]], book)
        d = np.sqrt(d2.astype(float))
        first = d[np.arange(len(front)), best].copy()
        d[np.arange(len(front)), best] = np.inf
        sure = (here["radius"] == 0) | (first + 2 * here["radius"] + 1e-6 < d.min(axis=1) * (1 - 1e-12))
        found.append((here["start"][sure], here["end"][sure], best[sure]))
        open_ = here[~sure]
        leaf = open_["child"] == open_["last"]
        if leaf.any():
            single = _ranges(open_["start"][leaf], open_["end"][leaf])
            found.append((single, single + 1, nearest(points[order[single]], book)[0]))
        front = _ranges(open_["child"][~leaf], open_["last"][~leaf])
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate([np.asarray(f[k], np.int64) for f in found]) for k in range(3))


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges ``[start, end)``, one range after another."""
    size = (end - start).astype(np.int64)
    begin = np.cumsum(size) - size
    return np.repeat(start.astype(np.int64) - begin, size) + np.arange(size.sum())


def block_totals(points: np.ndarray, order: np.ndarray, nodes: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(sums, counts)`` of the points of each entry, from cumulative sums over the tree's order."""
    start, end, entry = assigned(points, order, nodes, book)
    run = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points[order], axis=0)])
    sums, counts = np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)
    np.add.at(sums, entry, run[end] - run[start])
    np.add.at(counts, entry, end - start)
    return sums, counts


def block_codes(points: np.ndarray, order: np.ndarray, nodes: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(entry, squared distance)`` of each point."""
    start, end, entry = assigned(points, order, nodes, book)
    out = np.zeros(len(points), np.int64)
    out[order[_ranges(start, end)]] = np.repeat(entry, end - start)
    return out, ((points - book[out]) ** 2).sum(axis=1)


def blocks(rows: DataFrame, d: int, parts: int, scale: int) -> DataFrame:
    """``(ids, labels, points, orders, trees)``: blocks of ``(vec_id, label, embedding)`` with a tree for each part."""
    w = d // parts

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                x = np.floor(matrix(part.column(2), d) * scale)
                if x.size and np.abs(x).max() > LARGEST:
                    raise ValueError(f"entries beyond {LARGEST / scale:g} don't fit the whole numbers of the codes")
                x = x.astype(np.int64)
                trees = [cover_tree(x[:, k * w : (k + 1) * w]) for k in range(parts)]
                one = lambda column: pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
                yield pa.RecordBatch.from_arrays(
                    [one(part.column(0)), one(part.column(1)), pa.array([x.astype(np.int32).tobytes()], pa.binary()), pa.array([[o.tobytes() for o, _ in trees]], pa.list_(pa.binary())), pa.array([[n.tobytes() for _, n in trees]], pa.list_(pa.binary()))],
                    names=["ids", "labels", "points", "orders", "trees"],
                )

    return rows.mapInArrow(run, "ids array<long>, labels array<string>, points binary, orders array<binary>, trees array<binary>")


def _each(batches, d: int, parts: int):
    """``(ids, labels, [(points, order, nodes) a part])`` of every block."""
    w = d // parts
    for batch in batches:
        for r in range(batch.num_rows):
            x = np.frombuffer(batch["points"][r].as_py(), np.int32).reshape(-1, d).astype(np.int64)
            trees = zip(batch["orders"][r].as_py(), batch["trees"][r].as_py())
            yield batch["ids"][r].values, batch["labels"][r].values, [(x[:, k * w : (k + 1) * w], np.frombuffer(o, np.int32), np.frombuffer(n, NODE)) for k, (o, n) in enumerate(trees)]


def refined(held: DataFrame, books: np.ndarray, d: int) -> np.ndarray:
    """The codebooks (part, entry, position) after one Lloyd round."""
    parts, k, w = books.shape

    def run(batches):
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for _, _, trees in _each(batches, d, parts):
            for p, tree in enumerate(trees):
                s, n = block_totals(*tree, books[p])
                sums[p] += s
                counts[p] += n
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(list(sums[p, e]), pa.list_(pa.int64())), pa.array(counts[p, e])], names=["part", "entry", "sums", "n"])

    totals = held.mapInArrow(run, "part int, entry int, sums array<long>, n long").groupBy("part", "entry").agg(*[F.sum(F.element_at("sums", i + 1)).alias(f"s{i}") for i in range(w)], F.sum("n").alias("n"))
    out = books.copy()
    for row in totals.collect():  # at most one row an entry
        out[row["part"], row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(w)]
    return out


def codes(vectors: DataFrame, parts: int = PARTS, size: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """``(rows, codebooks)``: rows ``(vec_id, label, code, error)``; code has one index a part, as an array."""
    rows = vectors.where(whole()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), entries().alias("embedding"))
    d = width(rows)
    if d % parts:
        raise ValueError(f"{parts} parts don't divide vectors of {d} entries")
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").select("embedding").limit(size).collect()
    w = d // parts
    start = np.array([list(r[0]) + [0.0] * (d - len(r[0])) for r in first], float).reshape(len(first), d)
    if start.size and np.abs(start * scale).max() > LARGEST:
        raise ValueError(f"entries beyond {LARGEST / scale:g} don't fit the whole numbers of the codes")
    books = np.ascontiguousarray(np.floor(start * scale).astype(np.int64).reshape(len(first), parts, w).transpose(1, 0, 2))
    held = written(blocks(rows, d, parts, scale), "trees")
    if len(first):
        for _ in range(rounds):
            books = refined(held, books, d)

    def run(batches):
        for ids, labels, trees in _each(batches, d, parts):
            found = [block_codes(*tree, books[p]) for p, tree in enumerate(trees)]
            index = np.stack([f[0] for f in found], axis=1)
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(list(index.astype(np.int32)), pa.list_(pa.int32())), pa.array(sum(f[1] for f in found))], names=["vec_id", "label", "code", "error"])

    return held.mapInArrow(run, "vec_id long, label string, code array<int>, error long"), books


def result(vectors: DataFrame) -> DataFrame:
    rows, books = codes(vectors)
    rows = written(rows, "codes")
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    totals = small_or_shuffled(rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    text = F.array_join(F.transform("code", lambda x: F.lower(F.lpad(F.hex(x), 2, "0"))), "")
    joined = rows.join(totals, F.col("label").eqNullSafe(F.col("_label")), "left")
    return joined.select("vec_id", text.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _assign_sql(points: str, book: str) -> str:
    """Every point with its nearest entry and squared distance, in SQL."""
    return f"""SELECT vec_id, part, any_value(x) AS x, min(struct_pack(d := d, entry := entry)) AS best FROM (
    SELECT p.vec_id, p.part, p.x, b.entry, list_sum(list_transform(list_zip(p.x, b.y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM {points} p JOIN {book} b ON b.part = p.part) GROUP BY vec_id, part"""


def _refine_sql(found: str, book: str) -> str:
    return f"""SELECT b.part, b.entry, coalesce(m.y, b.y) AS y FROM {book} b LEFT JOIN (
    SELECT part, entry, list(v ORDER BY pos) AS y FROM (
      SELECT part, best.entry AS entry, pos, CAST(floor(sum(x[pos]) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS v FROM {found}, (SELECT unnest(range(1, 5)) AS pos) GROUP BY 1, 2, 3) GROUP BY 1, 2
  ) m ON m.part = b.part AND m.entry = b.entry"""


#: The same result in DuckDB, for vectors of 64 entries and ids that don't repeat: every part compared with every entry.
SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), points AS (SELECT vec_id, part, x[4 * part + 1 : 4 * part + 4] AS x FROM kept, (SELECT unnest(range({PARTS})) AS part)),
firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {ENTRIES}),
book0 AS (SELECT part, entry, x AS y FROM points JOIN firsts USING (vec_id)),
near0 AS MATERIALIZED ({_assign_sql("points", "book0")}),
book1 AS MATERIALIZED ({_refine_sql("near0", "book0")}),
near1 AS MATERIALIZED ({_assign_sql("points", "book1")}),
book2 AS MATERIALIZED ({_refine_sql("near1", "book1")}),
near2 AS MATERIALIZED ({_assign_sql("points", "book2")}),
digest AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) AS h FROM book2),
own AS (SELECT vec_id, string_agg(lower(lpad(to_hex(best.entry), 2, '0')), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near2 GROUP BY vec_id),
every AS (SELECT own.*, label FROM own JOIN kept USING (vec_id))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT h FROM digest) AS codebooks_sha256 FROM every
"""
