"""Prefix-free parsing: repeated 100-byte strings through phrases, their dictionary and the parse.

Every window of ``SPAN`` bytes picks a trigger in it: the position whose rolling
hash of ``GRAM`` bytes is smallest (the first of equals). Neighbouring windows
with one trigger form a phrase: the bytes that these windows cover. The choice
depends on the window's bytes alone, so equal windows lie in phrases with equal
triggers, at equal distance from them. The parse of a document is its sequence
of phrases; the dictionary has each distinct phrase.

* A trigger that occurs once in the corpus marks windows that occur once.
* If all phrases of a trigger are equal, only its first phrase, in the order of
  the corpus, is new: all windows of the others also start earlier.
* Otherwise each distinct phrase of the trigger enters the dictionary once, by
  its first occurrence. The suffixes of dictionary phrases are ranked by their
  first ``SPAN`` bytes; equal suffixes have equal ranks, and of one rank only
  the earliest start is new.

A phrase's first occurrence carries the parse order into the dictionary, so the
combined order tells for every start whether its string starts earlier.

Only the equality classes of the ranks and the earliest start of each are kept
(64-bit hashes of the strings): that is what removal needs of the order.

Defined results: a null text is the empty text; texts shorter than ``SPAN``
bytes lose nothing; a text of any length is cut whole, in one task, in memory of
about 90 bytes a byte of it; documents order by ``doc_id``, rows that repeat a
``doc_id`` by text (equal rows: one of them counts as first and the others
lose all that can be lost), a null ``doc_id`` first; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, doc_text, partitions, written
from .textops import column_bytes, mix, prefix_hash, slices, span_hash

SPAN = 100
#: Bytes of a trigger. Longer ones are shared less often by chance, so fewer phrases have to be ranked window by window.
GRAM = 40


def rolling(prefix: np.ndarray, n: int, k: int) -> np.ndarray:
    """Hashes of the ``k`` bytes from each of the first ``n`` positions."""
    at = np.arange(n)
    return span_hash(prefix, at, at + k)


def sliding_least(key: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` consecutive keys."""
    n = len(key)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def parse(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(row, start in row, windows, trigger hash, phrase hash)`` of the phrases of some texts."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < SPAN:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefix = prefix_hash(data)
    grams = rolling(prefix, n - GRAM + 1, GRAM)
    key = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    trigger = (sliding_least(key, SPAN - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    m = len(trigger)
    valid = np.ones(m + 1, bool)
    valid[m] = False
    # Windows that would cross into the next text don't exist.
    ends = offsets[1:-1]
    cross = (ends[:, None] - np.arange(1, SPAN)).reshape(-1)
    valid[cross[(cross >= 0) & (cross < m)]] = False
    change = np.ones(m, bool)
    change[1:] = (trigger[1:] != trigger[:-1]) | ~valid[: m - 1]
    start = np.flatnonzero(change & valid[:m])
    stop = change | ~valid[:m]
    bounds = np.append(np.flatnonzero(stop), m)
    end = bounds[np.searchsorted(bounds, start, side="right")]
    row = np.searchsorted(offsets, start, side="right") - 1
    return row, start - offsets[row], end - start, grams[trigger[start]], span_hash(prefix, start, end + SPAN - 1)


def _again(row: np.ndarray, trigger: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Which phrases have an equal one before them in their own text (rows are in order)."""
    key = mix(trigger ^ mix(phrase ^ mix(row.astype(np.uint64))))
    out = np.ones(len(key), bool)
    out[np.unique(key, return_index=True)[1]] = False
    return out


PHRASES = "uid long, s int, m int, again boolean, a long, p long"


def _phrases(batches):
    for batch in batches:
        uid = batch.column(0).to_numpy()
        offsets, data = column_bytes(batch.column(1))
        for x, y in slices(offsets, 1 << 20):
            row, s, m, a, p = parse(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
            arrays = [uid[x:y][row], s.astype(np.int32), m.astype(np.int32), _again(row, a, p), a.view(np.int64), p.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in arrays], names=["uid", "s", "m", "again", "a", "p"])


def _lists(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets and fields of a list-of-structs column; a null list is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), [f.to_numpy(zero_copy_only=False) for f in flat.flatten()]


def _windows(batches):
    """The distinct windows of each text's dictionary phrases, at their first start in it."""
    for batch in batches:
        uid = batch.column(0).to_numpy()
        offsets, data = column_bytes(batch.column(1))
        at, (s, m) = _lists(batch.column(2))
        for x, y in slices(offsets, 1 << 20):
            prefix = prefix_hash(data[offsets[x] : offsets[y]])
            own_s, own_m = s[at[x] : at[y]].astype(np.int64), m[at[x] : at[y]].astype(np.int64)
            row = np.repeat(np.arange(x, y), np.diff(at[x : y + 1]))
            whose = np.repeat(row, own_m)
            start = np.repeat(own_s - (np.cumsum(own_m) - own_m), own_m) + np.arange(int(own_m.sum()))
            begin = offsets[whose] - offsets[x] + start
            w = span_hash(prefix, begin, begin + SPAN)
            order = np.lexsort((start, whose))
            key = mix(w ^ mix(whose.astype(np.uint64)))[order]
            first = order[np.unique(key, return_index=True)[1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(w[first].view(np.int64)), pa.array(uid[whose[first]]), pa.array(start[first].astype(np.int32))], names=["w", "uid", "s"]
            )


WHOLE, ENTRY, NEW = 0, 1, 2


def covered(size: int, s: np.ndarray, m: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Which bytes of a text lie in a string that starts earlier too."""
    starts = np.zeros(size + 1, np.int64)
    for k in (WHOLE, ENTRY):
        np.add.at(starts, s[kind == k], 1)
        np.add.at(starts, s[kind == k] + m[kind == k], -1)
    again = np.cumsum(starts)[:size] > 0
    again[s[kind == NEW]] = False
    edge = np.zeros(size + 1, np.int64)
    begin = np.flatnonzero(again)
    edge[begin] = 1
    edge[begin + SPAN] -= 1  # no two starts share an end, and none reaches beyond the text
    return np.cumsum(edge)[:size] > 0


def _kept(batches):
    for batch in batches:
        offsets, data = column_bytes(batch.column(1))
        at, (s, m, kind) = _lists(batch.column(2))
        rows = []
        for i in range(len(batch)):
            raw = data[offsets[i] : offsets[i + 1]]
            a, b = at[i], at[i + 1]
            if a == b:
                rows.append((len(raw), 0, 0, hashlib.sha256(raw.tobytes()).hexdigest()))
                continue
            gone = covered(len(raw), s[a:b].astype(np.int64), m[a:b].astype(np.int64), kind[a:b])
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
            rows.append((len(raw), int(gone.sum()), spans, hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
        n, removed, spans, sha = zip(*rows) if rows else ((),) * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def numbered(docs: DataFrame) -> DataFrame:
    """``(uid, doc_id, text)``; uid is unique and ordered as the documents are.

    It is the ``doc_id`` itself unless some repeat or are null; then the rows are
    sorted by ranges and numbered in that order.
    """
    rows = doc_text(docs)
    if not rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").limit(1).count():
        return rows.select(F.col("doc_id").alias("uid"), "doc_id", "text")
    n = partitions(docs.sparkSession)
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.col("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return written(ordered.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text"), "numbered")


def repeated(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows, marks)``: the numbered documents, and ``(uid, s, m, kind)`` of what repeats in them.

    ``WHOLE``: ``m`` starts from ``s`` on, all repeated. ``ENTRY``: starts of a dictionary phrase, repeated but for
    those that a ``NEW`` row names.
    """
    rows = numbered(docs)
    text = rows.select("uid", "text")
    phrases = text.mapInArrow(_phrases, PHRASES)
    triggers = phrases.groupBy("a").agg(F.count(F.lit(1)).alias("n"), (F.min("p") != F.max("p")).alias("several"), F.min("uid").alias("first"))
    triggers = written(triggers.where("n > 1").select("a", "several", "first"), "triggers")
    seen = phrases.join(triggers, "a").select("uid", "s", "m", "again", "several", "first", F.when(F.col("several"), F.col("a")).alias("a"), F.when(F.col("several"), F.col("p")).alias("p"))
    seen = written(seen, "phrases")
    discard(triggers)
    single = seen.where("NOT several AND (again OR uid <> first)").select("uid", "s", "m", F.lit(WHOLE).alias("kind"))
    several = seen.where("several").select("uid", "s", "m", "again", "a", "p")
    dictionary = written(several.groupBy("a", "p").agg(F.min("uid").alias("first")), "dictionary")
    placed = several.join(dictionary, ["a", "p"]).select("uid", "s", "m", F.when(F.expr("again OR uid <> first"), WHOLE).otherwise(ENTRY).alias("kind"))
    marks = written(single.unionByName(placed), "marks")
    discard(seen, dictionary)
    entries = marks.where(F.col("kind") == ENTRY).groupBy("uid").agg(F.collect_list(F.struct("s", "m")).alias("entries"))
    ranked = text.join(entries, "uid").select("uid", "text", "entries").mapInArrow(_windows, "w long, uid long, s int")
    new = ranked.groupBy("w").agg(F.min("uid").alias("uid"), F.min_by("s", "uid").alias("s")).select("uid", "s", F.lit(1).alias("m"), F.lit(NEW).alias("kind"))
    return rows, marks.unionByName(written(new, "new"))


def result(docs: DataFrame) -> DataFrame:
    rows, marks = repeated(docs)
    listed = marks.groupBy("uid").agg(F.collect_list(F.struct("s", "m", "kind")).alias("marks"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return rows.join(listed, "uid", "left").select("doc_id", "text", "marks").mapInArrow(_kept, schema)
