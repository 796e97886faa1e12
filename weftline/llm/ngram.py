"""Interpolated modified Kneser-Ney bigram model in sorted, memory-mapped hash arrays.

Counting: each task hashes its tokens, adds up its own bigrams and sends them as
packed arrays, cut by the top bits of the bigram hash. A hash spreads every
context, so no frequent word gathers in one task. Each bucket is merged into a
file of sorted hashes and counts; what it says about single words (how often,
after how many words, before how many) is sent on and merged likewise by word
hash. There are as many buckets as the counted bytes of the corpus ask for, and
a task decodes and merges one bucket at a time, so its memory doesn't grow with
the corpus. Workers map one file at a time and look up sorted queries.

Folder: a shared POSIX folder. Files are written under a temporary name and
renamed, so a task that runs again replaces its own files.

Tokens are runs without ASCII white space, ASCII letters in lower case, then one
end per text. With ``c`` a count and ``D`` its discount::

    P(v|u) = max(c(uv) - D, 0) / c(u.) + left(u) * P(v)
    P(v)   = max(n(.v) - D', 0) / n(..) + left' / (V + 1)

``n(.v)`` counts the distinct words before v; what the discounts leave goes to
the lower order, at last to V known tokens and one unknown.

Defined results: a null text is the empty text, one end; with nothing to learn
from every token is unknown; a null ``doc_id`` is hashed as the empty text for
the fold; repeated rows count and are scored each time; a text of any length is
counted and scored whole, its parts in slices of whole texts; nothing is chosen
by order, so ties can't occur; an empty table gives an empty result; other
columns are ignored. Equal 64-bit hashes are taken as equal tokens.
"""

from __future__ import annotations

import os
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_text, fold, local_path, new_path, partitions, write
from .textops import column_bytes, lower, mix, prefix_hash, slices, span_hash, words

END = np.uint64(0x454E44)
BEGIN = np.uint64(0x424547)
#: Distinct bigrams that a task gathers before it sends their sums, and buckets in one batch of them.
FLUSH = 2_000_000
BATCH_BUCKETS = 8
#: Text of one bucket of bigrams (bytes), and of one slice of texts.
BUCKET_BYTES = 8 << 20
SLICE = 1 << 20
SMOOTH = 0.1


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers by byte planes: the high bytes of small numbers compress away."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def token_stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, row)`` of every token, each row's end included."""
    low = lower(data)
    s, e, row = words(low, offsets)
    n = len(offsets) - 1
    count = np.bincount(row, minlength=n)
    at = np.arange(len(row)) + row
    hashes = np.full(len(row) + n, END, np.uint64)
    hashes[at] = span_hash(prefix_hash(low), s, e)
    return hashes, np.repeat(np.arange(n), count + 1)


def contexts(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    out = np.full(len(hashes), BEGIN, np.uint64)
    same = row[1:] == row[:-1]
    out[1:][same] = hashes[:-1][same]
    return out


def pair_hash(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mix(mix(u + np.uint64(0x9E3779B97F4A7C15)) ^ (v * np.uint64(0xD6E8FEB86659FD93)))


def _reduce(key: np.ndarray, *sums: np.ndarray) -> tuple:
    """Sorted distinct keys, the place of one row each, and the sums by key."""
    order = np.argsort(key)
    key = key[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return (key[head], order[head], *(np.add.reduceat(x[order], head) if len(key) else x for x in sums))


def _cut(key: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """``(bucket, from, to)`` of sorted hashes by their top bits."""
    bucket = (key >> np.uint64(64 - bits)).astype(np.int64)
    head = np.flatnonzero(np.diff(bucket, prepend=-1))
    return list(zip(bucket[head].tolist(), head.tolist(), [*head[1:].tolist(), len(key)]))


PARTS = "bucket int, a binary, b binary, c binary, d binary, e binary"
_NAMES = ["bucket", "a", "b", "c", "d", "e"]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if i == 0 else pa.binary()) for i, x in enumerate(zip(*rows))], names=_NAMES)


def _gather(bits: int):
    def flush(parts):
        u, v, n = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        key, at, n = _reduce(pair_hash(u, v), n)
        u, v = u[at], v[at]
        del at
        rows = []
        for bucket, a, b in _cut(key, bits):
            order = np.argsort(u[a:b])
            after, place = np.unique(v[a:b][order], return_inverse=True)
            rows.append((bucket, pack_sorted(u[a:b][order]), pack_sorted(after), pack(place), pack(n[a:b][order]), b""))
            if len(rows) >= BATCH_BUCKETS:
                yield _rows(rows)
                rows = []
        if rows:
            yield _rows(rows)

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            offsets, data = column_bytes(batch.column(0))
            for a, b in slices(offsets, SLICE):
                h, row = token_stream(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                u = contexts(h, row)
                _, at, n = _reduce(pair_hash(u, h), np.ones(len(u), np.uint32))
                parts.append((u[at], h[at], n))
                held += len(n)
                if held >= FLUSH:
                    yield from flush(parts)
                    parts, held = [], 0
        if held:
            yield from flush(parts)

    return run


def _by_bucket(batches, decode):
    """``(bucket, arrays)`` of rows in bucket order: each row is decoded as it comes, and a bucket's arrays are joined."""
    held, parts = None, []

    def joined():
        return held, [np.concatenate(x) for x in zip(*parts)]

    for batch in batches:
        buckets = batch.column(0).to_pylist()
        for i, bucket in enumerate(buckets):
            if bucket != held and parts:
                yield joined()
                parts.clear()
            held = bucket
            parts.append(decode(*(batch.column(c)[i].as_py() for c in range(1, 6))))
    if parts:
        yield joined()


def _save(path: str, *arrays: np.ndarray) -> None:
    """Arrays one after another behind a line of their types and lengths; the name appears when all is written."""
    from pyspark import TaskContext

    held = f"{path}.{TaskContext.get().taskAttemptId()}"
    with open(held, "wb") as f:
        f.write(",".join(f"{a.dtype.str}:{len(a)}" for a in arrays).encode().ljust(256))
        for a in arrays:
            f.write(a.tobytes())
    os.replace(held, path)


def _load(path: str) -> list[np.ndarray]:
    whole = np.memmap(path, np.uint8, "r")
    out, at = [], 256
    for spec in whole[:256].tobytes().decode().strip().split(","):
        kind, n = spec.rsplit(":", 1)
        size = np.dtype(kind).itemsize * int(n)
        out.append(whole[at : at + size].view(kind))
        at += size
    return out


def _counts_of(n: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(n, 5).astype(np.int64), minlength=6)[1:5]


def _merge_bigrams(folder: str, word_bits: int):
    def decode(u, after, place, n, _):
        return unpack_sorted(u), unpack_sorted(after)[unpack(place)], unpack(n).astype(np.int64)

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for bucket, (u, v, n) in _by_bucket(batches, decode):
            key, at, n = _reduce(pair_hash(u, v), n)
            u, v = u[at], v[at]
            large = np.flatnonzero(n > 254)
            _save(f"{folder}/pairs-{bucket:08d}.bin", key, np.minimum(n, 255).astype(np.uint8), large.astype(np.uint32), n[large].astype(np.uint64))
            del key, at
            rows = []
            word, _, total, one, two, more = _reduce(u, n, (n == 1).astype(np.int64), (n == 2).astype(np.int64), (n > 2).astype(np.int64))
            for w, a, b in _cut(word, word_bits):
                rows.append((w, pack_sorted(word[a:b]), pack(total[a:b]), pack(one[a:b]), pack(two[a:b]), pack(more[a:b])))
            word, _, total, before = _reduce(v, n, np.ones(len(n), np.int64))
            for w, a, b in _cut(word, word_bits):
                rows.append((w, pack_sorted(word[a:b]), pack(total[a:b]), pack(before[a:b]), b"", b""))
            rows.append((-1, b"", pack(np.array([*_counts_of(n), len(n), n.sum()], np.uint64)), b"", b"", b""))
            yield _rows(rows)

    return run


def _merge_words(folder: str):
    def decode(word, total, first, second, third):
        """Count, words before, and as a context: total and how many follow once, twice, more often."""
        word, total, first = unpack_sorted(word), unpack(total).astype(np.int64), unpack(first).astype(np.int64)
        zero = np.zeros(len(word), np.int64)
        if second:
            return word, zero, zero, total, first, unpack(second).astype(np.int64), unpack(third).astype(np.int64)
        return word, total, first, zero, zero, zero, zero

    def run(batches):
        for bucket, (word, *columns) in _by_bucket(batches, decode):
            key, _, count, before, total, one, two, more = _reduce(word, *columns)
            _save(f"{folder}/words-{bucket:08d}.bin", key, *(x.astype(np.uint64 if x.max(initial=0) >> 32 else np.uint32) for x in (count, before, total, one, two, more)))
            known = before > 0
            sums = [*_counts_of(before[known]), int((before[known] > 2).sum()), int(known.sum()), int(before.sum())]
            yield _rows([(bucket, b"", pack(np.array(sums, np.uint64)), b"", b"", b"")])

    return run


def discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and more, from how many have counts 1 to 4."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.0
    d = [i - (i + 1) * y * b / a if a else 0.0 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.array([0.0, *(min(max(x, 0.0), float(i)) for i, x in enumerate(d, 1))])


class Model:
    """Where the files are and a few totals; workers map a file for the queries of one slice and let it go."""

    def __init__(self, folder: str, bits: int, pair_stats: list[int], word_stats: list[int]):
        self.folder, self.bits = folder, bits
        *pairs, self.pairs, self.tokens = pair_stats
        self.d = discounts(pairs)
        *befores, more, self.vocabulary, self.befores = word_stats
        self.d1 = discounts(befores)
        left = self.d1[1] * befores[0] + self.d1[2] * befores[1] + self.d1[3] * more
        self.left1 = left / self.befores if self.befores else 1.0

    def _find(self, name: str, key: np.ndarray):
        """``(arrays, place, found)`` pieces of sorted distinct hashes, bucket by bucket."""
        for bucket, a, b in _cut(key, self.bits):
            path = f"{self.folder}/{name}-{bucket:08d}.bin"
            arrays = _load(path) if os.path.exists(path) else None
            if arrays is None or not len(arrays[0]):
                continue
            place = np.minimum(np.searchsorted(arrays[0], key[a:b]), len(arrays[0]) - 1)
            hit = arrays[0][place] == key[a:b]
            yield arrays, place[hit], a + np.flatnonzero(hit)

    def words(self, key: np.ndarray) -> list[np.ndarray]:
        """Count, words before, and as context: total and how many follow once, twice, more often."""
        out = [np.zeros(len(key), np.int64) for _ in range(6)]
        for arrays, place, to in self._find("words", key):
            for x, y in zip(out, arrays[1:]):
                x[to] = y[place]
        return out

    def pair_counts(self, key: np.ndarray) -> np.ndarray:
        out = np.zeros(len(key), np.int64)
        for arrays, place, to in self._find("pairs", key):
            n = arrays[1][place].astype(np.int64)
            if (big := n == 255).any():
                n[big] = arrays[3][np.searchsorted(arrays[2], place[big])]
            out[to] = n
        return out

    def batch(self, hashes: np.ndarray, row: np.ndarray, rows: int) -> list[np.ndarray]:
        """Per row: tokens, known tokens, base score and model score."""
        u = contexts(hashes, row)
        key, inverse = np.unique(np.concatenate([hashes, u]), return_inverse=True)
        count, before, total, one, two, more = self.words(key)
        own, context = inverse[: len(hashes)], inverse[len(hashes) :]
        lower_order = np.maximum(before - self.d1[np.minimum(before, 3)], 0) / max(self.befores, 1) + self.left1 / (self.vocabulary + 1)
        left = np.where(total > 0, (self.d[1] * one + self.d[2] * two + self.d[3] * more) / np.maximum(total, 1), 1.0)
        pair, at = np.unique(pair_hash(u, hashes), return_inverse=True)
        c = self.pair_counts(pair)[at]
        high = np.maximum(c - self.d[np.minimum(c, 3)], 0) / np.maximum(total[context], 1)
        p = high + left[context] * lower_order[own]
        c1 = count[own]
        base = np.log10((c1 + SMOOTH) / (self.tokens + SMOOTH * (self.vocabulary + 1)))
        add = lambda x=None: np.bincount(row, x, minlength=rows)
        return [add(), add((c1 > 0).astype(float)).astype(np.int64), add(base), add(np.log10(np.maximum(p, 1e-300)))]


def train(docs: DataFrame, folder: str | None = None, bucket_bytes: int = BUCKET_BYTES) -> Model:
    """Counts all texts of ``docs`` into files of ``folder`` (a new one in the shared folder unless given)."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "ngrams")
    files = local_path(folder)
    n = partitions(spark)
    text = doc_text(docs).select("text")
    size = text.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = max(3, (size // bucket_bytes).bit_length())
    own = F.pmod(F.col("bucket"), F.lit(n)).cast("int")  # buckets in turn, so tasks get equally many
    counted = text.mapInArrow(_gather(bits), PARTS)
    merged = counted.repartitionById(n, own).sortWithinPartitions("bucket").mapInArrow(_merge_bigrams(files, bits), PARTS)
    write(merged, f"{folder}/sent")
    sent = spark.read.schema(PARTS).parquet(f"{folder}/sent")
    pair_stats = _totals(sent.where("bucket = -1"), 6)
    by_word = sent.where("bucket >= 0").repartitionById(n, own).sortWithinPartitions("bucket").mapInArrow(_merge_words(files), PARTS)
    write(by_word, f"{folder}/totals")
    word_stats = _totals(spark.read.schema(PARTS).parquet(f"{folder}/totals"), 7)
    return Model(files, bits, pair_stats, word_stats)


def _totals(rows: DataFrame, n: int) -> list[int]:
    """Sums of the few numbers that each bucket reports; one row a task comes to the driver."""

    def add(batches):
        total = np.zeros(n, np.uint64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += unpack(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.int64)], pa.list_(pa.int64()))], names=["sums"])

    found = [r[0] for r in rows.select("b").mapInArrow(add, "sums array<long>").collect()]
    return np.sum(found, axis=0).tolist() if found else [0] * n


def score(docs: DataFrame, model: Model) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)  # totals and a path

    def run(batches):
        for batch in batches:
            offsets, data = column_bytes(batch.column(1))
            out: list[list] = [[], [], [], []]
            for a, b in slices(offsets, 2 * SLICE):
                h, row = token_stream(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for x, y in zip(out, held.value.batch(h, row, b - a)):
                    x.append(y)
            if out[0]:
                n, known, base, whole = (np.concatenate(x) for x in out)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(known), pa.array(base), pa.array(whole)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return doc_text(docs).mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def result(docs: DataFrame) -> DataFrame:
    model = train(docs.where(fold(10) != 0))
    return score(docs, model).select(
        "doc_id", (fold(10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
