"""Quartile bucket digest of a text, and neighbours in document order.

Byte triplets taken from a sliding window of five bytes are hashed into 256
buckets. A bucket's two-bit code says which quartile of all bucket counts its
own count falls in; the digest is the code string after a byte for the length
and a byte for the quartile ratios. Two digests differ by the sum of code
differences plus bounded terms for length and ratios; the score is capped, so
likeness is always in 0..1.

Defined results: a null text is the empty text; an empty text, or one with
less than three bytes, has a digest of empty buckets; equal texts have equal
digests; a text of any length is digested whole; counts equal to a quartile
belong to the lower code; rows that repeat a ``doc_id`` are ordered by text
(equal rows in any order); a null ``doc_id`` comes first. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_text, partitions

BUCKETS = 256
#: Differences from here on count as wholly unlike.
WORST = 320
#: Positions of each triplet in the window of five bytes, and its salt.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
_SALTS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1, 0xD6E8FEB9], np.uint32)
_WEIGHTS = np.array([64, 16, 4, 1], np.uint8)
SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def bucket_counts(data: np.ndarray) -> np.ndarray:
    """How many triplets of ``data`` (bytes) hash into each bucket."""
    n = len(data)
    total = np.zeros(BUCKETS, np.int64)
    if n < 3:
        return total
    wide = data.astype(np.uint32)
    for (a, b, c), salt in zip(TRIPLETS, _SALTS):
        m = n - c
        if m <= 0:
            continue
        key = wide[a : a + m] | (wide[b : b + m] << np.uint32(8)) | (wide[c : c + m] << np.uint32(16))
        key *= salt
        key ^= key >> np.uint32(15)
        key *= np.uint32(0x2C1B3C6D)
        total += np.bincount((key >> np.uint32(24)).astype(np.intp), minlength=BUCKETS)
    return total


def codes(data: np.ndarray) -> tuple[int, int, np.ndarray]:
    """``(length code, ratio code, bucket codes 0..3)``."""
    counts = bucket_counts(data)
    q1, q2, q3 = np.partition(counts, (63, 127, 191))[[63, 127, 191]]
    code = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    length = min(255, round(8 * math.log2(len(data) + 1)))
    ratios = (int(q1 * 15 // max(q3, 1)) << 4) | int(q2 * 15 // max(q3, 1))
    return length, ratios, code.astype(np.uint8)


def digest(parts: tuple[int, int, np.ndarray]) -> str:
    packed = (parts[2].reshape(-1, 4) * _WEIGHTS).sum(axis=1).astype(np.uint8)
    return f"{parts[0]:02x}{parts[1]:02x}{packed.tobytes().hex()}"


def parse(text: str) -> tuple[int, int, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex(text), np.uint8)
    return int(raw[0]), int(raw[1]), ((raw[2:, None] // _WEIGHTS) % 4).reshape(-1).astype(np.uint8)


def likeness(a: tuple[int, int, np.ndarray], b: tuple[int, int, np.ndarray]) -> float:
    """1 for equal digests, 0 for a difference of ``WORST`` or more."""
    apart = int(np.abs(a[2].astype(np.int16) - b[2]).sum())
    apart += min(16, max(0, abs(a[0] - b[0]) - 1))
    apart += min(15, abs((a[1] >> 4) - (b[1] >> 4)) + abs((a[1] & 15) - (b[1] & 15))) // 2
    return 1.0 - min(apart, WORST) / WORST


def edited(text: str, following: str) -> str:
    """The last quarter of ``text`` replaced by as much of the start of ``following``."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _in_order(batches):
    """Rows in (bucket, tail, doc_id) order; a tail row only follows its bucket's last row."""
    out: list[tuple] = []
    held = None  # (bucket, doc_id, text, codes)
    for batch in batches:
        buckets, tails, ids = (batch.column(i).to_pylist() for i in range(3))
        texts = batch.column(3)
        for i, (bucket, tail, doc) in enumerate(zip(buckets, tails, ids)):
            if held is not None and held[0] != bucket:
                held = None
            if tail and held is None:
                continue
            text = texts[i].as_py()
            own = codes(np.frombuffer(text.encode(), np.uint8))
            if held is not None:
                _, last, before, was = held
                new = edited(before, text)
                raw = new.encode()
                changed = codes(np.frombuffer(raw, np.uint8))
                out.append((last, len(before), hashlib.sha256(raw).hexdigest(), digest(was), digest(changed), likeness(was, changed), likeness(was, own)))
            held = None if tail else (bucket, doc, text, own)
        if len(out) >= 2000:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=list(names))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Digests of every document and its edited text, with likeness to the next document.

    Documents are cut into ranges of ``doc_id`` at approximate quantiles and
    each range is walked in order. The first document of a range is also sent
    to the range before it, so no task needs more than its own range and no
    global window is formed. Quantiles and first ids are one value a range.
    """
    spark = docs.sparkSession
    rows = doc_text(docs)
    n = max(2, partitions(spark))
    ids = rows.select(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).cast("double").alias("at"))
    cuts = ids.approxQuantile("at", [i / n for i in range(1, n)], 0.2 / n)
    splits = [float("-inf"), *(sorted(set(cuts)) or [0.0]), float("inf")]
    cut = Bucketizer(splits=splits, inputCol="at", outputCol="bucket")
    keyed = cut.transform(rows.withColumn("at", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).cast("double")))
    keyed = keyed.select(F.col("bucket").cast("int").alias("bucket"), "doc_id", "text")
    firsts = sorted((r[0], r[1]) for r in keyed.select("bucket", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k")).groupBy("bucket").agg(F.min("k")).collect())
    before = [(firsts[i][1], firsts[i - 1][0]) for i in range(len(firsts))]
    sent = F.broadcast(spark.createDataFrame(before, "k long, into int"))  # one row a range
    placed = (
        keyed.withColumn("k", F.coalesce("doc_id", F.lit(-(1 << 63))))
        .join(sent, "k", "left")
        .select(
            F.explode(
                F.when(F.col("into").isNull(), F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("tail")))).otherwise(
                    F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("tail")), F.struct(F.col("into").alias("bucket"), F.lit(1).alias("tail")))
                )
            ).alias("p"),
            "doc_id",
            "text",
        )
        .select("p.bucket", "p.tail", "doc_id", "text")
    )
    return placed.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "tail", F.col("doc_id").asc_nulls_first(), "text").mapInArrow(_in_order, SCHEMA)
