"""Quality classifier: linear hinge loss on n-grams scaled by class log-count ratios.

A document's features are indicators of its token unigrams and bigrams, hashed
to a fixed number of slots; tokens are runs of letters and digits, or runs of
other signs, with ASCII letters in lower case. The log-count ratio of a slot
compares how many good and bad labelled documents have it, counted over all
labelled training rows. Indicators are multiplied by these ratios, scaled to
unit length, and a linear model with squared hinge loss is fitted by dual
coordinate descent on a bounded sample of labelled rows: of each class
``SAMPLE_ROWS / 2`` different texts at most, those of ``SAMPLE_CHARS`` characters
or less first (in the order of a hash), then the shortest of the others, as far
as ``SAMPLE_CHARS`` for each row allow in total, but at least one.

Defined results: a null or empty text has no features and gets the score of
the intercept alone; a text of any length is scored whole; a null label is no
label; of several labels for one document the largest counts; a document row
that repeats is scored each time; a score of exactly 0.5 counts as good; with no
labelled rows of both classes every score is near 1 or 0 by the class seen (0.5
with none). Other columns are ignored, or stay in ``score``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, doc_text, fold, small_or_shuffled
from .textops import column_bytes, giving_back, lower, mix, prefix_hash, runs, slices, span_hash

BITS = 18
#: The sample for the linear fit: so many labelled documents at most, of so many characters each on average at most.
SAMPLE_ROWS = 6000
SAMPLE_CHARS = 12_000
_SLOTS = 1 << BITS
_ALNUM = np.zeros(256, bool)
_ALNUM[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, row)`` of the tokens in order."""
    kind = np.where(_SPACE[data], 0, np.where(_ALNUM[data], 1, 2)).astype(np.uint8)
    if not len(kind):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    begins = np.ones(len(kind), bool)
    begins[1:] = kind[1:] != kind[:-1]
    begins[offsets[offsets < len(kind)]] = True
    edge = np.flatnonzero(begins)
    end = np.append(edge[1:], len(kind))
    keep = kind[edge] > 0
    start, end = edge[keep], end[keep]
    return span_hash(prefix_hash(data), start, end), np.searchsorted(offsets, start, side="right") - 1


def features(column: pa.Array):
    """Yields ``(first row, rows, row of each feature, slot)`` by slices; a row's slots are distinct and sorted."""
    offsets, data = column_bytes(column)
    for a, b in slices(offsets):
        at = offsets[a : b + 1]
        h, row = tokens(lower(data[at[0] : at[-1]]), at - at[0])
        same = row[1:] == row[:-1]
        pair = mix(h[:-1] * np.uint64(3) + h[1:])[same]
        key = np.concatenate([row, row[1:][same]]) << BITS | (np.concatenate([h, pair]) >> np.uint64(64 - BITS)).astype(np.int64)
        key.sort()
        key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        yield a, b - a, key >> BITS, key & (_SLOTS - 1)


def _count(batches):
    counts = np.zeros((2, _SLOTS), np.int64)
    for batch in batches:
        label = np.asarray(batch.column(1).to_pylist(), np.int64)
        for a, n, row, slot in features(batch.column(0)):
            good = label[a : a + n][row] > 0
            counts[1] += np.bincount(slot[good], minlength=_SLOTS)
            counts[0] += np.bincount(slot[~good], minlength=_SLOTS)
    seen = np.flatnonzero(counts.sum(axis=0))
    if len(seen):
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[0, seen]), pa.array(counts[1, seen])], names=["slot", "bad", "good"])


def _rows(batches):
    for batch in batches:
        label = batch.column(1)
        for a, n, row, slot in features(batch.column(0)):
            at = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([label.slice(a, n), pa.ListArray.from_arrays(pa.array(at), pa.array(slot.astype(np.int32)))], names=["label", "slots"])


def log_ratio(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Log ratios of the classes' shares of each slot, two counts more in the classes' proportion: the rarer a slot, the nearer to zero."""
    share = good.sum() / (good.sum() + bad.sum())
    return np.log((good + 2 * share) / (bad + 2 * (1 - share)) * (1 - share) / share)


def descend(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, c: float = 1.0, rounds: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the squared hinge loss; classes weigh the same in total.

    Minimises ``|w|^2/2 + sum c_i max(0, 1 - y_i (w.x_i + b))^2`` with ``b`` as
    the weight of a constant feature. Each step solves one dual variable exactly.
    """
    w, b = np.zeros(len(ratio)), 0.0
    y = np.where(labels > 0, 1.0, -1.0)
    n = len(y)
    weight = {s: c * n / (2 * max(1, (y == s).sum())) for s in (1.0, -1.0)}
    values = [ratio[r] for r in rows]
    norms = [np.sqrt(v @ v) or 1.0 for v in values]
    values = [v / s for v, s in zip(values, norms)]
    alpha = np.zeros(n)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(n):
            r, v, d = rows[i], values[i], 0.5 / weight[y[i]]
            gradient = y[i] * (w[r] @ v + b) - 1 + d * alpha[i]
            new = max(0.0, alpha[i] - gradient / (2.0 + d))
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * v
                b += step
                alpha[i] = new
                worst = max(worst, abs(step))
        if worst < 1e-4:
            break
    return w, b


class Model:
    """Slot weights (ratio times hinge weight), ratios and intercept: a fixed size whatever the corpus."""

    def __init__(self, ratio: np.ndarray, w: np.ndarray, b: float):
        self.ratio2, self.weight, self.b = (ratio**2).astype(np.float32), (ratio * w).astype(np.float32), float(b)

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for a, n, row, slot in features(column):
            dot = np.bincount(row, self.weight[slot], minlength=n)
            norm = np.sqrt(np.bincount(row, self.ratio2[slot], minlength=n))
            out[a : a + n] = dot / np.where(norm > 0, norm, 1) + self.b
        return 1 / (1 + np.exp(-np.clip(3 * out, -30, 30)))


def _sample(labelled: DataFrame, sample: int) -> list[tuple[int, int]]:
    """``(doc_id, hash of the text)`` of the rows to fit on; no more than ``sample`` come to the driver."""
    sized = labelled.select("doc_id", F.xxhash64("text").alias("h"), (F.col("label") > 0).alias("good"), F.length("text").alias("n"))
    long = F.col("n") > SAMPLE_CHARS
    out = []
    for good in (False, True):
        own = sized.where(F.col("good") == good).groupBy("doc_id", "h").agg(F.first("n").alias("n"))
        left = sample // 2 * SAMPLE_CHARS
        for n, r in enumerate(own.orderBy(long, F.when(long, F.col("n")), F.xxhash64("doc_id"), "doc_id", "h").limit(sample // 2).collect()):
            left -= min(r["n"], _SLOTS)  # a row never has more features than slots
            if n and left < 0:
                break
            out.append((r["doc_id"], r["h"]))
    return out


def train(docs: DataFrame, labels: DataFrame, held_out_fold: int = 1, folds: int = 3, sample: int = SAMPLE_ROWS) -> Model:
    """Counts over all labelled rows outside the held-out fold; linear fit on a bounded sample of them."""
    spark = docs.sparkSession
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
        .where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & (fold(folds) != held_out_fold))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    text = doc_text(docs)
    counts = (
        text.join(small_or_shuffled(known), "doc_id")
        .select("text", "label")
        .mapInArrow(giving_back(_count), "slot long, bad long, good long")
        .groupBy("slot")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .toArrow()  # at most one row a slot
    )
    chosen = spark.createDataFrame(_sample(text.join(small_or_shuffled(known), "doc_id"), sample), "doc_id long, h long")
    picked = text.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "h"]).join(small_or_shuffled(known), "doc_id")
    rows = picked.dropDuplicates(["doc_id", "h"]).select("text", "label").mapInArrow(giving_back(_rows), "label int, slots array<int>").toArrow()  # at most ``sample`` rows
    ratio = np.zeros(_SLOTS)
    good, bad = np.zeros(_SLOTS), np.zeros(_SLOTS)
    slot = counts.column("slot").to_numpy()
    good[slot], bad[slot] = counts.column("good").to_numpy(), counts.column("bad").to_numpy()
    if good.sum() and bad.sum():
        ratio = log_ratio(good, bad)
    y = np.asarray(rows.column("label").to_pylist(), np.int64)
    if not len(y) or y.min() > 0 or y.max() <= 0:
        return Model(ratio, np.zeros(_SLOTS), 0.0 if not len(y) else (10.0 if y.min() > 0 else -10.0))
    listed = rows.column("slots").combine_chunks()
    listed = listed.chunk(0) if isinstance(listed, pa.ChunkedArray) else listed
    flat, at = listed.values.to_numpy(), listed.offsets.to_numpy()
    w, b = descend([flat[s:e] for s, e in zip(at[:-1], at[1:])], y, ratio)
    return Model(ratio, w, b)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name`` of scores (0 to 1, higher: better) at the end; all its columns stay, so it must not have that one."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has a column {name} already")
    held = docs.sparkSession.sparkContext.broadcast(model)  # two float32 a slot: 2 MB
    text = docs.columns.index("text")
    rows = docs.select(*columns_of(docs), F.col("text").cast("string").alias(name))  # scored whatever the type of text
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    names = [f.name for f in schema.fields]
    same = docs.schema.fields[text].dataType.simpleString() == "string"
    rows = docs if same else rows

    def run(batches):
        for batch in batches:
            found = held.value.scores(batch.column(text if same else batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names) - 1], pa.array(found)], names=names)

    return rows.mapInArrow(giving_back(run), schema)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)
    out = score(doc_text(docs), model)
    return out.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
