"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into windows of bytes. One recurrent layer reads a window from
the left, another from the right; at every position both states give class
probabilities, so every byte gets a label distribution. A document's
probabilities are the means over all its positions. The network is trained in
numpy by backpropagation through time on windows of a bounded sample of
labelled documents (``SAMPLE_DOCS`` of each language, in the order of a hash; of many
languages fewer each, ``SAMPLE_ALL`` in total, but one at least). Every language that is
learned can be predicted, however many there are.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
a text of any length is read whole; of equal probabilities the language that is
first by name is taken; rows without a language aren't learned from; rows that
repeat are labelled each time; a null ``doc_id`` is hashed as the empty text for
the fold; with no labelled rows everything is ``und``; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_text, fold
from .textops import column_bytes, slices

HIDDEN = 8
WINDOW = 64
#: The training sample: so many documents of each language, and so many windows of each, at most.
SAMPLE_DOCS = 400
SAMPLE_WINDOWS = 8
#: Documents of the sample in total, of all languages, as long as that leaves one for each.
SAMPLE_ALL = 400_000
UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[list(range(65, 91)) + list(range(97, 123))] = True


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Layer:
    """One direction: ``h' = n + z (h - n)`` with gates z and r; inputs are rows of tables."""

    NAMES = ("table_g", "table_n", "u_g", "u_n", "c_n")

    def __init__(self, rng: np.random.Generator):
        scale = 1 / np.sqrt(HIDDEN)
        self.table_g = rng.normal(0, 0.3, (256, 2 * HIDDEN)).astype(np.float32)
        self.table_n = rng.normal(0, 0.3, (256, HIDDEN)).astype(np.float32)
        self.u_g = rng.normal(0, scale, (HIDDEN, 2 * HIDDEN)).astype(np.float32)
        self.u_n = rng.normal(0, scale, (HIDDEN, HIDDEN)).astype(np.float32)
        self.c_n = np.zeros(HIDDEN, np.float32)

    def step(self, byte: np.ndarray, h: np.ndarray):
        g = _sigmoid(self.table_g[byte] + h @ self.u_g)
        z, r = g[:, :HIDDEN], g[:, HIDDEN:]
        inner = h @ self.u_n + self.c_n
        n = np.tanh(self.table_n[byte] + r * inner)
        return n + z * (h - n), (g, inner, n)


class Network:
    def __init__(self, languages: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.left, self.right = Layer(rng), Layer(rng)
        k = len(languages)
        self.w_left = rng.normal(0, 0.3, (HIDDEN, k)).astype(np.float32)
        self.w_right = rng.normal(0, 0.3, (HIDDEN, k)).astype(np.float32)
        self.b = np.zeros(k, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [getattr(x, n) for x in (self.left, self.right) for n in Layer.NAMES] + [self.w_left, self.w_right, self.b]

    def gradients(self, window: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over all positions of full windows, and its gradients (through time)."""
        m, t = window.shape
        states = {}
        for layer, order in ((self.left, range(t)), (self.right, range(t - 1, -1, -1))):
            h, kept = np.zeros((m, HIDDEN), np.float32), {}
            for i in order:
                new, inside = layer.step(window[:, i], h)
                kept[i] = (h, new, inside)
                h = new
            states[layer] = kept
        target = np.zeros((m, len(self.languages)), np.float32)
        target[np.arange(m), label] = 1
        loss, d_logits = 0.0, []
        g_wl, g_wr, g_b = np.zeros_like(self.w_left), np.zeros_like(self.w_right), np.zeros_like(self.b)
        for i in range(t):
            hl, hr = states[self.left][i][1], states[self.right][i][1]
            p = _softmax(hl @ self.w_left + hr @ self.w_right + self.b)
            loss -= float(np.log(p[np.arange(m), label] + 1e-9).sum()) / (m * t)
            d = (p - target) / (m * t)
            d_logits.append(d)
            g_wl += hl.T @ d
            g_wr += hr.T @ d
            g_b += d.sum(axis=0)
        out = []
        for layer, w, order in ((self.left, self.w_left, range(t - 1, -1, -1)), (self.right, self.w_right, range(t))):
            grad = {n: np.zeros_like(getattr(layer, n)) for n in Layer.NAMES}
            back = np.zeros((m, HIDDEN), np.float32)
            for i in order:
                h, _, (g, inner, n) = states[layer][i]
                z, r = g[:, :HIDDEN], g[:, HIDDEN:]
                dh = back + d_logits[i] @ w.T
                dn = dh * (1 - z) * (1 - n * n)
                dg = np.concatenate([dh * (h - n), dn * inner], axis=1) * g * (1 - g)
                d_inner = dn * r
                np.add.at(grad["table_g"], window[:, i], dg)
                np.add.at(grad["table_n"], window[:, i], dn)
                grad["u_g"] += h.T @ dg
                grad["u_n"] += h.T @ d_inner
                grad["c_n"] += d_inner.sum(axis=0)
                back = dh * z + dg @ layer.u_g.T + d_inner @ layer.u_n.T
            out += [grad[n] for n in Layer.NAMES]
        return loss, [*out, g_wl, g_wr, g_b]

    def fit(self, windows: np.ndarray, labels: np.ndarray, steps: int = 400, batch: int = 256, rate: float = 0.02, seed: int = 5) -> float:
        """Adam on balanced batches."""
        rng = np.random.default_rng(seed)
        by = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        by = [x for x in by if len(x)]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.parameters()]
        loss = 0.0
        for step in range(1, steps + 1):
            here = by if len(by) <= batch else [by[k] for k in rng.choice(len(by), batch, replace=False)]
            pick = np.concatenate([rng.choice(x, max(1, batch // len(here))) for x in here])
            loss, grads = self.gradients(windows[pick], labels[pick])
            size = np.sqrt(sum(float((g * g).sum()) for g in grads))
            scale = min(1.0, 1.0 / (size + 1e-9))
            now = rate * (1 - 0.9 * step / steps)
            for p, g, (m1, m2) in zip(self.parameters(), grads, moments):
                g = g * scale
                m1 += 0.1 * (g - m1)
                m2 += 0.01 * (g * g - m2)
                p -= (now * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return loss

    def position_probabilities(self, window: np.ndarray, size: np.ndarray):
        """Yields ``(position, probabilities, valid)`` of each position, from right to left."""
        m, t = window.shape
        h, states = np.zeros((m, HIDDEN), np.float32), []
        for i in range(t):
            h, _ = self.left.step(window[:, i], h)
            states.append(h)
        h = np.zeros((m, HIDDEN), np.float32)
        for i in range(t - 1, -1, -1):
            valid = (size > i).astype(np.float32)
            h, _ = self.right.step(window[:, i], h)
            h *= valid[:, None]
            yield i, _softmax(states[i] @ self.w_left + h @ self.w_right + self.b), valid

    def documents(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(language index or -1, mean probability)`` of each text."""
        n = len(column)
        best, score = np.full(n, -1, np.int64), np.zeros(n)
        if not self.languages:
            return best, score
        offsets, data = column_bytes(column)
        for a, b in slices(offsets, 1 << 20):
            at = offsets[a : b + 1] - offsets[a]
            raw = data[offsets[a] : offsets[b]]
            letters = np.diff(np.concatenate([[0], np.cumsum(_LETTER[raw])])[at]) > 0
            for i in np.flatnonzero(~letters & (np.diff(at) > 0)).tolist():
                letters[i] = any(c.isalpha() for c in raw[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace"))
            length = np.diff(at)
            windows = -(-length // WINDOW)
            owner = np.repeat(np.arange(b - a), windows)
            if not len(owner):
                continue
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
            begin = at[owner] + nth * WINDOW
            size = np.minimum(WINDOW, at[owner + 1] - begin)
            padded = np.append(raw, np.zeros(WINDOW, np.uint8))
            total = np.zeros((len(owner), len(self.languages)), np.float32)
            block = 8192
            for x in range(0, len(owner), block):
                view = padded[begin[x : x + block, None] + np.arange(WINDOW)]
                view = np.asfortranarray(view)
                for _, p, valid in self.position_probabilities(view, size[x : x + block]):
                    total[x : x + block] += p * valid[:, None]
            mean = np.column_stack([np.bincount(owner, total[:, k], minlength=b - a) for k in range(len(self.languages))]) / np.maximum(length, 1)[:, None]
            top = mean.argmax(axis=1)
            best[a:b] = np.where(letters, top, -1)
            score[a:b] = np.where(letters, np.clip(mean[np.arange(b - a), top], 0, 1), 0.0)
        return best, score


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _windows(batches):
    """Evenly spread full windows of each sampled text; a shorter text is repeated to fill one."""
    for batch in batches:
        out, langs = [], []
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            raw = text.encode()
            if not any(c.isalpha() for c in text):
                continue
            if len(raw) < WINDOW:
                raw = (raw + b" ") * (WINDOW // (len(raw) + 1) + 1)
            n = min(SAMPLE_WINDOWS, max(1, len(raw) // WINDOW))
            for i in range(n):
                a = round(i * (len(raw) - WINDOW) / max(1, n - 1))
                out.append(raw[a : a + WINDOW])
                langs.append(lang)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(langs, pa.string())], names=["window", "lang"])


def train(docs: DataFrame, held_out_fold: int = 0, folds: int = 5) -> Network:
    """Fits the network on windows of at most ``SAMPLE_DOCS`` documents of each language outside the held-out fold."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(folds) != held_out_fold)).withColumn("h", F.xxhash64("text"))
    # Ranks are cut in each task before rows are shuffled, so a frequent language sends few rows.
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "h")
    kinds = known.select("lang").distinct().count()
    if not kinds:
        return Network([])
    each = max(1, min(SAMPLE_DOCS, SAMPLE_ALL // kinds))
    picked = known.select("lang", "doc_id", "h").withColumn("n", F.row_number().over(order)).where(F.col("n") <= each).select("lang", "doc_id", "h").collect()
    languages = sorted({r["lang"] for r in picked})
    keys = docs.sparkSession.createDataFrame(sorted({(r["doc_id"], r["h"], r["lang"]) for r in picked}, key=str), "doc_id long, h long, lang string")
    same = known["doc_id"].eqNullSafe(keys["doc_id"]) & (known["h"] == keys["h"]) & (known["lang"] == keys["lang"])
    rows = known.join(F.broadcast(keys), same, "left_semi").dropDuplicates(["doc_id", "h", "lang"])  # the sample only
    found = rows.select("text", "lang").mapInArrow(_windows, "window binary, lang string").toArrow()
    index = {x: i for i, x in enumerate(sorted(languages))}
    network = Network(sorted(languages))
    if found.num_rows:
        pairs = sorted(zip(found.column("window").to_pylist(), found.column("lang").to_pylist()))
        windows = np.frombuffer(b"".join(w for w, _ in pairs), np.uint8).reshape(-1, WINDOW)
        network.fit(windows, np.array([index[x] for _, x in pairs]))
    return network


def predict(docs: DataFrame, network: Network) -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every document, from its text alone."""
    held = docs.sparkSession.sparkContext.broadcast(network)  # a few thousand numbers

    def run(batches):
        names = np.array([*held.value.languages, UNKNOWN], object)
        for batch in batches:
            best, score = held.value.documents(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return doc_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def result(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs)).select("doc_id", (fold(5) == 0).alias("held_out"), "lang_pred", "score")
