"""Whitening of embeddings by a blockwise QR, a bidiagonal and the qd algorithms.

Entries become whole numbers, whose sums are exact, so rows are centred without
loss before anything is multiplied. Every partition reduces its centred rows to
one triangle by QR, block after block, and triangles are stacked and reduced in
groups until a few are left, so no product of entries is ever summed. Householder
reflections make the last triangle bidiagonal; dqds finds the squares of its singular
values to high relative accuracy; a twisted factorisation at each of them gives the
right singular vector, which the reflections carry back. The covariance of the whitened
rows is then measured over all rows, from centred sums merged pairwise.

Defined results: rows whose vector is null or holds null or non-finite entries are
dropped; shorter vectors are filled up with zeros to the longest; entries beyond 2**55
are an error. Of fewer than ``COMPONENTS`` dimensions all are components. A component
whose variance is zero (to rounding) has null ``whitened`` values, and isn't part of
``identity_error``; where all are, as with one row, ``explained`` and ``identity_error``
are null. A ``deviation`` beyond a long is null. Of the two signs the one is taken that
makes a component's largest entry positive. Rows and ids that repeat are rows like
others; a null ``vec_id`` stays null. An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import entries, matrix, whole, width

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Partial results that are merged in one task, and that the driver merges at last.
FAN = 64
#: Rows of a slice whose results are sent on together.
SLICE = 1024
EPS = np.finfo(float).eps


def whole_numbers(x: np.ndarray) -> np.ndarray:
    x = np.floor(x * SCALE)
    if x.size and np.abs(x).max() > 2.0**61:
        raise ValueError("entries beyond 2**55 don't fit whole numbers")
    return x.astype(np.int64) + SHIFT


def times_n_less_sums(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n x - S`` exactly: 64-bit where it fits, else Python's whole numbers."""
    most = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0))
    if most < 1 << 61:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def squares(y: np.ndarray) -> list[int | None]:
    """The sum of the squares of each row, exactly; None beyond a long."""
    most = max((abs(int(v)) for v in (y.max(), y.min())), default=0) if y.size else 0
    if y.dtype != object and y.shape[1] * most * most < 1 << 63:
        return (y * y).sum(axis=1).tolist()
    return [s if (s := sum(int(v) * int(v) for v in row)) < 1 << 63 else None for row in y]


def _merged(parts: DataFrame, merge, partitions: int) -> list:
    """Rows ``(id, bytes)``, one a partition, merged in groups of ``FAN`` until at most that many are left, which are collected."""
    while partitions > FAN:

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"id": [int(pdf["id"].iloc[0]) // FAN], "state": [merge([np.frombuffer(b) for b in pdf.sort_values("id")["state"]]).tobytes()]})

        parts = parts.groupBy(F.floor(F.col("id") / FAN)).applyInPandas(one, "id long, state binary")
        partitions = math.ceil(partitions / FAN)
    return [np.frombuffer(r["state"]) for r in parts.orderBy("id").collect()]


def _states(rows: DataFrame, state) -> DataFrame:
    """One row ``(id, state)`` a partition that has rows: ``state(batches)`` as bytes."""

    def run(batches):
        from pyspark import TaskContext

        found = state(batches)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([found.astype(float).tobytes()], pa.binary())], names=["id", "state"])

    return rows.mapInArrow(run, "id long, state binary")


def exact_sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """``(n, S)``: rows, and the sum of each dimension's whole numbers."""

    def run(batches):
        n, sums = 0, [0] * d
        for batch in batches:
            x = whole_numbers(matrix(batch.column(1), d))
            n += len(x)
            small = not x.size or int(np.abs(x).max()) * len(x) < 1 << 62
            sums = [s + int(v) for s, v in zip(sums, (x if small else x.astype(object)).sum(axis=0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([str(v) for v in (n, *sums)])], names=["pos", "s"])

    found = rows.mapInArrow(run, "pos int, s string").groupBy("pos").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    by = {r["pos"]: int(r["s"]) for r in found}  # one row a dimension
    return by.get(-1, 0), [by.get(i, 0) for i in range(d)]


def stacked(triangles: list[np.ndarray], d: int) -> np.ndarray:
    """The triangle of triangles on top of each other, square."""
    r = np.linalg.qr(np.concatenate(triangles), mode="r") if triangles else np.zeros((0, d))
    return np.concatenate([r, np.zeros((d - len(r), d))]) if len(r) < d else r


def triangle(rows: DataFrame, d: int, n: int, sums: list[int]) -> np.ndarray:
    """R of the QR of all centred rows."""

    def state(batches):
        r = None
        for batch in batches:
            y = times_n_less_sums(whole_numbers(matrix(batch.column(1), d)), n, sums)
            if len(y):
                r = stacked([y.astype(float) / n] + ([r] if r is not None else []), d)
        return r

    square = lambda found: stacked([f.reshape(d, d) for f in found], d)
    parts = _states(rows, state)
    return square(_merged(parts, square, rows.rdd.getNumPartitions()))


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(diagonal, superdiagonal, W)`` with ``r = U B W'``, by Householder reflections from both sides."""
    a, d = r.astype(float).copy(), r.shape[1]
    w = np.eye(d)

    def reflector(x):
        size = np.linalg.norm(x)
        v = x.copy()
        v[0] += math.copysign(size, x[0])
        length = np.linalg.norm(v)
        return v / length if length else None

    for k in range(d):
        v = reflector(a[k:, k])
        if v is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < d - 2:
            v = reflector(a[k, k + 1 :])
            if v is not None:
                a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
                w[:, k + 1 :] -= 2 * np.outer(w[:, k + 1 :] @ v, v)
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), w


def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Eigenvalues of ``B'B``, largest first, from the squares of B's diagonal and superdiagonal.

    A shift that would lose positivity is halved; as long as none does, every value keeps high relative accuracy.
    """
    q, e, done, moved = [float(x) for x in q], [float(x) for x in e], [], 0.0
    sweeps = 0
    while q:
        n = len(q)
        if n == 1 or e[-1] <= EPS * EPS * (q[-1] + moved) or e[-1] == 0:
            done.append(q.pop() + moved)
            if e:
                e.pop()
            continue
        mean, half = (q[-2] + e[-1] + q[-1]) / 2, (q[-2] + e[-1] - q[-1]) / 2
        shift = max(0.0, mean - math.hypot(half, math.sqrt(q[-1] * e[-1]))) if n > 1 else 0.0
        for turn in range(12):
            tau = shift * (1 - 4 * EPS) / (1 << turn) if turn < 11 else 0.0
            d, q2, e2, fine = q[0] - tau, [], [], q[0] - tau >= 0
            for i in range(n - 1):
                s = d + e[i]
                q2.append(s)
                if s > 0:
                    t = q[i + 1] / s
                    e2.append(e[i] * t)
                    d = d * t - tau
                else:  # nothing is left of this row: the next begins afresh
                    e2.append(0.0)
                    d = q[i + 1] - tau
                fine = fine and d >= 0
                if not fine:
                    break
            if fine or turn == 11:
                q2.append(max(d, 0.0))
                break
        q, e, moved = q2, e2, moved + tau
        sweeps += 1
        if sweeps > 200 * 64 + 100 * n * n:
            raise ArithmeticError("dqds doesn't converge")
    return np.sort(np.array(done))[::-1]


def twisted(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """The eigenvector of ``B'B`` at an eigenvalue: factorised from both ends, twisted where they meet best."""
    n = len(a)
    d, low = a * a, b / a[:-1]
    tiny = EPS * EPS * max(1e-300, float((d.max())))
    sound = lambda x: x if abs(x) > tiny else math.copysign(tiny, x)
    s, p = np.zeros(n), np.zeros(n)
    down, up = np.zeros(max(0, n - 1)), np.zeros(max(0, n - 1))
    s[0] = -value
    for i in range(n - 1):
        pivot = sound(s[i] + d[i])
        down[i] = d[i] * low[i] / pivot
        s[i + 1] = down[i] * low[i] * s[i] - value
    p[n - 1] = d[n - 1] - value
    for i in range(n - 2, -1, -1):
        pivot = sound(d[i] * low[i] * low[i] + p[i + 1])
        t = d[i] / pivot
        up[i] = low[i] * t
        p[i] = p[i + 1] * t - value
    k = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def _apart(z: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for o in others:
            z = z - (o @ z) * o
    return z


def eigen(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(values, vectors)`` of ``r'r``, largest first; vectors are columns.

    Where the bidiagonal falls apart its blocks are solved by themselves. Vectors of close
    values are made orthogonal to each other; where two fall together, the second is found by
    inverse iteration in what is left.
    """
    a, b, w = bidiagonal(r)
    top = float(max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)))
    values, vectors = [], []
    cut = [i for i in range(len(b)) if abs(b[i]) <= EPS * (abs(a[i]) + abs(a[i + 1])) or abs(b[i]) <= EPS * EPS * top]
    for lo, hi in zip([0, *(c + 1 for c in cut)], [*(c + 1 for c in cut), len(a)]):
        own_a, own_b = a[lo:hi], b[lo : hi - 1]
        found, kept = dqds(own_a * own_a, own_b * own_b), []
        full = np.where(np.abs(own_a) > EPS * top, own_a, EPS * top) if top else np.ones(len(own_a))
        dense = None
        for k, value in enumerate(found):
            close = [z for z, v in zip(kept, found) if abs(v - value) <= max(1e-3 * max(v, value), (64 * EPS * top) ** 2)]
            z = _apart(twisted(full, own_b, float(value)), close)
            if np.linalg.norm(z) < 0.1:
                if dense is None:
                    m = np.diag(own_a) + np.diag(own_b, 1)
                    dense = m.T @ m
                z = _apart(np.cos(np.arange(1, len(own_a) + 1) * (k + 1.0)), kept)
                shifted = dense - (value + 8 * EPS * top * top) * np.eye(len(own_a))
                for _ in range(4):
                    z = _apart(np.linalg.solve(shifted, z / np.linalg.norm(z)), kept)
            z = z / np.linalg.norm(z)
            kept.append(z)
            whole_z = np.zeros(len(a))
            whole_z[lo:hi] = z
            values.append(float(value))
            vectors.append(whole_z)
    order = sorted(range(len(values)), key=lambda i: -values[i])
    z = w @ np.array([vectors[i] for i in order]).T
    z = z * np.sign(z[np.abs(z).argmax(axis=0), np.arange(z.shape[1])])
    return np.array([values[i] for i in order]), z


def _joined(states: list[np.ndarray], k: int) -> np.ndarray:
    """``(n, mean, centred products)`` of several such states, merged one after another."""
    n, mean, m2 = 0.0, np.zeros(k), np.zeros((k, k))
    for s in states:
        n2, mean2, add = s[0], s[1 : k + 1], s[k + 1 :].reshape(k, k)
        gap, whole_n = mean2 - mean, n + n2
        m2 = m2 + add + np.outer(gap, gap) * n * n2 / whole_n
        mean, n = mean + gap * n2 / whole_n, whole_n
    return np.concatenate([[n], mean, m2.reshape(-1)])


class Whitening:
    """What the fit knows: ``n``, sums, variances ``e``, components (columns), and how much of the trace each explains."""

    def __init__(self, n: int, sums: list[int], r: np.ndarray):
        values, vectors = eigen(r)
        k = min(COMPONENTS, len(sums))
        total = float((r * r).sum())
        self.n, self.sums = n, sums
        self.e = values[:k] / n
        self.there = values[:k] > (len(sums) * EPS) ** 2 * max(total, 0.0) if total else np.zeros(k, bool)
        self.explained = [float(v) / total if total else None for v in values[:k]]
        self.scaled = vectors[:, :k] / np.sqrt(np.where(self.there, self.e, 1.0))

    def apply(self, y: np.ndarray) -> np.ndarray:
        """Whitened rows of ``n x - S``."""
        return (y.astype(float) / self.n) @ self.scaled


def identity_error(rows: DataFrame, d: int, fit: Whitening) -> float | None:
    """The largest entry of the whitened rows' covariance less the identity, over components with a variance."""
    if not fit.there.any():
        return None
    k = int(fit.there.sum())

    def state(batches):
        out = []
        for batch in batches:
            y = times_n_less_sums(whole_numbers(matrix(batch.column(1), d)), fit.n, fit.sums)
            if len(y):
                z = fit.apply(y)[:, fit.there]
                mean = z.mean(axis=0)
                out = [_joined([*out, np.concatenate([[len(z)], mean, ((z - mean).T @ (z - mean)).reshape(-1)])], k)]
        return out[0] if out else None

    parts = _states(rows, state)
    last = _joined(_merged(parts, lambda found: _joined(found, k), rows.rdd.getNumPartitions()), k)
    return float(np.abs(last[k + 1 :].reshape(k, k) / last[0] - np.eye(k)).max())


def fitted(rows: DataFrame, d: int) -> Whitening | None:
    """The whitening of ``(vec_id, embedding)``; None without rows."""
    n, sums = exact_sums(rows, d)
    return Whitening(n, sums, triangle(rows, d, n, sums)) if n and d else None


def result(vectors: DataFrame) -> DataFrame:
    rows = vectors.where(whole()).select(F.col("vec_id").cast("long").alias("vec_id"), entries().alias("embedding"))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    d = width(rows)
    fit = fitted(rows, d)
    if fit is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error, k = identity_error(rows, d, fit), len(fit.e)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                part = batch.slice(a, SLICE)
                y, m = times_n_less_sums(whole_numbers(matrix(part.column(1), d)), fit.n, fit.sums), part.num_rows
                white = fit.apply(y)
                every = lambda values: pa.array(list(values) * m, pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, fit.n, np.int64)),
                        pa.array(squares(y), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(white.reshape(-1), mask=np.tile(~fit.there, m)), every(fit.explained), every([error] * k),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema)
