"""Vectorised byte-level helpers shared by the text operators.

Everything here works on one Arrow batch inside a task: a column of strings is
viewed as one run of UTF-8 bytes plus offsets, and tokens are found and hashed
with numpy over the whole run, so the per-row cost in Python is a few array
operations per *slice*, not per token.

Null texts are empty texts. A slice holds whole rows only; a row longer than
the slice size is a slice by itself.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Odd multiplier of the polynomial token hash (golden-ratio constant).
MULTIPLIER = 0x9E3779B97F4A7C15
SLICE_BYTES = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker returns what it freed to the system, as it lives on beside other tasks."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)

    return whole


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(offsets, bytes)`` of a string column; offsets start at 0, a null row is empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges ``[a, b)`` whose texts hold at most ``limit`` bytes (one row at least)."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


class Powers:
    """Powers of the multiplier and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            inverse = pow(MULTIPLIER, -1, 1 << 64)
            self.up, self.down = _powers(MULTIPLIER, size), _powers(inverse, size)
        return self.up[:n], self.down[:n]


def _powers(base: int, size: int) -> np.ndarray:
    out = np.ones(size, np.uint64)
    done, step = 1, base
    while done < size:
        out[done : 2 * done] = out[:done] * np.uint64(step)
        done, step = 2 * done, step * step % (1 << 64)
    return out


_POWERS = Powers()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """``H`` with ``H[e] - H[s] = sum of (byte + 1) * M**i`` over ``s <= i < e``."""
    up, _ = _POWERS.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free 64-bit hashes of the byte spans ``[start, end)``."""
    _, down = _POWERS.upto(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lower(data: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case; other bytes unchanged."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, row)`` of the maximal runs without ASCII white space; runs end with their row."""
    full = ~_SPACE[data]
    return runs(full, offsets)


def runs(full: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, row)`` of the maximal runs of true bytes; runs end with their row."""
    n = len(full)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = full.copy()
    begins[1:] &= ~full[:-1] | edge[1:n]
    ends = full.copy()
    ends[:-1] &= ~full[1:] | edge[1:n]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1
