"""Vectorised pre-tokenisation: character classes, word spans and a word cache.

A batch of texts is decoded once to code points. Runs of one class (letters,
numbers, white space, others) are found with numpy, and the few rules on top of
them follow the two published pre-tokenisation patterns. Words are then handled
by identity: each distinct word of a slice is encoded once.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa

from .textops import column_bytes, prefix_hash, slices, span_hash

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: Code points with the Unicode property White_Space.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Endings that the patterns split off after an apostrophe, in their order.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

_classes: np.ndarray | None = None
_unassigned: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of every code point, from the Unicode database (built once a process)."""
    global _classes
    if _classes is None:
        major = {"L": LETTER, "N": NUMBER}
        out = np.fromiter((major.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        out[list(WHITE_SPACE)] = SPACE
        _classes = out
    return _classes


def unassigned() -> np.ndarray:
    """Which code points Python's Unicode database doesn't know (built once a process)."""
    global _unassigned
    if _unassigned is None:
        _unassigned = np.fromiter((unicodedata.category(chr(i)) == "Cn" for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _unassigned


def decoded_slices(column: pa.Array, limit: int = 1 << 20):
    """``(first row, text, code point offsets of the rows)`` by slices of whole rows."""
    offsets, data = column_bytes(column)
    for a, b in slices(offsets, limit):
        at = offsets[a : b + 1] - offsets[a]
        raw = data[offsets[a] : offsets[b]]
        starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        yield a, raw.tobytes().decode(), starts[at]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _run_starts(kind: np.ndarray, rows: np.ndarray, also: np.ndarray | None = None) -> np.ndarray:
    """Where a class or a row begins, and wherever ``also`` says."""
    starts = np.ones(len(kind), bool)
    starts[1:] = kind[1:] != kind[:-1]
    starts[rows[rows < len(kind)]] = True
    if also is not None:
        starts |= also
    return np.flatnonzero(starts)


def byte_level_spans(text: str, cp: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the byte-level pattern; together they cover every text.

    A run of letters, numbers or other signs takes one space before it. A run
    of white space before something gives up its last character: a space joins
    what follows, another one stands alone. An ending after a lone apostrophe
    that no space precedes is split off.
    """
    n = len(cp)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z
    kind = classes()[cp]
    start = _run_starts(kind, rows)
    end = np.append(start[1:], n)
    k = kind[start]
    row_end = np.zeros(n + 1, bool)
    row_end[rows] = True
    space = k == SPACE
    before_word = space & ~row_end[end]  # white space followed by something in its row
    last = end - 1
    joins = before_word & (cp[last] == 32)
    own = np.flatnonzero(~space)
    word_start = start[own].copy()
    word_end = end[own].copy()
    follows = np.zeros(len(start), bool)
    follows[1:] = joins[:-1]
    word_start[follows[own]] -= 1
    gap = np.flatnonzero(space)
    gap_start, gap_end = start[gap], np.where(before_word[gap], end[gap] - 1, end[gap])
    full = gap_end > gap_start
    lone = gap[(before_word & ~joins)[gap]]
    s = np.concatenate([word_start, gap_start[full], end[lone] - 1])
    e = np.concatenate([word_end, gap_end[full], end[lone]])
    order = np.argsort(s, kind="stable")
    s, e = s[order], e[order]
    return _split_endings(text, cp, rows, s, e)


def _split_endings(text: str, cp: np.ndarray, rows: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    alone = np.flatnonzero((cp[s] == 39) & (e - s == 1))
    alone = alone[alone + 1 < len(s)]
    alone = alone[(s[alone + 1] == e[alone]) & ~np.isin(e[alone], rows)]
    moved = False
    s, e = s.copy(), e.copy()
    drop = np.zeros(len(s), bool)
    for i in alone.tolist():
        if not drop[i]:
            word = text[s[i + 1] : e[i + 1]]
            ending = next((x for x in ENDINGS if word.startswith(x)), None)
            if ending:
                e[i] += len(ending)
                s[i + 1] += len(ending)
                drop[i + 1] = s[i + 1] == e[i + 1]
                moved = True
    return (s[~drop], e[~drop]) if moved else (s, e)


def word_spans(text: str, cp: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the word pattern: runs of letters, single numbers, runs of other signs, endings; white space goes."""
    n = len(cp)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z
    kind = classes()[cp]
    start = _run_starts(kind, rows, kind == NUMBER)
    end = np.append(start[1:], n)
    keep = kind[start] != SPACE
    return _split_endings(text, cp, rows, start[keep], end[keep])


def hashes(cp: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return span_hash(prefix_hash(cp), s, e)


class WordCache:
    """Results by word hash; emptied beyond ``limit`` words so that a task's memory stays bounded."""

    def __init__(self, encode, limit: int = 300_000):
        self.encode, self.limit = encode, limit
        self.index: dict[int, int] = {}
        self.values: list = []

    def lookup(self, text: str, cp: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The index in ``values`` of every span's result."""
        if len(self.values) > self.limit:
            self.index, self.values = {}, []
        h = hashes(cp, s, e)
        distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        keys = distinct.tolist()
        missing = [i for i, x in enumerate(keys) if x not in self.index]
        if missing:
            at = first[missing]
            found = self.encode([text[i:j] for i, j in zip(s[at].tolist(), e[at].tolist())])
            n = len(self.values)
            self.values.extend(found)
            self.index.update((keys[x], n + i) for i, x in enumerate(missing))
        return np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))[inverse]
