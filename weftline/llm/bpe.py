"""Byte-pair encoding with a minimal acyclic transducer lexicon, and decoding.

Word frequencies are counted over the whole corpus in Spark; the most frequent
words (a documented number) are encoded once and compiled into a minimal
acyclic automaton whose states share common suffixes. The number of words below
each transition gives every accepted word its index, and the index points to
its ids. The automaton is one flat file: it is sent to executors as bytes of
bounded size, each Python worker maps it into memory, and a batch's words walk
it together, one byte a step. Words that it doesn't accept are merged exactly,
all of a batch at once.

Defined results: a null text is the empty text, which has no ids and decodes to
the empty text; a text of any length is encoded whole; a special token's string
in a text becomes its id; of equally frequent words the lexicon takes the first
by their bytes; a null ``doc_id`` stays null; repeated rows are encoded each time; an empty table gives an empty result; other columns
are ignored or passed through as stated.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import re
import tempfile
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_text
from .pretoken import WordCache, byte_level_spans, code_points, decoded_slices, hashes
from .textops import giving_back

#: Words in the lexicon at most; a fixed size whatever the corpus.
LEXICON_WORDS = 50_000
#: Words that a task holds at once: counts before it sends them, results before it forgets them.
HELD_WORDS = 120_000
#: Bytes of text that a task cuts into words at once (a longer row is one piece).
PIECE_BYTES = 1 << 19
#: Longest word (bytes) that the lexicon takes.
LEXICON_BYTES = 64


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """Vocabulary and merge ranks of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        to_char = byte_characters()
        to_byte = {c: b for b, c in to_char.items()}
        self.first = np.array([vocab[to_char[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[to_char[b] + suffix] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int64), made[order]
        self.bytes_of: dict[int, bytes] = {}
        for token, i in vocab.items():
            body = token[: len(token) - len(suffix)] if suffix and token.endswith(suffix) else token
            if all(c in to_byte for c in body):
                self.bytes_of[i] = bytes(to_byte[c] for c in body)
        self.bytes_of.update((i, t.encode()) for t, i in self.special.items())

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of many words: each round merges every word's best pair, wherever it stands."""
        if not words:
            return []
        size = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        owner = np.repeat(np.arange(len(words)), size)
        ids = self.first[raw]
        ends = np.cumsum(size)
        ids[ends[size > 0] - 1] = self.last[raw[ends[size > 0] - 1]]
        done_ids, done_owner = [], []
        none = np.int64(1 << 40)
        while len(ids):
            pair = ids[:-1] << 32 | ids[1:]
            at = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
            hit = (self.key[at] == pair) & (owner[:-1] == owner[1:])
            rank = np.append(np.where(hit, self.rank[at], none), none)
            head = np.flatnonzero(np.diff(owner, prepend=-1))
            best = np.minimum.reduceat(rank, head)
            span = np.diff(np.append(head, len(ids)))
            live = np.repeat(best < none, span)
            if not live.all():
                done_ids.append(ids[~live])
                done_owner.append(owner[~live])
            take = live & (rank == np.repeat(best, span))
            spots = np.flatnonzero(take)
            if not len(spots):
                break
            # Of touching spots (the same sign repeated) every second one merges.
            run = np.flatnonzero(np.diff(spots, prepend=-2) != 1)
            place = np.arange(len(spots)) - np.repeat(run, np.diff(np.append(run, len(spots))))
            spots = spots[place % 2 == 0]
            ids[spots] = self.made[at[spots]]
            live[spots + 1] = False
            ids, owner = ids[live], owner[live]
        flat, whose = np.concatenate(done_ids or [ids]), np.concatenate(done_owner or [owner])
        order = np.argsort(whose, kind="stable")
        flat, cut = flat[order].tolist(), np.searchsorted(whose[order], np.arange(len(words) + 1)).tolist()
        return [flat[a:b] for a, b in zip(cut[:-1], cut[1:])]


def build_automaton(entries: list[tuple[bytes, list[int]]]) -> bytes:
    """The minimal acyclic automaton of sorted distinct words, with their ids, as flat bytes.

    Words are added in order; a state that can get no more transitions is
    replaced by an equal one if there is one, so suffixes are shared.
    """
    entries = sorted(entries)
    labels: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}

    def settle(path: list[tuple[int, int]], keep: int) -> None:
        while len(path) > keep:
            parent, byte = path.pop()
            child = labels[parent][byte]
            key = (final[child], tuple(labels[child].items()))
            same = register.setdefault(key, child)
            if same != child:
                labels[parent][byte] = same

    path: list[tuple[int, int]] = []
    previous = b""
    for word, _ in entries:
        common = 0
        while common < min(len(word), len(previous)) and word[common] == previous[common]:
            common += 1
        settle(path, common)
        state = labels[path[-1][0]][path[-1][1]] if path else 0
        for byte in word[common:]:
            labels.append({})
            final.append(False)
            labels[state][byte] = len(labels) - 1
            path.append((state, byte))
            state = len(labels) - 1
        final[state] = True
        previous = word
    settle(path, 0)

    order = _children_first(labels)
    number = {s: i for i, s in enumerate(reversed(order))}  # the start is 0
    below: dict[int, int] = {}
    for s in order:
        below[s] = final[s] + sum(below[c] for c in labels[s].values())
    key, target, skipped, ends = [], [], [], np.zeros(len(number), np.uint8)
    for s, k in number.items():
        ends[k] = final[s]
        before = int(final[s])
        for byte, c in sorted(labels[s].items()):
            key.append(k << 8 | byte)
            target.append(number[c])
            skipped.append(before)
            before += below[c]
    order = np.argsort(np.array(key, np.int64), kind="stable")
    flat = [i for _, ids in entries for i in ids]
    arrays = [
        np.array(key, np.int64)[order],
        np.array(target, np.int64)[order],
        np.array(skipped, np.int64)[order],
        ends.astype(np.int64),
        np.cumsum([0, *(len(ids) for _, ids in entries)]).astype(np.int64),
        np.array(flat, np.int64),
    ]
    head = np.array([len(arrays), *map(len, arrays)], np.int64)
    return b"".join(a.tobytes() for a in (head, *arrays))


def _children_first(labels: list[dict[int, int]]) -> list[int]:
    seen, out, stack = set(), [], [0]
    while stack:
        s = stack.pop()
        if s < 0:
            out.append(~s)
        elif s not in seen:
            seen.add(s)
            stack.append(~s)
            stack.extend(c for c in labels[s].values() if c not in seen)
    return out


class Lexicon:
    """A memory-mapped automaton; ``find`` walks many words at once."""

    def __init__(self, data: bytes):
        with tempfile.TemporaryFile() as f:  # has no name: nothing is left behind
            f.write(data)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        head = np.frombuffer(self.map, np.int64, 1)[0]
        sizes = np.frombuffer(self.map, np.int64, head, 8)
        at, parts = 8 * (1 + int(head)), []
        for n in sizes.tolist():
            parts.append(np.frombuffer(self.map, np.int64, n, at))
            at += 8 * n
        self.key, self.target, self.skipped, self.final, self.offset, self.ids = parts

    def find(self, words: list[bytes]) -> np.ndarray:
        """The index of each word, -1 if the lexicon doesn't have it."""
        n = len(words)
        out = np.full(n, -1, np.int64)
        if not n or not len(self.key):
            return out
        size = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(size) - size
        live = np.flatnonzero((size > 0) & (size <= LEXICON_BYTES))
        state, index = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        step = 0
        while len(live):
            want = state << 8 | raw[begin[live] + step]
            at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            ok = self.key[at] == want
            live, at = live[ok], at[ok]
            state, index = self.target[at], index[ok] + self.skipped[at]
            step += 1
            ended = size[live] == step
            stop = ended & (self.final[state] > 0)
            out[live[stop]] = index[stop]
            live, state, index = live[~ended], state[~ended], index[~ended]
        return out


def count_words(docs: DataFrame) -> DataFrame:
    """``(word, n)`` over all texts; each task adds up its own words first, in bounded memory."""

    def run(batches):
        total: Counter = Counter()
        names: dict[int, str] = {}

        def flush():
            keys = list(total)
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in keys], pa.string()), pa.array([total[k] for k in keys], pa.int64())], names=["word", "n"])
            total.clear()
            names.clear()

        for batch in batches:
            for _, text, rows in decoded_slices(batch.column(0), PIECE_BYTES):
                cp = code_points(text)
                s, e = byte_level_spans(text, cp, rows)
                h, first, n = np.unique(hashes(cp, s, e), return_index=True, return_counts=True)
                short = e[first] - s[first] <= LEXICON_BYTES
                for key, at, m in zip(h[short].tolist(), first[short].tolist(), n[short].tolist()):
                    total[key] += m
                    if key not in names:
                        names[key] = text[s[at] : e[at]]
                if len(total) > HELD_WORDS:
                    yield from flush()
        yield from flush()

    return doc_text(docs).select("text").mapInArrow(giving_back(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, path: str, words: int = LEXICON_WORDS) -> bytes:
    """The compiled automaton of the corpus's most frequent words."""
    merges = Merges(path)
    top = count_words(docs).orderBy(F.desc("n"), "word").limit(words).toArrow().column("word").to_pylist()
    raw = [w.encode() for w in top]
    return build_automaton(list(zip(raw, merges.encode(raw))))


class Encoder:
    """Encodes texts of a worker: the mapped lexicon first, exact merges for the rest."""

    def __init__(self, path: str, automaton: bytes):
        self.merges, self.lexicon = Merges(path), Lexicon(automaton)
        self.text_of = {i: (str(i), b) for i, b in self.merges.bytes_of.items()}
        self.cache = WordCache(self._words, HELD_WORDS)
        strings = self.merges.special
        self.special = re.compile("|".join(map(re.escape, sorted(strings, key=len, reverse=True)))) if strings else None

    def ids(self, words: list[bytes]) -> list[list[int]]:
        index = self.lexicon.find(words)
        missing = np.flatnonzero(index < 0)
        merged = self.merges.encode([words[i] for i in missing.tolist()])
        off, ids = self.lexicon.offset, self.lexicon.ids
        out: list = [ids[off[k] : off[k + 1]].tolist() if k >= 0 else None for k in index.tolist()]
        for i, found in zip(missing.tolist(), merged):
            out[i] = found
        return out

    def _words(self, words: list[str]) -> list[tuple[list[int], str, bytes]]:
        out, of = [], self.text_of
        for ids in self.ids([w.encode() for w in words]):
            pairs = [of[i] for i in ids]
            out.append((ids, ",".join([p[0] for p in pairs]), b"".join([p[1] for p in pairs])))
        return out

    def column(self, column: pa.Array):
        """Yields ``(row, results of the row's words in order)``."""
        for first, text, rows in decoded_slices(column, PIECE_BYTES):
            cuts = [(m.start(), m.end()) for m in self.special.finditer(text)] if self.special else []
            edges = np.unique(np.concatenate([rows, np.array(cuts, np.int64).reshape(-1)])) if cuts else rows
            cp = code_points(text)
            s, e = byte_level_spans(text, cp, edges)
            if cuts:  # a special string that lies in one row is one word by itself
                cuts = [c for c in cuts if np.searchsorted(rows, c[0], side="right") == np.searchsorted(rows, c[1], side="left")]
                begin, end = np.array([c[0] for c in cuts], np.int64), np.array([c[1] for c in cuts], np.int64)
                k = np.searchsorted(begin, s, side="right") - 1
                inside = (k >= 0) & (e <= end[np.maximum(k, 0)]) if len(begin) else np.zeros(len(s), bool)
            index = self.cache.lookup(text, cp, s, e)
            values = self.cache.values
            at = np.searchsorted(s, rows).tolist()
            listed = index.tolist()
            for i in range(len(rows) - 1):
                a, b = at[i], at[i + 1]
                row = [values[x] for x in listed[a:b]]
                if cuts:
                    row = self._with_special(text, s, row, inside, k, begin, end, a, b)
                yield first + i, row

    def _with_special(self, text, s, row, inside, k, begin, end, a, b):
        out, last = [], -1
        for j in range(a, b):
            if not inside[j]:
                out.append(row[j - a])
            elif k[j] != last:
                last = k[j]
                name = text[begin[last] : end[last]]
                i = self.merges.special[name]
                out.append(([i], str(i), name.encode()))
        return out


def encode(docs: DataFrame, path: str, automaton: bytes | None = None, ids: bool = True, text: bool = True) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if wanted, ``token_ids``; other columns stay, ``text`` only if wanted."""
    from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(automaton if automaton is not None else lexicon(docs, path))  # bounded by LEXICON_WORDS
    added = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    if ids:
        added.append(StructField("token_ids", ArrayType(IntegerType())))
    kept = docs.select(*[c for c in docs.columns if c not in {f.name for f in added}])
    at = kept.columns.index("text")
    stay = [i for i in range(len(kept.columns)) if text or i != at]
    fields = [*(kept.schema.fields[i] for i in stay), *added]
    names = [f.name for f in fields]

    def run(batches):
        encoder = Encoder(path, held.value)
        for batch in batches:
            n, shas, decoded, lists = [], [], [], []
            for _, row in encoder.column(batch.column(at)):
                joined = ",".join([x[1] for x in row])
                n.append(joined.count(",") + 1 if joined else 0)
                shas.append(hashlib.sha256(joined.encode()).hexdigest())
                whole = b"".join([x[2] for x in row])
                decoded.append(hashlib.sha256(whole.decode("utf-8", "replace").encode()).hexdigest())
                if ids:
                    lists.append([i for x in row for i in x[0]])
            columns = [pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())]
            if ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in stay), *columns], names=names)

    return kept.mapInArrow(giving_back(run), StructType(fields))


def result(docs: DataFrame, path: str) -> DataFrame:
    rows = doc_text(docs)
    return encode(rows, path, lexicon(rows, path), ids=False, text=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
