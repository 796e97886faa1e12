"""Token ids as flat unsigned integer files with 64-bit document offsets.

The corpus is cut into ranges of ``doc_id``; each range is one shard:

* ``ids-NNNNN.bin``: the ids of its documents, one after another, in the
  smallest unsigned little-endian type that holds the vocabulary;
* ``offsets-NNNNN.bin``: ``doc_id`` and the end offset in the shard, both 64-bit, for each document.

A shard's base, the number of ids in all shards before it, is a prefix sum over
one count a shard. Shards are written under a temporary name and renamed, so a
task that is run again replaces its own files. Reading maps the files into
memory.

Texts are encoded by the tokenizers library, each distinct word of a slice
once: words are cut as the vocabulary's normaliser and pattern say. A text with
a character that Python's Unicode tables don't know (the library's are newer) is
encoded by the library as a whole.

Defined results: a null text is the empty text and has the end id only; rows
that repeat a ``doc_id`` follow each other in the order of their texts (ties:
equal rows, in any order); a null ``doc_id`` comes first; a text of any length
is encoded whole; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_text, local_path, new_path, partitions, write
from .pretoken import WordCache, code_points, decoded_slices, unassigned, word_spans

END_ID = 2
#: How the vocabulary marks the last piece of a word; words that the library encodes at once.
END_OF_WORD = "</w>"
LINE_WORDS = 64
_NULL_ID = -(1 << 63)


class WordTokenizer:
    """The tokenizers library behind a cache of words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.pattern = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in self.library.get_vocab().items() if t.endswith(END_OF_WORD)]] = True
        self.cache = WordCache(self._words)
        self.special_values = {name: np.array([i], np.uint32) for name, i in self.special.items()}

    def _words(self, words: list[str]) -> list[np.ndarray]:
        """The library encodes words by the line; where a word ends shows in its last id."""
        out: list[np.ndarray] = []
        lines = [words[i : i + LINE_WORDS] for i in range(0, len(words), LINE_WORDS)]
        for line, found in zip(lines, self.library.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False)):
            ids = np.array(found.ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(line) and ends[-1] == len(ids):
                out.extend(ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()))
            else:
                out.extend(np.array(x.ids, np.uint32) for x in self.library.encode_batch_fast(line, add_special_tokens=False))
        return out

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts without special strings."""
        if unassigned()[code_points("".join(texts))].any():
            strange = [i for i, t in enumerate(texts) if unassigned()[code_points(t)].any()]
            whole = self.library.encode_batch_fast([texts[i] for i in strange], add_special_tokens=False)
            own = {i: np.array(x.ids, np.uint32) for i, x in zip(strange, whole)}
            rest = iter(self._known([t for i, t in enumerate(texts) if i not in own]))
            return [own[i] if i in own else next(rest) for i in range(len(texts))]
        return self._known(texts)

    def _known(self, texts: list[str]) -> list[np.ndarray]:
        normal = [t if t.isascii() else unicodedata.normalize("NFC", t).replace("Σ", "σ") for t in texts]
        lowered = [t.lower() for t in normal]
        rows = np.cumsum([0, *map(len, lowered)])
        text = "".join(lowered)
        cp = code_points(text)
        s, e = word_spans(text, cp, rows)
        if not len(s):
            return [np.zeros(0, np.uint32)] * len(texts)
        index = self.cache.lookup(text, cp, s, e)
        used, local = np.unique(index, return_inverse=True)
        values = [self.cache.values[i] for i in used.tolist()]
        size = np.array([len(v) for v in values], np.int64)
        flat, begin = np.concatenate(values), np.cumsum(size) - size
        n = size[local]
        out_at = np.cumsum(n) - n
        ids = flat[np.repeat(begin[local] - out_at, n) + np.arange(int(n.sum()))]
        at = np.append(out_at, len(ids))[np.searchsorted(s, rows)]
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]

    def column(self, column: pa.Array):
        """Yields each row's ids in order."""
        for _, text, rows in decoded_slices(column):
            texts = [text[a:b] for a, b in zip(rows[:-1].tolist(), rows[1:].tolist())]
            if self.pattern is None or not self.pattern.search(text):
                yield from self._plain(texts)
                continue
            for t in texts:
                parts, last = [], 0
                for m in self.pattern.finditer(t):
                    parts += [self._plain([t[last : m.start()]])[0], self.special_values[m[0]]]
                    last = m.end()
                yield np.concatenate([*parts, self._plain([t[last:]])[0]])


def id_type(vocabulary: int) -> str:
    """The smallest unsigned little-endian type for ids below ``vocabulary``."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def write_shards(docs: DataFrame, path: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Writes the shards; returns ``(shard, first_id, docs, ids, width)``, one row a shard that has documents."""
    n = partitions(docs.sparkSession)
    placed = doc_text(docs).repartitionByRange(n, F.coalesce("doc_id", F.lit(_NULL_ID))).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    target = local_path(folder)

    def run(batches):
        from pyspark import TaskContext

        shard, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        tokenizer, kind = None, None
        os.makedirs(target, exist_ok=True)
        names = [f"{target}/{x}-{shard:05d}.bin" for x in ("ids", "offsets")]
        held = [f"{x}.{attempt}" for x in names]
        total = count = 0
        with open(held[0], "wb") as ids_file, open(held[1], "wb") as offsets_file:
            for batch in batches:
                if tokenizer is None:
                    tokenizer = WordTokenizer(path)
                    kind = id_type(max(tokenizer.size, end_id + 1))
                doc = batch.column(0).fill_null(_NULL_ID).to_numpy()
                sizes = []
                end = np.array([end_id], kind).tobytes()
                for ids in tokenizer.column(batch.column(1)):
                    ids_file.write(ids.astype(kind).tobytes() + end)
                    sizes.append(len(ids) + 1)
                ends = total + np.cumsum(sizes, dtype=np.int64)
                offsets_file.write(np.column_stack([doc, ends]).astype("<i8").tobytes())
                total, count = int(ends[-1]), count + len(sizes)
        for a, b in zip(held, names):
            os.replace(a, b)
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([count]), pa.array([total]), pa.array([int(kind[2])])], names=["shard", "docs", "ids", "width"])

    return placed.select("doc_id", "text").mapInArrow(run, "shard long, docs long, ids long, width long")


def read_shards(spark, folder: str, counts: list[tuple[int, int, int, int]]) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document from the mapped files of ``counts``'s shards."""
    rows, base = [], 0
    for shard, docs, ids, width in sorted(counts):
        rows.append((shard, base, docs, ids, width))
        base += ids
    target = local_path(folder)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    plan = spark.createDataFrame(rows, "shard long, base long, docs long, ids long, width long")

    def run(batches):
        for batch in batches:
            for shard, base, docs, total, width in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.memmap(f"{target}/ids-{shard:05d}.bin", f"<u{width}", "r")
                table = np.memmap(f"{target}/offsets-{shard:05d}.bin", "<i8", "r").reshape(-1, 2)
                if len(table) != docs or len(ids) != total:
                    raise OSError(f"shard {shard} has {len(table)} documents and {len(ids)} ids, not {docs} and {total}")
                for a in range(0, docs, 5000):
                    part = np.array(table[a : a + 5000])
                    ends = part[:, 1]
                    starts = np.append(table[a - 1, 1] if a else 0, ends[:-1])
                    crc = [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(starts.tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part[:, 0], mask=part[:, 0] == _NULL_ID), pa.array(base + starts), pa.array(ends - starts), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return plan.repartition(max(1, len(rows)), "shard").mapInArrow(run, schema)


def result(docs: DataFrame, path: str) -> DataFrame:
    spark = docs.sparkSession
    folder, manifest = new_path(spark, "tokens"), new_path(spark, "manifest")
    write(write_shards(docs, path, folder), manifest)
    counts = [tuple(r) for r in spark.read.schema("shard long, docs long, ids long, width long").parquet(manifest).collect()]  # one row a shard
    return read_shards(spark, folder, counts)
