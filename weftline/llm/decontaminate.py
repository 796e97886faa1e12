"""Benchmark decontamination by winnowing, with DataFrame functions only.

Texts become words: ASCII letters in lower case, runs of letters, digits and
non-ASCII characters. Hashes of five-word grams are taken, and of every six
consecutive ones the smallest is kept. Two texts that share ten words in a row
share the six grams in them, so they share a kept hash. The kept hashes of
documents are written once, with the number of words, and joined with those of
benchmark items; only documents with a hit are read again. There every gram
with a kept hash of the benchmark is extended to the ten-word windows of the
item around it and verified word by word. An item of one to nine words is one
window; its whole hash is looked up among all grams of its length, only for the
lengths that occur. Hashes are of each word by itself in Unicode lower case, which is
fast; words that are equal as defined (A-Z in lower case) are so in Unicode lower case
too, whatever stands around them. The check uses the words as they are defined.

Fingerprints of the benchmark are broadcast only if their counted rows are
within a bound; beyond it, document and benchmark fingerprints are shuffled by
hash. A fingerprint carries the few words that a window around it can reach, and
equal passages of several items are one row, so its size doesn't depend on the
length of an item.

Defined results: a null text has no words and is never contaminated; a text of
any length is searched whole; an item without words occurs nowhere; an item
whose id is null marks words but isn't listed; items of one id count once (ties
of ids don't matter, as ids are listed in order); a null ``doc_id`` stays null;
document rows that repeat get equal results; empty tables give no hits; other
columns are ignored, or stay in ``decontaminated``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, free_name, key, small_or_shuffled, text_hash, written

GRAM = 5
WINDOW = 10
#: Fingerprint rows of a benchmark that may be broadcast (each carries some fifteen words).
BROADCAST_FINGERPRINTS = 200_000
#: Short items whose hashes are looked up as each document is read; of more, all grams of their lengths are written.
SHORT_ITEMS = 2_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before A-Z are in lower case.
RAW_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words on each side of a hit that a window around it can reach, and the words that a hit carries.
REACH = WINDOW - GRAM
LOCAL = REACH + WINDOW
PLACES = "array<struct<p:int,fp:bigint,k:int>>"


def _cut(text: Column, gap: str = GAP) -> Column:
    """Cut at what can't be in a word, which is several times faster than gathering matches."""
    return F.filter(F.split(text, gap), lambda w: w != "")  # the first and last may be empty


def words(text: str) -> Column:
    return _cut(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER))


def word_hashes(text: str) -> Column:
    """One hash for each of ``words(text)``; words are put in lower case one by one, as a whole text's lower case depends on what stands around."""
    return F.transform(_cut(F.coalesce(F.col(text).cast("string"), F.lit("")), RAW_GAP), lambda w: F.xxhash64(F.lower(w)))


def bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with ``x`` evaluated once."""
    return F.element_at(F.transform(F.array(x), use), 1)


def _overlaid(x: Column, y: Column, shift: int, n: Column, f: Callable) -> Column:
    """``f(x[i], y[i + shift])`` for the first ``n`` places."""
    n = F.greatest(n, F.lit(0))
    return F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(shift + 1), n), f)


def grams(h: Column, k: int) -> Column:
    """Hashes of all ``k`` consecutive values of ``h``, in order, by halves."""
    if k == 1:
        return h
    half = 1 << ((k - 1).bit_length() - 1)
    n = F.size(h) - (k - 1)
    if 2 * half == k:
        return bound(grams(h, half), lambda x: _overlaid(x, x, half, n, lambda a, b: F.xxhash64(a, b)))
    return _overlaid(grams(h, half), grams(h, k - half), half, n, lambda a, b: F.xxhash64(a, b))


def sliding(x: Column, w: int, f: Callable) -> Column:
    """``f`` (least or greatest) of every ``w`` consecutive values of ``x``."""
    if w == 1:
        return x
    half = (w + 1) // 2
    return bound(x, lambda v: bound(sliding(v, half, f), lambda y: _overlaid(y, y, w - half, F.size(v) - (w - 1), f)))


def kept(h: Column) -> Column:
    """The smallest of the gram hashes of every window of words, each once; ``h`` are the hashes of the words."""
    n = WINDOW - GRAM + 1
    least = bound(grams(h, GRAM), lambda g: sliding(g, n, lambda a, b: F.least(a, b)))
    return F.when(F.size(h) >= WINDOW, F.array_distinct(least)).otherwise(F.array().cast("array<bigint>"))


def all_grams(h: Column, k: int, only: list[int] | None) -> Column:
    """Hashes of all k-word grams, or of those that ``only`` has."""
    found = grams(h, k) if only is None else F.filter(grams(h, k), lambda x: x.isin(only))
    return F.when(F.size(h) >= k, found).otherwise(F.array().cast("array<bigint>"))


def places(h: Column, k: int) -> Column:
    """``(p, fp, k)`` of all k-word grams of a short text, from place 1 on."""
    found = F.transform(grams(h, k), lambda x, i: F.struct((i + 1).cast("int").alias("p"), x.alias("fp"), F.lit(k).alias("k")))
    return F.when(F.size(h) >= k, found).otherwise(F.array().cast(PLACES))


def placed(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """``rows(h, ..)`` once for each gram of the lengths: ``(.., p, fp, k)``.

    The grams are plain hashes in one list, the lengths one after another, so a
    gram of a long text takes few bytes; place and length follow from the index.
    """
    n = F.size("h")
    listed = F.concat(*[all_grams(F.col("h"), k, None) for k in lengths])
    rest = [c for c in rows.columns if c != "h"]
    spread = rows.select(*rest, n.alias("_n"), listed.alias("_g")).select(*rest, "_n", F.posexplode_outer("_g").alias("_i", "fp"))
    chain = lambda i: F.greatest(F.lit(0), F.col("_n") - (lengths[i] - 1))
    k, p, before = F.lit(lengths[0]), F.col("_i") + 1, F.lit(0)
    for i in range(1, len(lengths)):
        before = before + chain(i - 1)
        k, p = F.when(F.col("_i") >= before, lengths[i]).otherwise(k), F.when(F.col("_i") >= before, F.col("_i") - before + 1).otherwise(p)
    return spread.select(*rest, p.cast("int").alias("p"), "fp", k.cast("int").alias("k"))


def _local(array: Column, p: Column) -> Column:
    """``(before, near)``: the words around place ``p`` and how many of them come before it."""
    low = F.greatest(F.lit(1), p - REACH)
    return F.struct((p - low).alias("before"), F.slice(array, low, F.lit(LOCAL)).alias("near"))


def benchmark_fingerprints(benchmark: DataFrame) -> DataFrame:
    """``(fp, k, span, own, item_ids)``: grams with a kept hash, gram length, window length, the words around and the items that have them."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words("text").alias("item"), word_hashes("text").alias("h")).where("size(item) > 0").distinct()
    # A kept hash marks every place of its gram: which of equal grams a window means is open.
    long = items.where(F.size("item") >= WINDOW).select("item_id", "item", bound(kept(F.col("h")), lambda m: F.filter(places(F.col("h"), GRAM), lambda z: F.array_contains(m, z["fp"]))).alias("z"))
    long = long.select("item_id", "item", F.explode_outer("z").alias("z")).select(F.col("z.fp").alias("fp"), F.col("z.k").alias("k"), F.lit(WINDOW).alias("span"), _local(F.col("item"), F.col("z.p")).alias("own"), "item_id")
    whole = F.coalesce(*[F.when(F.size("item") == k, F.element_at(grams(F.col("h"), k), 1)) for k in range(1, WINDOW)])
    short = items.where(F.size("item") < WINDOW).select(whole.alias("fp"), F.size("item").alias("k"), F.size("item").alias("span"), _local(F.col("item"), F.lit(1)).alias("own"), "item_id")
    return long.unionByName(short).groupBy("fp", "k", "span", "own").agg(F.collect_set("item_id").alias("item_ids"))


def fingerprinted(docs: DataFrame, short: dict[int, list[int] | None]) -> DataFrame:
    """``(doc_id, key, text_hash, n_words, fps)`` of every document: kept hashes and grams of the lengths of short items."""
    hashed = bound(word_hashes("text"), lambda h: F.struct(F.size(h).cast("long").alias("n"), F.concat(kept(h), *[all_grams(h, k, only) for k, only in sorted(short.items())]).alias("fps")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key().alias("key"), text_hash().alias("text_hash"), hashed.alias("w"))
    return rows.select("doc_id", "key", "text_hash", F.col("w.n").alias("n_words"), F.col("w.fps").alias("fps"))


def _verified() -> Column:
    """Zero-based starts in the document of the item's windows that a hit extends to."""
    return F.expr(
        "transform(filter(sequence(0, span - k), s -> s <= there.before AND s <= own.before AND there.before - s + span <= size(there.near) "
        "AND own.before - s + span <= size(own.near) AND slice(there.near, there.before - s + 1, span) = slice(own.near, own.before - s + 1, span)), s -> struct(p - s - 1 AS start, span AS span))"
    )


def searched(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows, found)``: ``(doc_id, key, text_hash, n_words)`` of all documents, and ``(key, text_hash, starts, item_ids)`` of those with verified windows.

    Kept hashes are joined without words, so a hit is a small row however long
    its document is. Only documents with a hit are read again; each hit then
    takes the few words around it along.
    """
    prints = written(benchmark_fingerprints(benchmark), "benchmark")
    n = prints.count()
    small = n <= BROADCAST_FINGERPRINTS
    side = lambda df: F.broadcast(df) if small else df
    lengths = prints.where(F.col("span") < WINDOW).groupBy("k").agg(F.count_distinct("fp").alias("n")).collect()  # at most nine
    few = sum(r["n"] for r in lengths) <= SHORT_ITEMS
    hashes = prints.where(F.col("span") < WINDOW).select("k", "fp").distinct().collect() if few and lengths else []
    rows = written(fingerprinted(docs, {r["k"]: [x["fp"] for x in hashes if x["k"] == r["k"]] if few else None for r in lengths}), "fingerprints")
    flat = rows.select("key", "text_hash", F.explode("fps").alias("fp"))
    met = written(flat.join(side(prints.select("fp").distinct()), "fp").select("key", "text_hash").distinct(), "met")
    texts = docs.select(key().alias("key"), text_hash().alias("text_hash"), "text")
    again = texts.join(small_or_shuffled(met), ["key", "text_hash"]).select("key", "text_hash", word_hashes("text").alias("h"))
    # Grams are joined one by one without the words; then each hit takes the few words around it along.
    hit = placed(again, sorted({GRAM, *(r["k"] for r in lengths)})).join(side(prints.select("fp", "k").distinct()), ["fp", "k"])
    hits = written(hit.groupBy("key", "text_hash").agg(F.collect_set(F.struct("p", "fp", "k")).alias("hits")), "hits")
    around = bound(words("text"), lambda w: F.transform("hits", lambda z: F.struct(z["p"].alias("p"), z["fp"].alias("fp"), z["k"].alias("k"), _local(w, z["p"]).alias("there"))))
    spelled = texts.join(small_or_shuffled(hits, weight=F.size("hits")), ["key", "text_hash"]).select("key", "text_hash", around.alias("z"))
    # explode_outer: an inner explode would have its filter pushed below, where words are cut anew for every hit.
    located = spelled.select("key", "text_hash", F.explode_outer("z").alias("z")).select("key", "text_hash", "z.*").join(side(prints), ["fp", "k"])
    checked = located.select("key", "text_hash", "item_ids", _verified().alias("at")).where("size(at) > 0")
    found = checked.groupBy("key", "text_hash").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("at")))).alias("starts"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids")
    )
    return rows.select("doc_id", "key", "text_hash", "n_words"), found


COVERED = (
    "aggregate(starts, struct(0 AS reach, 0L AS n), (a, s) -> struct(greatest(a.reach, s.start + s.span) AS reach, "
    "a.n + greatest(0, s.start + s.span - greatest(s.start, a.reach)) AS n), a -> a.n)"
)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents in which a benchmark window occurs; all columns stay."""
    _, found = searched(docs, benchmark)
    k, h = free_name(docs, "_key"), free_name(docs, "_text_hash")
    found = small_or_shuffled(written(found.select(F.col("key").alias(k), F.col("text_hash").alias(h)), "contaminated"))
    return docs.withColumns({k: key(), h: text_hash()}).join(found, [k, h], "left_anti").select(*columns_of(docs))


def result(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    rows, found = searched(docs, benchmark)
    found = small_or_shuffled(written(found.select("key", "text_hash", F.expr(COVERED).alias("n_hit"), "item_ids"), "found"), weight=F.size("item_ids"))
    return rows.join(found, ["key", "text_hash"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("item_ids").cast("long"), F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce(F.array_join("item_ids", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


#: The same result in DuckDB: all ten-word windows joined as strings.
SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), spans AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM spans),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)
), found AS (SELECT doc_id, item_id, n, i FROM grams JOIN spans USING (n, gram)),
marks AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM found)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marks USING (doc_id) LEFT JOIN items USING (doc_id)
"""
