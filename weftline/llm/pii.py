"""Personal data: base patterns, and terms that reveal them, with DataFrame functions only.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers.
A pattern is cut into spans with a split and an extraction of the same regular
expression: a match starts after the pieces and matches before it. Loops over
groups would recurse in the regular expression engine, so separators that
can't belong to a match are first replaced by a sign outside it, of the same
length; then a match is a plain run.

The protected entities are the base values. For every term near one (words in a
window of characters on both sides) the corpus tells how strongly it reveals
the entity. All counts are of term occurrences: ``n(t, e)``, in how many
different contexts the term stands near it, against ``n(t)``, all different
contexts of the term: those near any entity and, for occurrences near none,
those of ``AROUND`` words on both sides; ``n(e)``, the different occurrences of
any terms near the entity, against all term occurrences of the corpus. A term
with at least ``SUPPORT`` contexts near the entity, which are at least ``SHARE``
of its contexts, and a pointwise mutual information
``log2(n(t, e) / n(t) / (n(e) / n))`` of ``BITS`` or more, is disclosing: its
occurrences everywhere become spans of kind ``term``. Copies of a passage are one
context, and copies of a text count once.

Lists are gathered in chunks of about the square root of their length, and texts
are cut in blocks, so the time for a long text stays near its length.

Defined results: a null text is the empty text and has no spans; a text of any
length is searched whole; equal starts are ordered by kind (email, ip, card,
phone, term), then end; a null ``doc_id`` stays null; repeated rows get equal
results; an empty table gives an empty result; other columns pass through
``sanitised`` and are ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, columns_of, free_name, small_or_shuffled, written
from .common import key as doc_key
from .common import text_hash as hashed_text

KINDS = ("email", "ip", "card", "phone", "term")
#: Characters on each side of a base span that form its context.
NEAR = 48
#: Words on each side of a term that form its context where no base span is near.
AROUND = 7
SUPPORT = 3
SHARE = 0.5
#: How much likelier the entity must be near the term than near any term, as a power of two.
BITS = 3.0
TERM = r"[\p{L}\p{N}]{3,}+"
NO_TERM = r"[^\p{L}\p{N}]+"
TERM_CHARS = 3
#: Characters of a block that texts are cut in.
BLOCK = 512
LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9][0-9\x20-]{11,}+"
CARD_THERE = r"[0-9](?:[\x20-]?[0-9]){11}"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
MATCH = "array<struct<start:int,end:int,value:string>>"
RANKED = "array<struct<start:int,rank:int,end:int,value:string>>"


def _bound(x: Column, use) -> Column:
    """``use(x)`` with ``x`` evaluated once."""
    return F.element_at(F.transform(F.array(x), use), 1)


def _gathered(items: Column, state: Column, kind: str, step) -> Column:
    """What ``step(state, item)`` gives, in order: ``(next state, whether to keep, value)``; values are of type ``kind``.

    Appending copies a list, so items are taken in chunks of about the square root of their number.
    """
    none, nothing = F.array().cast(f"array<array<{kind}>>"), F.array().cast(f"array<{kind}>")

    def one(a, z):
        after, keep, value = step(a["s"], z)
        return F.struct(after.alias("s"), F.when(keep, F.array_append(a["out"], value)).otherwise(a["out"]).alias("out"))

    def many(a, chunk):
        inner = F.aggregate(chunk, F.struct(a["s"].alias("s"), nothing.alias("out")), one)
        return _bound(inner, lambda r: F.struct(r["s"].alias("s"), F.array_append(a["out"], r["out"]).alias("out")))

    def chunked(xs):
        n = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(xs).cast("double"))).cast("int"))
        return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(xs) - 1) / n)).cast("int")), lambda k: F.slice(xs, k * n + 1, n))

    return F.aggregate(_bound(items, chunked), F.struct(state.alias("s"), none.alias("out")), many, lambda a: F.flatten(a["out"]))


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))


def _cut(blocks: Column, start: Column, length: Column) -> Column:
    """``length`` characters from ``start`` (zero-based) of a text in blocks."""
    length = F.greatest(length, F.lit(0))
    first, ahead = F.floor(start / BLOCK).cast("int"), start % BLOCK
    touched = F.floor((ahead + length) / BLOCK).cast("int") + 1
    return F.when(length > 0, F.substr(F.array_join(F.slice(blocks, first + 1, touched), ""), ahead + 1, length)).otherwise("")


def _spans(x: Column, pattern: str, there: Column) -> Column:
    """All matches of ``pattern`` in ``x``.

    One pass over the pieces before the matches and the matches themselves; both
    are arguments of the fold, not of its function, so they are cut once.
    """
    pieces = F.arrays_zip(F.split(x, pattern, -1).alias("gap"), F.regexp_extract_all(x, F.lit(pattern), F.lit(0)).alias("hit"))

    def step(at, z):
        start = at + F.length(z["gap"])
        end = start + F.length(z["hit"])
        return end, z["hit"].isNotNull(), F.struct(start.alias("start"), end.alias("end"), z["hit"].alias("value"))

    return F.when(there, _gathered(pieces, F.lit(0), MATCH[6:-1], step)).otherwise(F.array().cast(MATCH))


def _ranked(rank: int):
    return lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), m["value"].alias("value"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.split(F.reverse(_digits(value)), "")
    digits = F.filter(digits, lambda d: d != "")

    def worth(d, i):
        n = d.cast("int")
        return F.when(i % 2 == 0, n).when(n > 4, 2 * n - 9).otherwise(2 * n)

    return F.aggregate(F.transform(digits, worth), F.lit(0), lambda s, v: s + v) % 10 == 0


def base_spans(text: Column) -> Column:
    """Array of ``(start, rank, end, value)`` sorted by start, then kind; an email's dots that can't part labels are ``%`` in its value."""
    has = lambda sign: F.instr(text, sign) > 0
    edge = r"\.(?![A-Za-z0-9-])|(?<![A-Za-z0-9-])\."
    email = _spans(F.regexp_replace(text, edge, "%"), EMAIL, has("@"))
    ip = F.filter(_spans(text, IP, text.rlike(r"[0-9]\.[0-9]")), lambda m: F.forall(F.split(m["value"], r"\."), lambda p: p.try_cast("double") <= 255))
    gap = r"[\x20-](?![0-9])|(?<![0-9])[\x20-]"
    card = F.filter(
        _spans(F.regexp_replace(text, gap, "x"), CARD, text.rlike(CARD_THERE)),
        lambda m: F.length(_digits(m["value"])).between(12, 19) & _luhn(m["value"]),
    )
    phone = F.filter(_spans(text, PHONE, has("+")), lambda m: F.length(_digits(m["value"])).between(9, 15))
    lists = []
    for rank, found in enumerate((email, ip, card, phone)):
        lists.append(F.coalesce(F.transform(found, _ranked(rank)), F.array().cast(RANKED)))
    return F.array_sort(F.concat(*lists))


def _words(x: Column) -> Column:
    """The terms of ``x`` in order, each put in lower case by itself, as its neighbours may change what a whole text's lower case is."""
    return F.transform(F.filter(F.split(x, NO_TERM), lambda w: F.length(w) >= TERM_CHARS), lambda w: F.lower(w))


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def with_base(docs: DataFrame) -> DataFrame:
    """``(doc_id, key, text_hash, n_terms, base, near)``; near: each base value with the distinct terms and the hash of its context."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc_key().alias("key"), hashed_text().alias("text_hash"), _text().alias("text"))
    rows = rows.select("doc_id", "key", "text_hash", "text", F.size(F.filter(F.split("text", NO_TERM), lambda w: F.length(w) >= TERM_CHARS)).alias("n_terms"), base_spans(F.col("text")).alias("base"))

    def context(blocks):
        def one(m):
            left = F.greatest(F.lit(0), m["start"] - NEAR)
            before, after = _cut(blocks, left, m["start"] - left), _cut(blocks, m["end"], F.lit(NEAR))
            return _bound(
                F.struct(before.alias("b"), after.alias("a")),
                lambda c: F.struct(
                    F.concat_ws(":", m["rank"].cast("string"), F.lower(m["value"])).alias("entity"),
                    F.xxhash64(c["b"], c["a"]).alias("context"),
                    F.array_distinct(_words(F.concat_ws(" ", F.regexp_replace(c["b"], r"^[\p{L}\p{N}]++", ""), F.regexp_replace(c["a"], r"[\p{L}\p{N}]++$", "")))).alias("terms"),
                ),
            )

        return F.transform("base", one)

    near = _bound(F.when(F.size("base") > 0, _blocks(F.col("text"))).otherwise(F.array().cast("array<string>")), context)
    return rows.select("doc_id", "key", "text_hash", "n_terms", "base", near.alias("near"))


def _far(text: Column, base: Column) -> Column:
    """``text`` without the base values and the whole words that ``with_base`` takes as their contexts."""

    def pieces(blocks):
        def edge(m):
            left = F.greatest(F.lit(0), m["start"] - NEAR)
            before, after = _cut(blocks, left, m["start"] - left), _cut(blocks, m["end"], F.lit(NEAR))
            first = left + F.length(F.regexp_extract(before, r"^[\p{L}\p{N}]++", 0))
            last = m["end"] + F.length(F.regexp_replace(after, r"[\p{L}\p{N}]++$", ""))
            return F.struct(first.alias("first"), last.alias("last"))

        whole = F.array(F.struct(F.length(text).alias("first"), F.length(text).alias("last")))
        return _gathered(F.concat(F.transform(base, edge), whole), F.lit(0), "string", lambda at, z: (F.greatest(at, z["last"]), z["first"] > at, _cut(blocks, at, z["first"] - at)))

    return F.array_join(_bound(_blocks(text), pieces), " ")


def _contexts(x: Column) -> Column:
    """Array of ``(term, context)`` of the words of ``x``; the words are bound to a name, so they are cut once."""

    def each(ws):
        return F.transform(ws, lambda w, i: F.struct(w.alias("term"), F.xxhash64(F.slice(ws, F.greatest(F.lit(1), i + 1 - AROUND), F.least(i, F.lit(AROUND)) + 1 + AROUND)).alias("context")))

    return F.element_at(F.transform(F.array(_words(x)), each), 1)


def disclosing_terms(docs: DataFrame, based: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """``(terms, occurrences)``: disclosing ``(term)`` and ``(key, text_hash, term)`` of all candidates; None if there is no candidate."""
    near = based.select(F.explode("near").alias("c")).select("c.entity", "c.context", F.explode("c.terms").alias("term")).distinct()
    near = written(near, "near")
    everywhere = near.groupBy("term").agg(F.count(F.lit(1)).alias("n_ctx"))
    support = near.groupBy("term", "entity").agg(F.count(F.lit(1)).alias("n_te")).where(F.col("n_te") >= SUPPORT)
    # A term that stands near many entities can't reach the share with any, so it needn't be counted.
    support = written(support.join(everywhere, "term").where(F.col("n_te") / F.col("n_ctx") >= SHARE), "support")
    n = support.count()
    if not n:
        return None
    candidates = support.select("term").distinct()
    candidates = F.broadcast(candidates) if n <= BROADCAST_ROWS else candidates
    far = _bound(base_spans(_text()), lambda base: F.when(F.size(base) > 0, _far(_text(), base)).otherwise(_text()))
    # explode_outer: an inner explode would have its filter pushed below and cut words twice.
    said = docs.select(doc_key().alias("key"), hashed_text().alias("text_hash"), F.explode_outer(_contexts(far)).alias("c"))
    said = said.select("key", "text_hash", "c.term", "c.context")
    away = written(said.join(candidates, "term").distinct(), "away")
    beside = based.select("key", "text_hash", F.explode("near").alias("c")).select("key", "text_hash", F.explode("c.terms").alias("term")).join(candidates, "term")
    seen = away.select("key", "text_hash", "term").unionByName(beside.select("key", "text_hash", "term"))
    total = based.select("text_hash", "n_terms").distinct().agg(F.sum("n_terms")).first()[0] or 1
    often = away.select("term", "context").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_far"))
    entities = near.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    share = F.col("n_te") / (F.col("n_ctx") + F.coalesce("n_far", F.lit(0)))
    bits = F.log2(share / (F.col("n_e") / F.lit(float(total))))
    terms = support.join(often, "term", "left").join(entities, "entity").where((share >= SHARE) & (bits >= BITS)).select("term").distinct()
    return written(terms, "terms"), seen


def term_spans(docs: DataFrame, terms: DataFrame, seen: DataFrame) -> DataFrame:
    """``(key, text_hash, marks)``: the occurrences of disclosing terms in the documents that have them.

    Only these documents are read again; their words are joined with the terms one by one.
    """
    held = written(seen.join(terms, "term", "left_semi").select("key", "text_hash").distinct(), "held")
    rows = docs.select(doc_key().alias("key"), hashed_text().alias("text_hash"), _text().alias("text"))
    found = rows.join(small_or_shuffled(held), ["key", "text_hash"])
    every = found.select("key", "text_hash", F.explode_outer(_spans(F.col("text"), TERM, F.lit(True))).alias("m"))
    words = every.select("key", "text_hash", _ranked(KINDS.index("term"))(F.col("m")).alias("m"), F.lower("m.value").alias("term"))
    return words.join(small_or_shuffled(terms), "term", "left_semi").groupBy("key", "text_hash").agg(F.array_sort(F.collect_set("m")).alias("marks"))


def marked(docs: DataFrame) -> DataFrame:
    """``(doc_id, key, text_hash, base, spans)`` of every document."""
    based = written(with_base(docs), "base")
    found = disclosing_terms(docs, based)
    if found is None:
        return based.select("doc_id", "key", "text_hash", "base", F.col("base").alias("spans"))
    more = written(term_spans(docs, *found), "marks")
    more = small_or_shuffled(more, weight=F.size("marks"))
    none = F.array().cast(RANKED)
    # A term that overlaps a base span is part of it: seen from the left, one that reaches into it; from the right, one that starts in it.
    kind, is_term = RANKED[6:-1], lambda m: m["rank"] == KINDS.index("term")
    both = F.array_sort(F.concat("base", F.coalesce("marks", none)))
    left = _gathered(both, F.lit(0), kind, lambda reach, m: (F.when(is_term(m), reach).otherwise(F.greatest(reach, m["end"])), ~is_term(m) | (m["start"] >= reach), m))
    right = _gathered(F.reverse(left), F.lit((1 << 31) - 1), kind, lambda begin, m: (F.when(is_term(m), begin).otherwise(m["start"]), ~is_term(m) | (m["end"] <= begin), m))
    spans = F.when(F.size(F.coalesce("marks", none)) > 0, F.reverse(right)).otherwise(F.col("base"))
    return based.join(more, ["key", "text_hash"], "left").select("doc_id", "key", "text_hash", "base", spans.alias("spans"))


def _listed(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", F.element_at(names, m["rank"] + 1), m["start"].cast("string"), m["end"].cast("string"))), ",")


def result(docs: DataFrame) -> DataFrame:
    count = lambda r: F.size(F.filter("base", lambda m: m["rank"] == r)).cast("long")
    return marked(docs).select(
        "doc_id",
        *[count(r).alias(f"n_{k}") for r, k in enumerate(KINDS[:4])],
        F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"),
        _listed("spans").alias("spans"),
    )


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets; overlapping spans become one, named by the first."""
    k, h, sp = (free_name(docs, x) for x in ("_key", "_text_hash", "_spans"))
    found = marked(docs).where("size(spans) > 0").dropDuplicates(["key", "text_hash"])
    found = small_or_shuffled(written(found.select(F.col("key").alias(k), F.col("text_hash").alias(h), F.col("spans").alias(sp)), "spans"), weight=F.size(sp))
    rows = docs.withColumns({k: doc_key(), h: hashed_text()})
    names = F.array(*[F.lit(f"[{n.upper()}]") for n in KINDS])
    end = F.array(F.struct(F.length(_text()).alias("start"), F.lit(len(KINDS)).alias("rank"), F.length(_text()).alias("end"), F.lit("").alias("value")))

    def pieces(blocks):
        def step(at, m):
            return F.greatest(at, m["end"]), m["start"] >= at, F.concat(_cut(blocks, at, m["start"] - at), F.coalesce(F.get(names, m["rank"]), F.lit("")))

        return _gathered(F.concat(sp, end), F.lit(0), "string", step)

    clean = F.array_join(_bound(_blocks(_text()), pieces), "")
    joined = rows.join(found, [k, h], "left")
    return joined.select(*[F.when(F.col(sp).isNull(), F.col("text")).otherwise(clean).alias("text") if c == "text" else x for c, x in zip(docs.columns, columns_of(docs))])
