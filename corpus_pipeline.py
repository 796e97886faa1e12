"""A training-text pipeline of five of the text operators.

Each stage takes all documents that its predecessor kept and returns the
columns of ``documents``; the last returns the encoded corpus. ``run`` writes
every stage as Parquet in the shared folder and reads it again, so a stage
never recomputes another and survives lost executors.

Defined results: a null text is the empty text in every stage. It is scored,
linked (all empty texts are one group), never contaminated, has no personal data
and encodes to no ids. Texts of any length are taken whole. A score of exactly
0.5 is kept. Of a group of near duplicates the row with the smallest ``doc_id``
stays, of equal ids the one with the smallest hash of its text; rows that repeat
both count as copies, and the one with the smallest hash of all its columns
stays. A null ``doc_id`` comes after all others, and is as good a row as any
else: it stays unless it is a near duplicate. Ids that repeat with different
texts are different documents. An empty table gives an empty result. All columns
of the input stay through all stages but the last, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, decontaminate, nearcopies, pii, quality, simhash
from weftline.llm.common import columns_of, discard, free_name, key, small_or_shuffled, table, text_hash, written
from weftline.llm.graph import components

#: Shingles of the near-duplicate stage.
SHINGLE_WORDS = 5
SIMILARITY = 0.8


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of at least 0.5)."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs, "score")
    return quality.score(docs, model, name).where(F.col(name) >= 0.5).select(*columns_of(docs))


def near_groups(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, label)`` of every document, as a written table; a group has one label.

    Texts are linked by their SimHash fingerprints, as op9 links them (2 of 64 bits at most), and by a shingle
    similarity of at least ``SIMILARITY``, which such fingerprints miss; a group is what is reachable over either.
    """
    copies = nearcopies.near_copies(docs, SHINGLE_WORDS, SIMILARITY)
    # Texts go by their hash, as ids may be null or repeat.
    prints = simhash.near_duplicates(docs.select(text_hash().alias("doc_id"), "text"))
    prints = written(prints.select(F.col("doc_id").alias("text_hash"), "component_id").distinct(), "prints")
    both = copies.select("text_hash", "label").distinct().join(prints, "text_hash").groupBy("component_id", "label").agg(F.lit(1).alias("one"))
    both = written(both.select("component_id", "label"), "both")
    several = both.groupBy("component_id").agg(F.min("label").alias("a"), F.max("label").alias("last")).where("a <> last").select("component_id", "a")
    links = written(both.join(several, "component_id").where("label <> a").select("a", F.col("label").alias("b")).distinct(), "links")
    discard(prints, both)
    if not links.limit(1).count():
        discard(links)
        return copies
    labels = components(links)
    joined = labels.select(F.col("node").alias("label"), F.col("label").alias("group"))
    out = written(copies.join(joined, "label", "left").select("doc_id", "text_hash", F.coalesce("group", "label").alias("label")), "groups")
    discard(copies, links, labels)
    return out


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate group, as the docstring of the module says.

    Groups are those of ``near_groups``. Ids and hashes of texts decide; whole rows are only compared where both repeat.
    """
    copies = near_groups(docs)
    found = copies.withColumn("place", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    groups = found.groupBy("label").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("label", "first")
    groups = written(groups, "groups")
    joined = found.join(small_or_shuffled(groups), "label")
    k, h = free_name(docs, "_key"), free_name(docs, "_text_hash")
    named = lambda rows: rows.select(key().alias(k), F.col("text_hash").alias(h)).distinct()
    drop = written(named(joined.where("place <> first")), "dropped")
    again = written(named(joined.where("place = first").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")), "repeated")
    discard(copies, groups)
    marked = docs.withColumns({k: key(), h: text_hash()}).join(small_or_shuffled(drop), [k, h], "left_anti")
    if not again.limit(1).count():
        return marked.select(*columns_of(docs))
    repeats = marked.join(small_or_shuffled(again), [k, h], "left_semi")
    whole = F.struct(*columns_of(docs))
    one = repeats.groupBy(k, h).agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("_row")).select("_row.*")
    return marked.join(small_or_shuffled(again), [k, h], "left_anti").select(*columns_of(docs)).unionByName(one)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and disclosing terms generalised in their texts."""
    clean = pii.sanitised(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with a digest of its round trip.

    The digests are written here, as ``written`` hands texts to Python in smaller batches than the session would.
    """
    rows = bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), ids=False, text=False)
    return written(rows.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), "encoded")


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmarks),
    ("pii", without_personal_data),
    ("encoding", encoded),
]

#: SQL has no trained classifier, no minimum hashes and no BPE; tests/llm compares each stage's operator with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
