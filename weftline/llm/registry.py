"""The text queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers

from . import bpe, covertree, decontaminate, fingerprint, forest, langid, ngram, phrases, pii, quality, simhash, tokenfile, whitening
from .common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("op1_document_fingerprints")
def op1(spark, sf_dir):
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


@query("op2_quality_classifier")
def op2(spark, sf_dir):
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_bpe_lexicon")
def op5(spark, sf_dir):
    return bpe.result(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op7_token_files")
def op7(spark, sf_dir):
    return tokenfile.result(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op9_simhash_near_dedup")
def op9(spark, sf_dir):
    return simhash.result(table(spark, sf_dir, "documents"))


@query("op10_language_id")
def op10(spark, sf_dir):
    return langid.result(table(spark, sf_dir, "documents"))


@query("op8_lm_scoring")
def op8(spark, sf_dir):
    return ngram.result(table(spark, sf_dir, "documents"))


@query("op4_benchmark_decontamination", decontaminate.SQL)
def op4(spark, sf_dir):
    return decontaminate.result(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_pii_sanitisation")
def op6(spark, sf_dir):
    return pii.result(table(spark, sf_dir, "documents"))


@query("op3_suffix_dedup")
def op3(spark, sf_dir):
    return phrases.result(table(spark, sf_dir, "documents"))


@query("op13_vector_codes", covertree.SQL)
def op13(spark, sf_dir):
    return covertree.result(table(spark, sf_dir, "embeddings"))


@query("op12_embedding_whitening")
def op12(spark, sf_dir):
    return whitening.result(table(spark, sf_dir, "embeddings"))


@query("op11_embedding_near_dedup", forest.SQL)
def op11(spark, sf_dir):
    return forest.result(table(spark, sf_dir, "embeddings"))
