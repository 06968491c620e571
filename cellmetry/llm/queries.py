"""Registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellmetry.llm import (
    decontaminate,
    hnsw,
    merkle,
    mixing,
    quality,
    secrets,
    simhash,
    spelling,
    token_counts,
    token_file,
    toxicity,
    warc,
    word_table,
)
from cellmetry.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = sql
        return run

    return keep


@query("op1_warc_salvage", warc.WARC_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op2_token_file")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_file.read_documents(token_file.write_tokens(table(spark, sf_dir, "documents"), path))


@query("op3_embedding_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.embedding_groups(table(spark, sf_dir, "embeddings"))


@query("op4_secret_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.toxicity_scores(docs, toxicity.train_toxicity(docs, labels))


@query("op6_quality_classifier")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.quality_scores(docs, quality.train_quality(docs, labels))


@query("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_counts.count_tokens(docs, ranks, public_tokenizers.PATTERN)


@query("op8_fair_mixing", mixing.MIX_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.fair_mix(table(spark, sf_dir, "documents")).drop("source")


@query("op9_decontamination", decontaminate.CONTAINED_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contained_items(docs, items).drop("text_hash")


@query("op10_simhash_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


@query("op11_word_table_bpe")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return word_table.document_digests(table(spark, sf_dir, "documents"), path)


@query("op12_spelling_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


@query("op13_merkle_manifest")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(merkle.manifest(table(spark, sf_dir, "documents")))
