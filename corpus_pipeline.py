"""The corpus pipeline: documents are judged, deduplicated, cleaned, mixed and encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's docs.  All but the last return the columns of
documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cellmetry.llm.common import table
from cellmetry.llm.decontaminate import without_items
from cellmetry.llm.mixing import mixed_documents
from cellmetry.llm.near_copies import near_copies_removed
from cellmetry.llm.quality import good_documents
from cellmetry.llm.token_file import read_documents, write_tokens
from cellmetry.session import cut_lineage, ship

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

#: A fitted model and the order of a sample have no SQL; the stages are tested by brute force.
ORACLE_SQL = None


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    ship(spark)
    return good_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-copies: SimHash with Golay keys, MinHash bands for the rest."""
    ship(spark)
    return near_copies_removed(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship(spark)
    return without_items(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    ship(spark)
    return mixed_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the documents, read back: doc_id, start, n_tokens, ids_crc32."""
    ship(spark)
    # Workers of earlier stages hold memory too: fewer words are kept than by default.
    return read_documents(write_tokens(docs, TOKENIZER, cache=100_000))


STAGES = [
    ("quality", judge_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("tokens", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
