"""Helpers shared by the corpus operators: tables, words, held-out rows, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmetry.session import cut_lineage, discard

# White space is the six ASCII characters; words are what lies between.
WORD = "[^\\x20\\x09-\\x0D]+"
LOWER_ASCII = {i: i + 32 for i in range(65, 91)}

#: Rows of a side that is broadcast by hint; a larger side is left to a shuffle join.
MAX_BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """The side of a join, with a broadcast hint only when its counted rows are few."""
    return F.broadcast(df) if rows <= MAX_BROADCAST_ROWS else df


def crc_remainder(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def _listed(ids: DataFrame) -> DataFrame:
    """Distinct ids, written and counted: few are broadcast, so that texts stay in place."""
    listed = cut_lineage(ids.select(F.col(ids.columns[0]).alias("__listed_id")).distinct())
    return small_side(listed, listed.count())


def keep_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of docs whose id is listed, null with null; all columns of docs stay."""
    listed = _listed(ids)
    return docs.join(listed, docs[id_col].eqNullSafe(F.col("__listed_id")), "left_semi")


def drop_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of docs whose id is not listed, null with null; all columns of docs stay."""
    listed = _listed(ids)
    return docs.join(listed, docs[id_col].eqNullSafe(F.col("__listed_id")), "left_anti")


def text_hash() -> Column:
    """Beside the id it names a text: rows of one id may hold different texts."""
    return F.xxhash64(F.col("text").cast("string"))


def _with_texts(docs: DataFrame, texts: DataFrame, how: str) -> DataFrame:
    listed = cut_lineage(
        texts.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    )
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (
        F.xxhash64(docs["text"].cast("string")) == F.col("__hash")
    )
    return docs.join(small_side(listed, listed.count()), same, how)


def keep_texts(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows of docs whose (doc_id, text_hash) is listed; all columns of docs stay."""
    return _with_texts(docs, texts, "left_semi")


def drop_texts(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows of docs whose (doc_id, text_hash) is not listed; all columns of docs stay."""
    return _with_texts(docs, texts, "left_anti")


def one_row_each(docs: DataFrame) -> DataFrame:
    """One of the rows of each (doc_id, text); they are equal but for other columns."""
    return docs.withColumn("__hash", text_hash()).dropDuplicates(["doc_id", "__hash"]).drop("__hash")


def components(links: DataFrame) -> DataFrame:
    """Links (u, v) to (node, component), the component named by its smallest node.

    Alternating large-star and small-star steps until the links no longer change;
    every step is a few joins on the links, written to the shared folder.  Nodes
    without a link to another node are not returned.
    """
    edges = cut_lineage(
        links.where("u <> v")
        .select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b"))
        .distinct()
    )
    mark = None
    while True:
        around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = around.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        lowest = lowest.select("n", F.least("n", "m").alias("m"))
        large = (
            edges.join(lowest, F.col("b") == F.col("n"))
            .select("a", F.col("m").alias("b"))
            .distinct()
        )
        near = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = (
            large.join(near, F.col("a") == F.col("n"))
            .where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(near.select(F.col("n").alias("a"), F.col("m").alias("b")))
        )
        before, edges = edges, cut_lineage(small.distinct())
        discard(before)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == mark:
            named = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            named._written_to = edges._written_to  # the caller may discard it
            return named
        mark = now
