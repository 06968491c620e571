"""Benchmark decontamination: containment MinHash by size partition, then exact shingles.

A short test item inside a long document has a tiny Jaccard similarity to it, so no
MinHash sketch of the document can find it.  Containment MinHash sketches the item only:
its k smallest shingle hashes are looked up among all shingle hashes of a document.
Items are partitioned by size (powers of two of their shingles), and k is set per
partition so that a document that holds the wanted share of the item's shingles holds at
least one of the k: nothing is missed.  Candidates are verified on the shingles themselves.

Only DataFrame functions are used.  Documents are not shuffled to find candidates as long
as the sketches are few; beyond that count they are joined by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmetry.llm.common import small_side
from cellmetry.session import cut_lineage

SHINGLE = 5
#: Fixed value: words are runs of letters, marks and digits.
SEPARATOR = "[^\\p{L}\\p{M}\\p{N}]+"


def _worded(df: DataFrame, *keep: Column) -> DataFrame:
    words = F.split(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), SEPARATOR)
    return df.select(*keep, F.array_remove(words, "").alias("words"))


def _shingles(one, whole) -> Column:
    """An array over the shingles of ``words``; shorter texts have one, all their words."""
    n = F.size("words")
    at = F.sequence(F.lit(0), n - SHINGLE)
    many = F.transform(at, lambda i: one(*(F.get("words", i + k) for k in range(SHINGLE))))
    return (
        F.when(n >= SHINGLE, many)
        .when(n > 0, F.array(whole(F.col("words"))))
        .otherwise(F.slice(F.array(whole(F.col("words"))), 1, 0))
    )


def _hashes() -> Column:
    return _shingles(F.xxhash64, F.xxhash64)


def _strings() -> Column:
    return _shingles(lambda *w: F.concat_ws(" ", *w), lambda w: F.concat_ws(" ", w))


def item_sketches(items: DataFrame, least: float) -> DataFrame:
    """(item_key, item_id, n_shingles, shingles, sketch) for items with any word."""
    key = F.xxhash64("item_id", "text").alias("item_key")
    worded = _worded(items.select("item_id", "text").distinct(), key, F.col("item_id"))
    sized = worded.where(F.size("words") > 0).select(
        "item_key",
        "item_id",
        F.array_distinct(_strings()).alias("shingles"),
        F.array_sort(F.array_distinct(_hashes())).alias("hashes"),
    ).withColumn("n_shingles", F.size("shingles"))
    largest = F.pow(F.lit(2.0), F.floor(F.log2("n_shingles")) + 1) - 1  # of the partition
    k = (F.floor((1 - least) * largest + 1e-9) + 1).cast("int")
    return sized.select(
        "item_key", "item_id", "n_shingles", "shingles", F.slice("hashes", 1, k).alias("sketch")
    )


def contained_items(docs: DataFrame, items: DataFrame, least: float = 0.8) -> DataFrame:
    """Items of which a document holds at least ``least`` of the different shingles.

    One row (doc_id, text_hash, item_id, n_shingles, n_shared) per document text and
    item.  Shingles are five words in lower case; a text of fewer words is one shingle
    and is found where another text is exactly these words.  Null and empty texts
    hold and are found nowhere.  Repeated rows count once; a repeated id with different
    texts gives a row for each.  Null ids stay null.  Other columns are ignored, empty
    tables give an empty result.
    """
    sketches = cut_lineage(item_sketches(items, least))
    filed = sketches.select("item_key", F.explode("sketch").alias("h"))
    n_filed = filed.count()
    key = F.xxhash64(F.col("text").cast("string")).alias("text_hash")
    hashed = _worded(docs, F.col("doc_id"), key).select("doc_id", "text_hash", _hashes().alias("hs"))
    found = (
        # The outer form: for explode() Spark would test the array's size below the words.
        hashed.select("doc_id", "text_hash", F.explode_outer("hs").alias("h"))
        .join(small_side(filed, n_filed), "h")
        .select(F.col("doc_id").alias("c_doc"), F.col("text_hash").alias("c_hash"), "item_key")
        .distinct()
    )
    whole = sketches.select("item_key", "item_id", "n_shingles", "shingles")
    found = cut_lineage(found)
    found = small_side(found, found.count())
    same = F.col("doc_id").eqNullSafe(F.col("c_doc")) & (F.col("text_hash") == F.col("c_hash"))
    texts = docs.select("doc_id", "text", key)
    matched = _worded(
        texts.join(found, same).join(small_side(whole, n_filed), "item_key"),
        *(F.col(c) for c in ("doc_id", "text_hash", *whole.columns)),
    )
    shared = F.size(F.array_intersect(_strings(), F.col("shingles"))).alias("n_shared")
    # Written before it is filtered: a filter that moves below the words would split
    # the text once per shingle.
    counted = cut_lineage(
        matched.select("doc_id", "text_hash", "item_id", "n_shingles", shared).distinct()
    )
    return counted.where(F.col("n_shared") >= F.ceil(least * F.col("n_shingles") - 1e-9))


def without_items(docs: DataFrame, items: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows of docs whose text holds no benchmark item; all columns stay."""
    found = cut_lineage(
        contained_items(docs, items, least)
        .select(F.col("doc_id").alias("__leak_id"), F.col("text_hash").alias("__leak_hash"))
        .distinct()
    )
    found = small_side(found, found.count())
    same = docs["doc_id"].eqNullSafe(F.col("__leak_id")) & (
        F.xxhash64(docs["text"].cast("string")) == F.col("__leak_hash")
    )
    return docs.join(found, same, "left_anti")


CONTAINED_SQL = r"""
WITH texts AS (
  SELECT 0 AS kind, doc_id AS id, text FROM documents
  UNION ALL SELECT 1, item_id, text FROM benchmark
), worded AS (
  SELECT kind, id, regexp_extract_all(lower(coalesce(text, '')), '[\pL\pM\pN]+') AS w FROM texts
), shingled AS (
  SELECT DISTINCT kind, id, unnest(CASE
    WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM worded
), items AS (
  SELECT id AS item_id, s, CAST(count(*) OVER (PARTITION BY id) AS INTEGER) AS n_shingles
  FROM shingled WHERE kind = 1
)
SELECT d.id AS doc_id, item_id, n_shingles, CAST(count(*) AS INTEGER) AS n_shared
FROM shingled d JOIN items USING (s) WHERE d.kind = 0
GROUP BY d.id, item_id, n_shingles HAVING count(*) >= ceil(0.8 * n_shingles - 1e-9)
"""
