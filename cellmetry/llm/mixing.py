"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a fixed shuffled order, repeated as often
as its target asks.  A document's virtual finish time is the number of words its queue
has sent with it, divided by the target; sorted by this time, all sources advance in
proportion to their targets, and the mix ends where the total budget is reached.
"""

from __future__ import annotations

from math import ceil, isqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellmetry.llm.common import WORD, small_side
from cellmetry.session import cut_lineage

SEED = 7
REPEATS = 3
#: The table of sources is read by the driver; more are refused.
MAX_SOURCES = 100_000


def fair_targets(sizes: list[int], weights: list[int], total: int, most: int) -> list[float]:
    """Shares of total by weight, none above most x its size; the excess goes to the rest."""
    targets = [0.0] * len(sizes)
    open_total, open_weight = total, sum(weights)
    order = sorted(range(len(sizes)), key=lambda i: most * sizes[i] / weights[i])
    for place, i in enumerate(order):
        if most * sizes[i] * open_weight > open_total * weights[i]:
            for j in order[place:]:
                targets[j] = open_total * weights[j] / open_weight
            break
        targets[i] = float(most * sizes[i])
        open_total -= most * sizes[i]
        open_weight -= weights[i]
    return targets


def _per_task(rows: int, least: int) -> int:
    """Rows of a bucket, growing with the root so that buckets are as few as rows in one."""
    return max(least, isqrt(rows))


def fair_mix(docs: DataFrame, most: int = REPEATS, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken.

    Size is the number of words, 0 for a null text.  Sources in order of code points,
    null last, weigh 1, 2, 3 in turn and share the total size; see ``fair_targets``.
    ``taken`` counts the words the mix takes of the row, repeats included: a multiple
    of its size, ``most`` x at the largest.  Repeated rows queue as rows of their own.  Null
    ids are allowed and shuffled together.  Texts without words take nothing; an empty
    table gives an empty result.  Other columns are ignored.
    """
    spark = docs.sparkSession
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD))
    salted = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = cut_lineage(
        docs.select("doc_id", "source", size.cast("long").alias("size"), F.md5(salted).alias("k"))
    )
    per_source = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
    found = per_source.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    total, rows = sum(r["n"] for r in found), sum(r["rows"] for r in found)
    targets = fair_targets([r["n"] for r in found], [i % 3 + 1 for i in range(len(found))], total, most)
    sources = spark.createDataFrame(
        [
            (i, r["source"], r["n"], t, ceil(r["rows"] / _per_task(r["rows"], 500)))
            for i, (r, t) in enumerate(zip(found, targets))
        ],
        "s int, s_source string, source_size long, target double, buckets long",
    )

    # Words sent by the queue up to and with each document, without one task per source:
    # offsets of buckets of the shuffled order, then sums inside a bucket.
    spread = F.conv(F.substring("k", 1, 8), 16, 10).cast("long") * F.col("buckets")
    queued = sized.join(
        F.broadcast(sources), sized["source"].eqNullSafe(sources["s_source"])
    ).select("*", F.shiftright(spread, 32).alias("bucket"))
    before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        queued.groupBy("s", "bucket")
        .agg(F.sum("size").alias("in_bucket"))
        .select("s", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("offset"))
    )
    upto = (
        Window.partitionBy("s", "bucket")
        .orderBy("k", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    placed = cut_lineage(
        queued.withColumn("sent", F.sum("size").over(upto))
        .join(offsets, ["s", "bucket"])
        .select(
            "doc_id", "source", "size", "s", "source_size", "target",
            (F.col("offset") + F.col("sent")).alias("sent"),
        )
    )

    # The global order of finish times in range partitions, cut at the total budget.
    copies = (
        placed.where("size > 0 AND target > 0")
        .withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
        .where("repeat * source_size < target + source_size")
        .select(
            ((F.col("repeat") * F.col("source_size") + F.col("sent")) / F.col("target")).alias("finish"),
            "s", "repeat", "sent", "size",
        )
    )
    order = ["finish", "s", "repeat", "sent"]
    parts = ceil(max(1, most * rows) / _per_task(most * rows, 20_000))
    ranged = cut_lineage(
        copies.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
    )
    earlier = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("part")
        .agg(F.sum("size").alias("in_part"))
        .select("part", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)).alias("start"))
    )
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    taken = (
        ranged.withColumn("running", F.sum("size").over(within))
        .join(starts, "part")
        .where(F.col("start") + F.col("running") <= F.lit(total))
        .groupBy(F.col("s").alias("t_s"), F.col("sent").alias("t_sent"))
        .agg(F.sum("size").alias("words"))
    )
    mine = (F.col("s") == F.col("t_s")) & (F.col("sent") == F.col("t_sent")) & (F.col("size") > 0)
    return placed.join(taken, mine, "left").select(
        "doc_id", "source", "size", "source_size", "target",
        F.coalesce("words", F.lit(0).cast("long")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, most: int = REPEATS, seed: int = SEED) -> DataFrame:
    """The rows of docs as often as the mix takes them; all columns of docs stay.

    Rows of equal id, source and size are told apart by count only: together they come
    as often as the mix takes them.
    """
    mix = fair_mix(docs, most, seed).withColumn("__n", F.expr("IF(size > 0, taken DIV size, 0)"))
    plan = cut_lineage(
        mix.groupBy(
            F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size")
        ).agg(F.sum("__n").alias("__n"), F.count("*").alias("__rows"))
    ).where("__n > 0")
    size = F.regexp_count(F.coalesce(docs["text"].cast("string"), F.lit("")), F.lit(WORD))
    same = (
        docs["doc_id"].eqNullSafe(F.col("__id"))
        & docs["source"].eqNullSafe(F.col("__source"))
        & (size.cast("long") == F.col("__size"))
    )
    # The plan has a row per document: texts and plan meet by a sorted join at every size.
    once = docs.join(plan.where("__rows = 1").hint("merge"), same)
    repeated = plan.where("__rows > 1")
    nth = Window.partitionBy("__id", "__source", "__size").orderBy(F.xxhash64(docs["text"]))
    again = docs.join(small_side(repeated, repeated.count()), same).withColumn("__nth", F.row_number().over(nth))
    again = again.withColumn(
        "__n", F.expr("__n DIV __rows + IF(__nth <= __n % __rows, 1, 0)")
    ).drop("__nth")
    both = once.unionByName(again).where("__n > 0")
    copies = both.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))))
    return copies.select(*(F.col(f"`{c}`") for c in docs.columns))


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, s % 3 + 1 AS w, 3 * source_size AS cap FROM sources
), filled AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS open_total,
    sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS open_weight
  FROM weighed
  WINDOW o AS (ORDER BY cap / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT arg_min(open_total, cap / w) AS lt, arg_min(open_weight, cap / w) AS lw
  FROM filled WHERE cap * open_weight > open_total * w
), targets AS (
  SELECT f.source, f.s, f.source_size, CASE WHEN cap * open_weight > open_total * w
    THEN CAST(lt * w AS DOUBLE) / CAST(lw AS DOUBLE) ELSE CAST(cap AS DOUBLE) END AS target
  FROM filled f CROSS JOIN level
), placed AS (
  SELECT doc_id, size, s, source_size, target, CAST(sum(size) OVER (
    PARTITION BY s ORDER BY k, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sent
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
), copies AS (
  SELECT s, sent, size, sum(size) OVER (
    ORDER BY CAST(r * source_size + sent AS DOUBLE) / target, s, r, sent
    ROWS UNBOUNDED PRECEDING) AS running
  FROM placed, range(0, 3) t(r) WHERE size > 0 AND target > 0
), taken AS (
  SELECT s, sent, CAST(sum(size) AS BIGINT) AS words FROM copies
  WHERE running <= (SELECT sum(size) FROM sized) GROUP BY s, sent
)
SELECT doc_id, size, source_size, target,
  CASE WHEN size > 0 THEN coalesce(words, 0) ELSE 0 END AS taken
FROM placed LEFT JOIN taken USING (s, sent)
"""
