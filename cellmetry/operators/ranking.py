"""Row numbers and cumulative counts that never put one key into one task.

A window over a class, a treatment or the whole table would run in one task for a
hot key.  Here the order is cut into buckets first; the window runs inside a
bucket, and a table of bucket counts (bounded by keys x buckets) gives each bucket
its starting offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellmetry.session import cut_lineage

HASH_DIGITS = 3  # 16 ** 3 = 4096 buckets per key


def hash_order(key: Column, seed: int) -> Column:
    """Deterministic shuffle order of a key."""
    return F.md5(F.concat(key.cast("string"), F.lit("|"), F.lit(str(seed))))


def bucketed_row_number(
    df: DataFrame,
    group: list[str],
    bucket: Column,
    order: list[Column],
    name: str,
    total: str = "_total",
) -> DataFrame:
    """1-based row number per group; ``bucket`` must rise with ``order``.

    Also adds the row count of the group as ``total`` when it is given a name.
    """
    marked = df.withColumn("_bucket", bucket)
    keys = [*group, "_bucket"]
    counts = marked.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(Window.partitionBy(*group)).alias(total),
    )
    within = Window.partitionBy(*keys).orderBy(*order)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return (
        marked.withColumn("_rank", F.row_number().over(within))
        .join(offsets, same)
        .withColumn(name, (F.col("_rank") + F.col("_offset")).cast("bigint"))
        .drop("_bucket", "_rank", "_offset", "_total", *[f"_k_{k}" for k in keys])
    )


def shuffled_row_number(
    df: DataFrame, group: list[str], key: str, seed: int, name: str, total: str = "_total"
) -> DataFrame:
    """Row number per group in hash order; hash prefixes make even buckets."""
    marked = df.withColumn("_hash", hash_order(F.col(key), seed))
    numbered = bucketed_row_number(
        marked,
        group,
        F.substring("_hash", 1, HASH_DIGITS),
        [F.col("_hash"), F.col(key)],
        name,
        total,
    )
    return numbered.drop("_hash")


def sorted_row_number(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """1-based row number over the whole table in any total order.

    Range partitions are the buckets; they are written out so that a lost executor
    cannot redraw their borders.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(
        df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    )
    return bucketed_row_number(ranged, [], F.col("_part"), order, name).drop("_part")


#: Distinct values of a bucket, and the bounds of their number per key.
BUCKET_ROWS, FEWEST_BUCKETS, MOST_BUCKETS = 100_000, 64, 8_192


def cumulative_counts(
    counts: DataFrame, group: list[str], value: str, n: str, by: str, buckets: int | None = None
) -> DataFrame:
    """Add ``before`` (rows with a smaller value) and ``total`` per group.

    ``counts`` has one row per (group, distinct value) with its multiplicity; ``by``
    is the group column whose values share borders.  Borders are roughly even
    quantiles, as many as the counted rows ask for unless given, fetched once (distinct
    ``by`` x buckets numbers) and put back as a local table, so every recomputation cuts
    the values at the same places.
    """
    if buckets is None:
        sizes = counts.groupBy(by).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0
        buckets = min(MOST_BUCKETS, max(FEWEST_BUCKETS, -(-sizes // BUCKET_ROWS)))
    points = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    rows = (
        counts.groupBy(by)
        .agg(F.percentile_approx(value, points, F.lit(10 * buckets)).alias("_borders"))
        .collect()
    )
    borders = counts.sparkSession.createDataFrame(
        [(r[by], sorted(set(r["_borders"] or []))) for r in rows],
        f"_by {counts.schema[by].dataType.simpleString()}, _borders array<double>",
    )
    marked = (
        counts.join(F.broadcast(borders), F.col(by).eqNullSafe(F.col("_by")))
        .withColumn("_bucket", F.size(F.filter("_borders", lambda b: b < F.col(value))))
        .drop("_by", "_borders")
    )
    keys = [*group, "_bucket"]
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        marked.groupBy(*keys)
        .agg(F.sum(n).alias("_n"))
        .select(
            *keys,
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
            F.sum("_n").over(Window.partitionBy(*group)).alias("total"),
        )
    )
    within = (
        Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        marked.withColumn("_inside", F.coalesce(F.sum(n).over(within), F.lit(0)))
        .join(offsets, keys)
        .withColumn("before", F.col("_inside") + F.col("_offset"))
        .drop("_bucket", "_inside", "_offset")
    )
