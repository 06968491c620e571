"""Rank tests, exact quantiles and scaling on feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmetry.functions.solvers import chi_square_tail, normal_two_sided
from cellmetry.operators.ranking import cumulative_counts
from cellmetry.session import cut_lineage


def feature_rows(df: DataFrame, features: list[str], *keys: str) -> DataFrame:
    """Wide features to (keys, feature, value) rows."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features]
    )
    return df.select(*keys, F.explode(pairs).alias("_f")).select(
        *keys, "_f.feature", "_f.value"
    )


def _value_ranks(rows: DataFrame) -> DataFrame:
    """(feature, value, n, rank, total): the average rank of each distinct value."""
    counts = (
        rows.filter(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count("*").alias("n"))
    )
    placed = cumulative_counts(counts, ["feature"], "value", "n", by="feature")
    return placed.withColumn("rank", F.col("before") + (F.col("n") + 1) / 2.0)


def tied_ranks(df: DataFrame, features: list[str], *keys: str) -> DataFrame:
    """Average rank of every row per feature."""
    rows = feature_rows(df, features, *keys)
    ranks = _value_ranks(rows).select("feature", "value", "rank")
    return rows.join(ranks, ["feature", "value"])


def _class_ranks(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Per feature and class: n, rank sum; per feature: all rows and the tie term."""
    rows = feature_rows(df, features, label)
    ranks = _value_ranks(rows)
    by_class = (
        rows.filter(F.col("value").isNotNull())
        .groupBy("feature", "value", label)
        .agg(F.count("*").alias("_m"))
        .join(ranks.select("feature", "value", "rank"), ["feature", "value"])
        .groupBy("feature", label)
        .agg(
            F.sum("_m").cast("double").alias("n"),
            F.sum(F.col("_m") * F.col("rank")).alias("rank_sum"),
        )
    )
    t = F.col("n").cast("double")
    ties = ranks.groupBy("feature").agg(
        F.max("total").cast("double").alias("n_all"), F.sum(t * t * t - t).alias("ties")
    )
    return by_class.join(ties, "feature")


def kruskal_wallis(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """H statistic with tie correction and its p value, one row per feature.

    Both are null for a constant feature.
    """
    return _kruskal(_class_ranks(df, features, label))


def _kruskal(ranks: DataFrame) -> DataFrame:
    n_all = F.col("n_all")
    summed = ranks.groupBy("feature", "n_all", "ties").agg(
        F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("_sum"),
        F.count("*").alias("_k"),
    )
    h = F.try_divide(
        12.0 / (n_all * (n_all + 1)) * F.col("_sum") - 3.0 * (n_all + 1),
        1.0 - F.try_divide(F.col("ties"), n_all * n_all * n_all - n_all),
    )
    return summed.withColumn("statistic", h).select(
        "feature",
        "statistic",
        chi_square_tail(F.col("statistic"), F.col("_k") - 1).alias("p_value"),
    )


def dunn_posthoc(
    df: DataFrame, features: list[str], label: str = "label", level: float = 0.05
) -> DataFrame:
    """Pairwise z tests with Bonferroni factor, where the overall test is significant.

    The join runs over classes, a handful of rows per feature.
    """
    ranks = cut_lineage(_class_ranks(df, features, label))  # features x classes rows
    picked = _kruskal(ranks).filter(F.col("p_value") < level)
    means = ranks.join(picked, "feature", "left_semi").select(
        "feature", "n_all", "ties", label, "n", (F.col("rank_sum") / F.col("n")).alias("mean")
    )
    other = means.select(
        "feature",
        F.col(label).alias("class_b"),
        F.col("n").alias("_nb"),
        F.col("mean").alias("_mb"),
    )
    paired = means.join(other, "feature").filter(F.col(label) < F.col("class_b"))
    n_all = F.col("n_all")
    base = n_all * (n_all + 1) / 12.0 - F.try_divide(F.col("ties"), 12.0 * (n_all - 1))
    tested = paired.withColumn(
        "z",
        F.try_divide(
            F.col("mean") - F.col("_mb"), F.sqrt(base * (1.0 / F.col("n") + 1.0 / F.col("_nb")))
        ),
    )
    pairs = means.groupBy("feature").agg((F.count("*") * (F.count("*") - 1) / 2).alias("_m"))
    return tested.join(pairs, "feature").select(
        "feature",
        F.col(label).alias("class_a"),
        "class_b",
        "z",
        F.least(normal_two_sided(F.col("z")) * F.col("_m"), F.lit(1.0)).alias("p_adjusted"),
    )


def feature_quantiles(
    df: DataFrame,
    features: list[str],
    group: list[str],
    shares: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0),
) -> DataFrame:
    """Exact interpolated quantiles per group and feature.

    Distinct values with counts are cut into buckets and summed up, so no group's
    values are ever held in one buffer.
    """
    keys = [*group, "feature"]
    counts = (
        feature_rows(df, features, *group)
        .filter(F.col("value").isNotNull())
        .groupBy(*keys, "value")
        .agg(F.count("*").alias("n"))
    )
    placed = cumulative_counts(counts, keys, "value", "n", by="feature")

    def value_at(position: Column, name: str) -> Column:
        here = (F.col("before") <= position) & (position < F.col("before") + F.col("n"))
        return F.max(F.when(here, F.col("value"))).alias(name)

    spots = {k: (F.col("total") - 1) * F.lit(q) for k, q in enumerate(shares)}
    found = placed.groupBy(*keys, "total").agg(
        *[value_at(F.floor(p), f"_low{k}") for k, p in spots.items()],
        *[value_at(F.ceil(p), f"_high{k}") for k, p in spots.items()],
    )
    return found.select(
        *keys,
        F.col("total").alias("n"),
        *[
            (
                F.col(f"_low{k}")
                + (F.col(f"_high{k}") - F.col(f"_low{k}")) * (spots[k] - F.floor(spots[k]))
            ).alias(f"q{int(q * 100)}")
            for k, q in enumerate(shares)
        ],
    )


def _fit(df: DataFrame, features: list[str], *stats) -> dict[str, tuple]:
    """A few numbers per feature, fetched once like the parameters of any fitted model."""
    row = df.agg(*[s(c).alias(f"{k}|{c}") for c in features for k, s in enumerate(stats)]).first()
    return {c: tuple(row[f"{k}|{c}"] for k in range(len(stats))) for c in features}


def standard_scale(df: DataFrame, features: list[str]) -> DataFrame:
    """z-scores with the population deviation; a constant feature becomes 0."""
    fitted = _fit(df, features, F.avg, F.stddev_pop)
    return df.withColumns(
        {c: (F.col(c) - F.lit(m)) / F.lit(s if s else 1.0) for c, (m, s) in fitted.items()}
    )


def minmax_scale(df: DataFrame, features: list[str]) -> DataFrame:
    """Each feature to [0, 1]; a constant feature becomes 0."""
    fitted = _fit(df, features, F.min, F.max)
    return df.withColumns(
        {
            c: (F.col(c) - F.lit(lo)) / F.lit(hi - lo if hi is not None and hi != lo else 1.0)
            for c, (lo, hi) in fitted.items()
        }
    )
