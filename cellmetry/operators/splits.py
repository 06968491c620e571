"""Seeded splits, folds and batches.

The shuffle order is the hash of the row key and the seed, so a split is the same on
any cluster and after any lost task.  Sizes are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmetry.operators.ranking import shuffled_row_number


def _sized(df: DataFrame, group: list[str], key: str, seed: int) -> DataFrame:
    """Row number ``_i`` and row count ``_n`` per group."""
    return shuffled_row_number(df, group, key, seed, "_i", total="_n")


def _part(train: float, val: float) -> Column:
    n_train = F.floor(F.col("_n") * F.lit(train))
    n_val = F.floor(F.col("_n") * F.lit(val))
    return (
        F.when(F.col("_i") <= n_train, F.lit("train"))
        .when(F.col("_i") <= n_train + n_val, F.lit("val"))
        .otherwise(F.lit("test"))
    )


def _check(train: float, val: float) -> None:
    if train + val >= 1.0:
        raise ValueError("train and val ratio must leave a test share")


def random_split(
    df: DataFrame, key: str, train: float = 0.7, val: float = 0.15, seed: int = 42
) -> DataFrame:
    """Add ``part``: train, val or test."""
    _check(train, val)
    return _sized(df, [], key, seed).withColumn("part", _part(train, val)).drop("_i", "_n")


def stratified_split(
    df: DataFrame,
    key: str,
    label: str = "label",
    train: float = 0.7,
    val: float = 0.15,
    seed: int = 42,
) -> DataFrame:
    _check(train, val)
    return _sized(df, [label], key, seed).withColumn("part", _part(train, val)).drop("_i", "_n")


def stratified_kfold(
    df: DataFrame, key: str, label: str = "label", k: int = 5, seed: int = 42
) -> DataFrame:
    """Add ``fold``: position in its class modulo k."""
    numbered = shuffled_row_number(df, [label], key, seed, "_i")
    return numbered.withColumn("fold", (F.col("_i") - 1) % k).drop("_i")


def kfold_expand(folded: DataFrame, k: int = 5) -> DataFrame:
    """The k (train, val) pairs as one long table, by explode: no join."""
    rounds = F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint"))
    return folded.withColumn("round", F.explode(rounds)).withColumn(
        "part", F.when(F.col("fold") == F.col("round"), F.lit("val")).otherwise(F.lit("train"))
    )


def holdout_split(
    df: DataFrame, key: str, label: str = "label", test: float = 0.3, seed: int = 42
) -> DataFrame:
    """Stratified train and test part; the test share of each class is rounded."""
    sized = _sized(df, [label], key, seed)
    n_test = F.floor(F.col("_n") * F.lit(test) + 0.5)
    return sized.withColumn(
        "part", F.when(F.col("_i") <= n_test, F.lit("test")).otherwise(F.lit("train"))
    ).drop("_i", "_n")


def batch_index(df: DataFrame, key: str, size: int = 32, seed: int = 42) -> DataFrame:
    """Shuffle and cut into batches of ``size``."""
    numbered = shuffled_row_number(df, [], key, seed, "_i")
    return numbered.withColumn(
        "batch", F.floor((F.col("_i") - 1) / size).cast("bigint")
    ).drop("_i")
