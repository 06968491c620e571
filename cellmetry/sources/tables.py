"""Reading and writing object tables, label files and class folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The two label file layouts.
CONSENSUS_SCHEMA = "cyto_image string, cyto_index bigint, cons_xgal bigint, cons_morph_status bigint"
VOTES_SCHEMA = (
    "image_name string, cyto_id bigint, xgal_1 bigint, xgal_2 bigint, xgal_3 bigint, "
    "s_status_1 bigint, s_status_2 bigint, s_status_3 bigint"
)


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_objects(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def read_labels(spark: SparkSession, path: str, schema: str = CONSENSUS_SCHEMA) -> DataFrame:
    """Label CSV with a declared schema, so that no pass is spent on inference."""
    return spark.read.schema(schema).option("enforceSchema", "false").csv(path, header=True)


def read_blacklist(spark: SparkSession, path: str) -> DataFrame:
    """Blacklist file with a ``data_dict`` of image -> ids (JSON form of the mapping)."""
    return spark.read.schema("data_dict map<string,array<bigint>>").json(path, multiLine=True)


def write_metrics(df: DataFrame, path: str) -> None:
    """Metrics and importances as CSV with a header, names kept."""
    df.write.mode("overwrite").csv(path, header=True)


def class_partition_sink(crops: DataFrame, path: str) -> None:
    """One directory per class; reading one class back prunes the others.

    The rebalance hint cuts a hot class into as many writers as its bytes ask for.
    """
    crops.hint("rebalance", "label_name").write.mode("overwrite").partitionBy("label_name").parquet(
        path
    )
