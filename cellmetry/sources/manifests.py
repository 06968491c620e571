"""File manifests of image folders, and their pairing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from cellmetry.operators.ranking import sorted_row_number


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Paths, sizes and times below a folder; the file content is never read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select(
            "path",
            F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("class_name"),
            F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"),
            "length",
        )
    )


def file_manifest(files: DataFrame, suffix: str) -> DataFrame:
    """Files whose name ends in ``suffix``, sorted by name."""
    return files.filter(F.col("file_name").endswith(suffix)).orderBy("file_name")


def has_suffix(suffix: str):
    return F.lower("file_name").endswith(suffix.lower())


def _label_ids(classes: DataFrame) -> DataFrame:
    """Rank of each class name.  The window sees distinct class names only."""
    return classes.withColumn(
        "label", (F.row_number().over(Window.orderBy("class_name")) - 1).cast("bigint")
    )


def class_manifest(
    files: DataFrame, suffix: str = ".tif", classes: DataFrame | None = None
) -> DataFrame:
    """Files with the label id of their class; an empty class still takes an id."""
    dimension = (files if classes is None else classes).select("class_name").distinct()
    return files.filter(has_suffix(suffix)).join(_label_ids(dimension), "class_name")


def class_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("class_name").intersect(b.select("class_name"))


def class_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("class_name").subtract(b.select("class_name"))


def paired_manifest(a: DataFrame, b: DataFrame, suffix: str = ".tif") -> DataFrame:
    """Files of both trees that share a class and a name up to case."""
    labels = _label_ids(class_intersection(a, b))
    left = a.filter(has_suffix(suffix)).select(
        "class_name", F.lower("file_name").alias("_key"), F.col("file_name").alias("file_a")
    )
    right = b.filter(has_suffix(suffix)).select(
        "class_name", F.lower("file_name").alias("_key"), F.col("file_name").alias("file_b")
    )
    return left.join(right, ["class_name", "_key"]).join(labels, "class_name").drop("_key")


def pair_consistency(a: DataFrame, b: DataFrame, suffix: str = ".tif") -> DataFrame:
    """One row per mismatch: (kind, class_name, file_name).

    Kinds: only_in_a, only_in_b (whole classes) and missing_in_b, missing_in_a
    (names within a common class).
    """
    common = class_intersection(a, b)

    def named(df: DataFrame) -> DataFrame:
        return (
            df.filter(has_suffix(suffix))
            .select("class_name", F.lower("file_name").alias("file_name"))
            .join(common, "class_name", "left_semi")
            .distinct()
        )

    def whole(df: DataFrame, kind: str) -> DataFrame:
        return df.select(
            F.lit(kind).alias("kind"), "class_name", F.lit(None).cast("string").alias("file_name")
        )

    def absent(df: DataFrame, kind: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), "class_name", "file_name")

    keys = ["class_name", "file_name"]
    return (
        whole(class_difference(a, b), "only_in_a")
        .unionByName(whole(class_difference(b, a), "only_in_b"))
        .unionByName(absent(named(a).join(named(b), keys, "left_anti"), "missing_in_b"))
        .unionByName(absent(named(b).join(named(a), keys, "left_anti"), "missing_in_a"))
    )


def missing_sample(mismatches: DataFrame, classes: int = 3, per_class: int = 5) -> DataFrame:
    """Report of the first names of the first classes with missing files.

    The first names per class are kept by a rank filter, which Spark applies before
    the shuffle, so no class is gathered whole.
    """
    missing = mismatches.filter(F.col("file_name").isNotNull())
    in_class = Window.partitionBy("kind", "class_name").orderBy("file_name")
    short = missing.withColumn("_rank", F.row_number().over(in_class)).filter(
        F.col("_rank") <= per_class
    )
    grouped = short.groupBy("kind", "class_name").agg(
        F.sort_array(F.collect_list("file_name")).alias("names")
    )
    by_kind = Window.partitionBy("kind").orderBy("class_name")
    return (
        grouped.withColumn("_rank", F.row_number().over(by_kind))
        .filter(F.col("_rank") <= classes)
        .drop("_rank")
    )


def positional_pairing(
    *manifests: DataFrame, columns: tuple[str, ...] = ("mask", "gray", "phase")
) -> DataFrame:
    """Pair files by their position in sorted name order."""
    ranked = [
        sorted_row_number(m.select(F.col("file_name").alias(c)), [F.col(c)], "position")
        for m, c in zip(manifests, columns)
    ]
    out = ranked[0]
    for other in ranked[1:]:
        out = out.join(other, "position")
    return out


def mask_pair_check(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Bad mask pairs: no prediction for an image, or another image size.

    Both inputs are pixel tables; only one row per image reaches the join.
    """

    def sizes(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy("image_id").agg(
            (F.max("y") + 1).alias(f"{tag}_height"), (F.max("x") + 1).alias(f"{tag}_width")
        )

    both = sizes(truth, "truth").join(sizes(predicted, "pred"), "image_id", "left")
    problem = (
        F.when(F.col("pred_height").isNull(), F.lit("missing prediction"))
        .when(
            (F.col("truth_height") != F.col("pred_height"))
            | (F.col("truth_width") != F.col("pred_width")),
            F.lit("shape mismatch"),
        )
    )
    return both.withColumn("problem", problem).filter(F.col("problem").isNotNull())
