"""Relational steps: label joins, blacklist, union, de-duplication, column rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellmetry.functions import names
from cellmetry.operators.ranking import sorted_row_number


def prefix_columns(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def rename_columns(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Bring drifting column names to the canonical ones."""
    return df.withColumnsRenamed(names.COLUMN_ALIASES if aliases is None else aliases)


def select_features(df: DataFrame, features: list[str], *keys: str) -> DataFrame:
    return df.select(*keys, *features)


def add_circularity(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "cyto_circularity": names.circularity(F.col("cyto_roundness")),
            "nuc_circularity": names.circularity(F.col("nuc_roundness")),
        }
    )


def min_area_filter(df: DataFrame, area: str = "area", least: float = 10.0) -> DataFrame:
    return df.filter(F.col(area) > least)


def treatment_filter(df: DataFrame, treatment: str) -> DataFrame:
    return df.filter(F.col("tx") == treatment)


def feature_vector(df: DataFrame, features: list[str], name: str = "features") -> DataFrame:
    return df.withColumn(name, F.array(*[F.col(c).cast("double") for c in features]))


def vector_to_rows(df: DataFrame, vector: str, *keys: str) -> DataFrame:
    """Dense matrix of a vector column as (key, position, value) rows."""
    return df.select(*keys, F.posexplode(vector).alias("position", "value")).withColumn(
        "position", F.col("position").cast("bigint")
    )


def _same_keys(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> Column:
    condition = F.lit(True)
    for a, b in keys.items():
        condition = condition & left[a].eqNullSafe(right[b])
    return condition


def label_join(objects: DataFrame, labels: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Labelled objects only; missing keys match each other, as in the frames of old."""
    joined = objects.join(labels, _same_keys(objects, labels, keys), "inner")
    for a, b in keys.items():
        joined = joined.drop(labels[b])
    return joined


def consensus_labels(labelled: DataFrame) -> DataFrame:
    """Label from the two consensus columns."""
    return labelled.withColumn(
        "label", names.phenotype_label(F.col("cons_xgal"), F.col("cons_morph_status"))
    )


def annotator_join(objects: DataFrame, votes: DataFrame) -> DataFrame:
    """Normalise the image name, join the votes, take majorities and decide the class."""
    plain = rename_columns(objects, {"contour_index": "cyto_id"}).withColumn(
        "image_name", names.normalize_image_name(F.col("image_name"))
    )
    joined = label_join(plain, votes, {"image_name": "image_name", "cyto_id": "cyto_id"})
    voted = joined.withColumns(
        {
            "cons_xgal": names.majority_vote(*[F.col(f"xgal_{k}") for k in (1, 2, 3)]),
            "cons_sstatus": names.majority_vote(*[F.col(f"s_status_{k}") for k in (1, 2, 3)]),
        }
    )
    return voted.withColumn(
        "label", names.phenotype_label(F.col("cons_xgal"), F.col("cons_sstatus"))
    )


def blacklist_explode(blacklist: DataFrame, column: str = "data_dict") -> DataFrame:
    """Map of image -> ids to rows (image_name, cyto_id)."""
    return blacklist.select(F.explode(column).alias("image_name", "_ids")).select(
        "image_name", F.explode("_ids").alias("cyto_id")
    )


def blacklist_anti_join(objects: DataFrame, rejected: DataFrame, *keys: str) -> DataFrame:
    """Objects not rejected.  Spark broadcasts the reject list only while it is small."""
    return objects.join(rejected, list(keys), "left_anti")


def first_rows(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """First row per key.  The limit of one row works before the shuffle too, so copies
    of one key shrink to one per task."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def dedup_keep_first(
    df: DataFrame, keys: list[str], order: str = "obj_id"
) -> DataFrame:
    return first_rows(df, keys, F.col(order))


def unique_objects(df: DataFrame, order: str = "obj_id") -> DataFrame:
    """De-duplicated cytoplasms of all images with their crop name."""
    unique = dedup_keep_first(df, ["image_name", "cyto_id"], order)
    return unique.withColumn(
        "crop_name",
        names.crop_name(names.normalize_image_name(F.col("image_name")), F.col("cyto_id")),
    )


def crop_label_lookup(crops: DataFrame, objects: DataFrame, order: str = "obj_id") -> DataFrame:
    """Class of each crop by (image, id) parsed from its name, first row on copies."""
    parsed = crops.withColumn("_parsed", names.parse_crop_name_robust(F.col("crop_name"))).select(
        *crops.columns,
        F.col("_parsed.image_name").alias("image_name"),
        F.col("_parsed.object_id").alias("cyto_id"),
    )
    firsts = first_rows(
        objects.select("image_name", "cyto_id", "label", order),
        ["image_name", "cyto_id"],
        F.col(order),
    )
    joined = parsed.join(firsts.drop(order), ["image_name", "cyto_id"], "inner")
    return joined.withColumn(
        "label_name", names.decode_label(F.col("label"), names.LABEL_FOLDERS)
    )


def crops_without_label(crops: DataFrame, objects: DataFrame) -> DataFrame:
    """Crops that name no known object."""
    parsed = crops.withColumn("_parsed", names.parse_crop_name_robust(F.col("crop_name")))
    return parsed.join(
        objects,
        parsed["_parsed.image_name"].eqNullSafe(objects["image_name"])
        & parsed["_parsed.object_id"].eqNullSafe(objects["cyto_id"]),
        "left_anti",
    ).drop("_parsed")


def treatment_union(treated: DataFrame, control: DataFrame) -> DataFrame:
    """Tag both tables and stack them by column name; absent columns become null."""
    return treated.withColumn("tx", F.lit("tmz")).unionByName(
        control.withColumn("tx", F.lit("ctr")), allowMissingColumns=True
    )


def object_id(union: DataFrame, *order: str) -> DataFrame:
    """Consecutive 0-based id: treated rows first, then control, each in key order."""
    treated_first = F.when(F.col("tx") == "tmz", 0).otherwise(1)
    numbered = sorted_row_number(union, [treated_first, *[F.col(c) for c in order]], "obj_id")
    return numbered.withColumn("obj_id", F.col("obj_id") - 1)
