"""Cell tables derived from the given parquet tables.

The given tables hold no images, so objects, pixels, votes and file names are
derived from ``embeddings`` and ``documents`` by arithmetic that grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmetry.functions.names import BASE_FEATURES

IMAGE_SIDE = 64
RING_POINTS = 64
#: Vectors of the images that one task makes: 256 images, a million pixels.
TASK_VECTORS = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame, vectors: int, *keys: str) -> DataFrame:
    """A small seed table is spread over the cores before rows are generated from it.

    The partitions grow with the vectors, as all that follows by image stays in them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-vectors // TASK_VECTORS)), *keys)


def _ring(cx: str, cy: str, base: int, factor: int) -> str:
    radius = f"({base} + floor({factor} * abs(cast(get(embedding, cast(i as int)) as double))))"
    return (
        f"transform(sequence(0L, {RING_POINTS - 1}L), i -> named_struct("
        f"'x', cast({cx} + floor({radius} * cos(2 * pi() * i / 64) + 0.5) as bigint),"
        f"'y', cast({cy} + floor({radius} * sin(2 * pi() * i / 64) + 0.5) as bigint)))"
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per object: image, slot in the image, ring centre and class."""
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id",
        "vec_id div 8 as image_id",
        "concat('img', vec_id div 8, '.tif') as image_name",
        "vec_id % 8 as slot",
        "vec_id % 8 + 1 as object_id",
        "cast(label % 4 as bigint) as label",
        "cast(label as bigint) as raw_label",
        "70 * ((vec_id % 8) % 4) + 60 as ring_x",
        "70 * ((vec_id % 8) div 4) + 60 as ring_y",
        "embedding",
    )


def cytoplasms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select(
        "vec_id",
        "image_id",
        "image_name",
        "object_id",
        "label",
        F.expr(_ring("ring_x", "ring_y", 30, 200)).alias("contour"),
    )


def nuclei(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small rings around a shifted centre (px, py)."""
    placed = embeddings(spark, sf_dir).selectExpr(
        "*",
        "cast(ring_x + floor(250 * cast(embedding[0] as double)) as bigint) as px",
        "cast(ring_y + floor(250 * cast(embedding[1] as double)) as bigint) as py",
    )
    return placed.select(
        F.col("vec_id").alias("nucleus_id"),
        "image_id",
        "image_name",
        "px",
        "py",
        F.expr(_ring("px", "py", 8, 50)).alias("contour"),
    )


def crescents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-shaped rings whose centroid may lie outside: outer arc, then inner arc back."""
    radius = "(40 + floor(100 * abs(cast(get(embedding, cast(i as int)) as double))))"
    angle = "(1.6 * pi() * i / 31)"
    outer = (
        f"transform(sequence(0L, 31L), i -> named_struct("
        f"'x', cast(200 + floor({radius} * cos{angle} + 0.5) as bigint),"
        f"'y', cast(200 + floor({radius} * sin{angle} + 0.5) as bigint)))"
    )
    inner = (
        f"transform(sequence(31L, 0L, -1L), i -> named_struct("
        f"'x', cast(200 + floor(({radius} - 20) * cos{angle} + 0.5) as bigint),"
        f"'y', cast(200 + floor(({radius} - 20) * sin{angle} + 0.5) as bigint)))"
    )
    return embeddings(spark, sf_dir).select(
        "vec_id", "image_id", F.expr(f"concat({outer}, {inner})").alias("contour")
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense 64 x 64 images: four channels, object label and image id.

    Row y takes the values of one of the image's eight vectors at most, component x.
    """
    vectors = table(spark, sf_dir, "embeddings")
    images = (
        vectors.groupBy(F.expr("vec_id div 8").alias("image_id"))
        .agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("vectors"))
    )
    grid = (
        _spread(images, vectors.count(), "image_id")
        .select("*", F.explode(F.expr(f"sequence(0L, {IMAGE_SIDE - 1}L)")).alias("y"))
        .selectExpr("image_id", "y", "vectors[cast(y % size(vectors) as int)].embedding as line")
        .select("*", F.explode(F.expr(f"sequence(0L, {IMAGE_SIDE - 1}L)")).alias("x"))
    )
    gray = grid.selectExpr(
        "image_id",
        "y",
        "x",
        "(3 * x * x + 7 * y + 13 * image_id + x * y"
        " + cast(floor(500 * abs(cast(get(line, cast(x as int)) as double))) as bigint)) % 256"
        " as grayscale",
    )
    return gray.selectExpr(
        "image_id",
        "y",
        "x",
        "grayscale",
        "(grayscale * 5 + y) % 256 as red",
        "(grayscale * 7 + x) % 256 as green",
        "(grayscale * 11 + x + y) % 256 as blue",
        "case when (x % 16 - 8) * (x % 16 - 8) + (y % 16 - 8) * (y % 16 - 8)"
        " <= 20 + 4 * (image_id % 5) then 1 + x div 16 + 4 * (y div 16)"
        " else 0L end as obj",
    )


def predicted_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The disks of ``pixels`` shifted right by image_id % 3, every seventh one missing."""
    disk = pixels(spark, sf_dir).selectExpr(
        "image_id",
        "y",
        "x",
        "x - image_id % 3 as u",
    )
    return disk.selectExpr(
        "image_id",
        "y",
        "x",
        "case when u >= 0 and (u % 16 - 8) * (u % 16 - 8) + (y % 16 - 8) * (y % 16 - 8)"
        " <= 20 + 4 * (image_id % 5) and (u div 16 + 4 * (y div 16)) % 7 <> 6"
        " then 101 + u div 16 + 4 * (y div 16) else 0L end as pred",
    )


def crowded_masks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two masks of oblong cells in different grids, where one object has several partners."""
    base = pixels(spark, sf_dir)
    truth = base.selectExpr(
        "image_id", "y", "x", "1 + x div (9 + image_id % 3) + 10 * (y div 11) as obj"
    )
    pred = base.selectExpr("image_id", "y", "x", "1 + x div 8 + 10 * (y div (9 + image_id % 4)) as pred")
    return truth, pred


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three annotators per trait; some objects stay unlabelled, one vote may be missing."""
    return (
        table(spark, sf_dir, "embeddings")
        .filter("vec_id % 9 <> 4")
        .selectExpr(
            "vec_id",
            "concat('img', vec_id div 8, '.tif') as image_name",
            "vec_id % 8 + 1 as cyto_id",
            *[f"(vec_id * {k} + label) % 2 as xgal_{k}" for k in (1, 2, 3)],
            *[
                (
                    "case when vec_id % 97 = 0 then null else (vec_id div 2 + label) % 2 end"
                    if k == 2
                    else f"(vec_id div {k} + label) % 2"
                )
                + f" as s_status_{k}"
                for k in (1, 2, 3)
            ],
            "cast(label % 2 as bigint) as cons_xgal",
            "cast((label div 2) % 2 as bigint) as cons_morph_status",
        )
    )


def blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected objects as one small map per image: ``data_dict`` image -> ids."""
    return (
        table(spark, sf_dir, "embeddings")
        .filter("vec_id % 10 = 3")
        .groupBy(F.expr("concat('img', vec_id div 8, '.tif')").alias("image_name"))
        .agg(F.sort_array(F.collect_set(F.expr("vec_id % 8 + 1"))).alias("ids"))
        .select(F.create_map("image_name", "ids").alias("data_dict"))
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fourteen features, true and predicted class, treatment."""
    named = [f"cast(embedding[{i}] as double) as {c}" for i, c in enumerate(BASE_FEATURES)]
    return embeddings(spark, sf_dir).selectExpr(
        "vec_id",
        "image_name",
        "object_id",
        *named,
        "label",
        "case when vec_id % 5 = 0 then (raw_label + 1) % 4 else label end as predicted",
        "case when vec_id % 2 = 0 then 'tmz' else 'ctr' end as tx",
    )


def files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two class-per-folder trees as (class_name, file_name)."""
    docs = table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "lang as class_name",
        "concat('img_A', doc_id div 10, '_crop_', doc_id, '.tif') as file_name",
    )
    other = docs.filter("doc_id % 11 <> 0 and class_name <> 'es'").withColumn(
        "file_name", F.expr("case when doc_id % 3 = 0 then upper(file_name) else file_name end")
    )
    return docs, other


def disk_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring of 24 points for every disk of ``pixels``."""
    vectors = table(spark, sf_dir, "embeddings")
    images = vectors.selectExpr("vec_id div 8 as image_id").distinct()
    disks = _spread(images, vectors.count(), "image_id").select(
        "image_id", F.explode(F.expr("sequence(1L, 16L)")).alias("obj")
    )
    radius = "sqrt(cast(20 + 4 * (image_id % 5) as double))"
    ring = (
        "transform(sequence(0L, 23L), i -> named_struct("
        f"'x', cast(8 + 16 * ((obj - 1) % 4) + floor({radius} * cos(2 * pi() * i / 24) + 0.5) as bigint),"
        f"'y', cast(8 + 16 * ((obj - 1) div 4) + floor({radius} * sin(2 * pi() * i / 24) + 0.5) as bigint)))"
    )
    return disks.select(
        "image_id",
        F.concat(F.lit("img"), "image_id", F.lit(".tif")).alias("image_name"),
        "obj",
        F.expr(ring).alias("contour"),
    )
