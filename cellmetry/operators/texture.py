"""Intensity and texture features per object and channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellmetry.operators.tiles import by_task, labelled
from cellmetry.session import cut_lineage

# Settings and names of the texture features.
DISTANCES = [3, 6, 9, 18]
ANGLES = [0, 45, 90, 135]
LEVELS = 32
GLCM_PROPERTIES = [
    "contrast",
    "dissimilarity",
    "homogeneity",
    "energy",
    "correlation",
    "ASM",
    "entropy",
]
LBP_METRICS = ["entropy", "energy", "asm", "mean_code", "var_code", "skewness", "kurtosis"]
INTENSITY_METRICS = ["mean", "median", "max", "min", "sum", "int_density"]
TINY = 1e-12


def quantize_levels(value: Column, levels: int = LEVELS) -> Column:
    return F.least(F.floor(value / (256.0 / levels)), F.lit(levels - 1)).cast("bigint")


def intensity_features(
    pixels: DataFrame,
    areas: DataFrame,
    channels: list[str],
    obj: str = "obj",
    image: str = "image_id",
) -> DataFrame:
    """Wide intensity features.  ``areas`` gives (image, obj, area) of the contour.

    Pixels are first counted per (object, channel, level).
    """
    levels = F.explode(
        F.array(*[F.struct(F.lit(k).alias("c"), F.col(c).alias("v")) for k, c in enumerate(channels)])
    )
    counts = (
        pixels.filter(F.col(obj) > 0)
        .select(image, obj, levels.alias("_e"))
        .groupBy(image, obj, F.col("_e.c").alias("c"), F.col("_e.v").alias("v"))
        .agg(F.count("*").alias("n"))
    )
    return intensity_of_counts(counts, areas, channels, obj, image, labelled(pixels, obj))


def intensity_of_counts(
    counts: DataFrame,
    areas: DataFrame,
    channels: list[str],
    obj: str = "obj",
    image: str = "image_id",
    counted: int = 0,
) -> DataFrame:
    """The same from counts (image, obj, c, v, n), c being the channel's number.

    A channel has at most 256 levels, so the exact median and all sums come from short
    count tables and no large object is held in one buffer.
    """
    # at most 256 rows per channel meet here, so one exchange serves window and sums
    placed = by_task(counts, image, obj, pixels=counted)
    level = Window.partitionBy(image, obj, "c")
    running = placed.withColumns(
        {"_upto": F.sum("n").over(level.orderBy("v")), "_all": F.sum("n").over(level)}
    )

    def at(position: Column) -> Column:
        here = (F.col("_upto") > position) & (F.col("_upto") - F.col("n") <= position)
        return F.max(F.when(here, F.col("v")))

    middle = (F.col("_all") - 1) / 2.0
    stats = running.groupBy(image, obj, "c").agg(
        F.sum(F.col("v") * F.col("n")).cast("double").alias("sum"),
        F.sum("n").alias("n"),
        F.max("v").cast("double").alias("max"),
        F.min("v").cast("double").alias("min"),
        ((at(F.floor(middle)) + at(F.ceil(middle))) / 2.0).alias("median"),
    )
    wide = stats.groupBy(image, obj).agg(
        F.first("n").alias("_n"),
        *[
            F.expr(f"max(case when c = {k} then `{m}` end) as `{c}_{m}`")
            for k, c in enumerate(channels)
            for m in ("sum", "max", "min", "median")
        ],
    )
    joined = wide.join(areas.select(image, obj, "area").hint("merge"), [image, obj])
    return joined.select(
        image,
        obj,
        *[
            x
            for c in channels
            for x in (
                (F.col(f"{c}_sum") / F.col("_n")).alias(f"{c}_mean"),
                *[f"{c}_{m}" for m in ("median", "max", "min", "sum")],
                F.try_divide(F.col(f"{c}_sum"), F.col("area")).alias(f"{c}_int_density"),
            )
        ],
    )


def glcm_matrix(pairs: DataFrame, image: str = "image_id", obj: str = "obj") -> DataFrame:
    """Pair counts as shares of their (object, channel, distance, angle).

    The window holds the pairs of levels of one kind, 1024 rows with 32 levels.
    """
    keys = [image, obj, "channel", "d", "angle"]
    total = F.sum("n").over(Window.partitionBy(*keys))
    return pairs.select(*keys, "i", "j", (F.col("n").cast("double") / total.cast("double")).alias("p"))


def _angle_properties(pairs: DataFrame, image: str, obj: str) -> DataFrame:
    """Seven properties per (object, channel, distance, angle) from whole-number sums."""
    n, i, j = F.col("n"), F.col("i"), F.col("j")
    gap = i - j
    sums = pairs.groupBy(image, obj, "channel", "d", "angle").agg(
        F.sum(n).cast("double").alias("t"),
        F.sum(n * gap * gap).cast("double").alias("gap2"),
        F.sum(n * F.abs(gap)).cast("double").alias("gap1"),
        F.sum(n / (1.0 + gap * gap)).alias("near"),
        F.sum(n * n).cast("double").alias("n2"),
        F.sum(n * F.log(n.cast("double"))).alias("nlogn"),
        F.sum(n * i).cast("double").alias("si"),
        F.sum(n * j).cast("double").alias("sj"),
        F.sum(n * i * i).cast("double").alias("sii"),
        F.sum(n * j * j).cast("double").alias("sjj"),
        F.sum(n * i * j).cast("double").alias("sij"),
    )
    t = F.col("t")
    # whole-number forms: exactly zero for a constant level
    var_i = t * F.col("sii") - F.col("si") * F.col("si")
    var_j = t * F.col("sjj") - F.col("sj") * F.col("sj")
    cov = t * F.col("sij") - F.col("si") * F.col("sj")
    flat = (var_i <= 0) | (var_j <= 0)
    return sums.select(
        image,
        obj,
        "channel",
        "d",
        "angle",
        (F.col("gap2") / t).alias("contrast"),
        (F.col("gap1") / t).alias("dissimilarity"),
        (F.col("near") / t).alias("homogeneity"),
        F.sqrt(F.col("n2") / (t * t)).alias("energy"),
        F.when(flat, F.lit(1.0))
        .otherwise(F.try_divide(cov, F.sqrt(var_i) * F.sqrt(var_j)))
        .alias("correlation"),
        (F.col("n2") / (t * t)).alias("ASM"),
        (F.log(t) - F.col("nlogn") / t).alias("entropy"),
    )


def glcm_features(
    pairs: DataFrame,
    objects: DataFrame,
    distances: list[int] = DISTANCES,
    angles: int = len(ANGLES),
    image: str = "image_id",
    obj: str = "obj",
) -> DataFrame:
    """Mean over the angles, one row per (object, channel, distance).

    An angle without pairs adds 0 to every property and 1 to the correlation.
    ``objects`` lists (image, obj, channel), so that objects too small for a
    distance keep their rows.
    """
    by_angle = _angle_properties(pairs, image, obj)
    keys = [image, obj, "channel", "d"]
    plain = [p for p in GLCM_PROPERTIES if p != "correlation"]
    summed = by_angle.groupBy(*keys).agg(
        *[F.sum(p).alias(f"_{p}") for p in plain],
        (F.sum("correlation") - F.count("*")).alias("_correlation"),
    )
    wanted = objects.select(
        image, obj, "channel", F.explode(F.array(*[F.lit(d) for d in distances])).alias("d")
    ).withColumn("d", F.col("d").cast("bigint"))
    return wanted.join(summed.hint("merge"), keys, "left").select(
        *keys,
        *[
            (
                (F.coalesce(F.col("_correlation"), F.lit(0.0)) + angles) / float(angles)
                if p == "correlation"
                else F.coalesce(F.col(f"_{p}"), F.lit(0.0)) / float(angles)
            ).alias(p)
            for p in GLCM_PROPERTIES
        ],
    )


def lbp_histogram(counts: DataFrame, image: str = "image_id", obj: str = "obj") -> DataFrame:
    """Share of each code per object, with empty codes up to the largest of the image.

    The counts feed both sides, so the small table is written once.
    """
    counts = cut_lineage(counts)
    top = counts.groupBy(image, "channel").agg(F.max("code").alias("_top"))
    own = (
        counts.filter(F.col(obj) > 0)
        .groupBy(image, obj, "channel")
        .agg(
            F.map_from_entries(F.collect_list(F.struct("code", "n"))).alias("_by_code"),
            F.sum("n").alias("_total"),
        )
    )
    return own.join(top.hint("merge"), [image, "channel"]).select(
        image,
        obj,
        "channel",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_top"))).alias("code"),
        "_by_code",
        "_total",
    ).select(
        image,
        obj,
        "channel",
        "code",
        (
            F.coalesce(F.col("_by_code")[F.col("code")], F.lit(0)).cast("double")
            / F.col("_total").cast("double")
        ).alias("p"),
    )


def lbp_metrics(histogram: DataFrame, image: str = "image_id", obj: str = "obj") -> DataFrame:
    """Seven metrics of each histogram; empty codes take part in the entropy.

    The ten codes become ten columns, so every metric is plain arithmetic on a row.
    """
    keys = [image, obj, "channel"]
    codes = range(10)
    spread = histogram.groupBy(*keys).agg(
        F.max("code").alias("_top"),
        (F.sum("p") + TINY).alias("_sum"),
        *[F.sum(F.when(F.col("code") == k, F.col("p")).otherwise(0.0)).alias(f"_p{k}") for k in codes],
    )
    shares = spread.select(
        *keys, "_top", *[(F.col(f"_p{k}") / F.col("_sum")).alias(f"_h{k}") for k in codes]
    )

    def total(of) -> Column:
        return sum((of(k, F.col(f"_h{k}")) for k in codes[1:]), of(0, F.col("_h0")))

    def moment(power: int) -> Column:
        def term(k: int, h: Column) -> Column:
            gap = F.lit(float(k)) - F.col("mean_code")
            for _ in range(power):
                h = h * gap
            return h

        return total(term)

    def surprise(k: int, h: Column) -> Column:
        return F.when(F.lit(k) <= F.col("_top"), -(h + TINY) * F.log(h + TINY)).otherwise(0.0)

    centred = shares.withColumn("mean_code", total(lambda k, h: h * float(k)))
    return centred.withColumns(
        {
            "entropy": total(surprise),
            "asm": total(lambda _, h: h * h),
            "var_code": moment(2),
            "_m3": moment(3),
            "_m4": moment(4),
        }
    ).select(
        *keys,
        "entropy",
        F.sqrt("asm").alias("energy"),
        "asm",
        "mean_code",
        "var_code",
        (F.col("_m3") / (F.pow("var_code", F.lit(1.5)) + TINY)).alias("skewness"),
        (F.col("_m4") / (F.col("var_code") * F.col("var_code") + TINY)).alias("kurtosis"),
    )


def pivot_channels(
    df: DataFrame,
    channels: list[str],
    metrics: list[str],
    infix: str,
    image: str = "image_id",
    obj: str = "obj",
    distances: list[int] | None = None,
) -> DataFrame:
    """Long (channel[, d]) rows to the wide columns of the object table."""
    wide = []
    for c in channels:
        for m in metrics:
            for d in distances or [None]:
                here = f"channel = '{c}'" + ("" if d is None else f" and d = {d}")
                name = f"{c}_{infix}_{m}" + ("" if d is None else f"_d{d}")
                wide.append(F.expr(f"max(case when {here} then `{m}` end) as {name}"))
    return df.groupBy(image, obj).agg(*wide)


def object_channels(
    pixels: DataFrame, channels: list[str], image: str = "image_id", obj: str = "obj"
) -> DataFrame:
    """(image, obj, channel) of every labelled object."""
    return (
        pixels.filter(F.col(obj) > 0)
        .select(image, obj)
        .distinct()
        .withColumn("channel", F.explode(F.array(*[F.lit(c) for c in channels])))
    )


def texture_of_counts(
    patterns: DataFrame,
    pairs: DataFrame,
    channels: list[str],
    image: str = "image_id",
    obj: str = "obj",
) -> DataFrame:
    """All LBP and GLCM columns per object from their counts."""
    metrics = lbp_metrics(lbp_histogram(patterns, image, obj), image, obj)
    glcm = glcm_features(
        pairs,
        metrics.select(image, obj, "channel"),
        image=image,
        obj=obj,
    )
    return pivot_channels(metrics, channels, LBP_METRICS, "lbp", image, obj).join(
        pivot_channels(glcm, channels, GLCM_PROPERTIES, "glcm", image, obj, DISTANCES).hint("merge"), [image, obj]
    )
