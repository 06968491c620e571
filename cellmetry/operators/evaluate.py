"""Instance segmentation scores and classification scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellmetry.session import cut_lineage


def instance_overlap(
    truth: DataFrame,
    predicted: DataFrame,
    gt: str = "obj",
    pred: str = "pred",
    image: str = "image_id",
) -> DataFrame:
    """Pixels shared by each pair of labels, background included.

    A pixel, or a whole image, that one mask lacks is background in it.  Filters on the
    result can turn the full join into an inner one, hence the hint: neither mask is ever
    broadcast.
    """
    none = F.lit(0).cast("bigint")
    return (
        truth.select(image, "y", "x", gt)
        .join(predicted.select(image, "y", "x", pred).hint("merge"), [image, "y", "x"], "full")
        .groupBy(image, F.coalesce(gt, none).alias(gt), F.coalesce(pred, none).alias(pred))
        .agg(F.count("*").alias("inter"))
    )


def scored_pairs(
    overlap: DataFrame, gt: str = "obj", pred: str = "pred", image: str = "image_id"
) -> DataFrame:
    """Overlapping object pairs with both areas and the union."""
    areas_gt = overlap.groupBy(image, gt).agg(F.sum("inter").alias("area_gt"))
    areas_pred = overlap.groupBy(image, pred).agg(F.sum("inter").alias("area_pred"))
    return (
        overlap.filter((F.col(gt) != 0) & (F.col(pred) != 0))
        .join(areas_gt.hint("merge"), [image, gt])
        .join(areas_pred.hint("merge"), [image, pred])
        .withColumn("union", F.col("area_gt") + F.col("area_pred") - F.col("inter"))
        .select(image, gt, pred, "inter", "area_gt", "area_pred", "union")
    )


def _iou() -> Column:
    return F.col("inter").cast("double") / F.col("union").cast("double")


def greedy_match(
    overlap: DataFrame,
    numerator: int = 4,
    denominator: int = 5,
    gt: str = "obj",
    pred: str = "pred",
    image: str = "image_id",
) -> DataFrame:
    """One-to-one matches by falling overlap ratio, at least numerator/denominator.

    The threshold is compared in whole numbers.  Above one half an object can have
    one partner only, so a filter is exact.  At or below, pairs that are the best
    of both their objects are taken in rounds; that equals the greedy order,
    because such a pair cannot be beaten to either object.  Each object sees its
    own few overlaps only.
    """
    pairs = scored_pairs(overlap, gt, pred, image).filter(
        F.col("inter") * denominator >= numerator * F.col("union")
    )
    pairs = pairs.withColumn("iou", _iou())
    if 2 * numerator > denominator:
        return pairs
    order = F.struct(-F.col("iou"), F.col(gt), F.col(pred))
    left = cut_lineage(pairs)
    matched = None
    while True:
        best_gt = left.groupBy(image, gt).agg(F.min(order).alias("_bg"))
        best_pred = left.groupBy(image, pred).agg(F.min(order).alias("_bp"))
        chosen = cut_lineage(
            left.join(best_gt.hint("merge"), [image, gt])
            .join(best_pred.hint("merge"), [image, pred])
            .filter((F.col("_bg") == order) & (F.col("_bp") == order))
            .select(*left.columns)
        )
        matched = chosen if matched is None else matched.unionByName(chosen)
        left = cut_lineage(
            left.join(chosen.select(image, gt).hint("merge"), [image, gt], "left_anti").join(
                chosen.select(image, pred).hint("merge"), [image, pred], "left_anti"
            )
        ).select(*left.columns)
        if left.isEmpty():
            return matched


def _ratio(a: Column, b: Column, otherwise: float) -> Column:
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(otherwise))


def segmentation_metrics(
    overlap: DataFrame,
    matches: DataFrame,
    gt: str = "obj",
    pred: str = "pred",
    image: str = "image_id",
) -> DataFrame:
    """Per image: iou, dice, precision, recall, f1, mae.

    Everything is taken from the overlap counts: a pixel's error depends on its two
    labels only, so the pixels are not read a second time.
    """
    counts = overlap.groupBy(image).agg(
        F.countDistinct(F.when(F.col(gt) != 0, F.col(gt))).alias("_n_gt"),
        F.countDistinct(F.when(F.col(pred) != 0, F.col(pred))).alias("_n_pred"),
    )
    hits = matches.groupBy(image).agg(
        F.count("*").alias("_n_match"),
        F.avg("iou").alias("_iou"),
        F.avg(
            2.0 * F.col("inter").cast("double") / (F.col("area_gt") + F.col("area_pred")).cast("double")
        ).alias("_dice"),
    )
    mapped = matches.select(image, pred, F.col(gt).alias("_mapped"))
    errors = (
        overlap.join(mapped.hint("merge"), [image, pred], "left")
        .groupBy(image)
        .agg(
            (
                F.sum(F.col("inter") * F.abs(F.col(gt) - F.coalesce(F.col("_mapped"), F.lit(0)))).cast(
                    "double"
                )
                / F.sum("inter").cast("double")
            ).alias("_mae")
        )
    )
    joined = counts.join(hits.hint("merge"), image, "left").join(errors.hint("merge"), image)
    n_match = F.coalesce(F.col("_n_match"), F.lit(0))
    empty = (F.col("_n_gt") == 0) & (F.col("_n_pred") == 0)
    precision = _ratio(n_match, F.col("_n_pred"), 1.0)
    recall = _ratio(n_match, F.col("_n_gt"), 1.0)
    f1 = F.when(precision + recall > 0, 2.0 * precision * recall / (precision + recall)).otherwise(
        F.lit(0.0)
    )

    def unless_empty(value: Column, whole: float) -> Column:
        return F.when(empty, F.lit(whole)).otherwise(value)

    return joined.select(
        image,
        unless_empty(F.coalesce(F.col("_iou"), F.lit(0.0)), 1.0).alias("iou"),
        unless_empty(F.coalesce(F.col("_dice"), F.lit(0.0)), 1.0).alias("dice"),
        unless_empty(precision, 1.0).alias("precision"),
        unless_empty(recall, 1.0).alias("recall"),
        unless_empty(f1, 1.0).alias("f1"),
        unless_empty(F.col("_mae"), 0.0).alias("mae"),
    )


def segmentation_summary(metrics: DataFrame) -> DataFrame:
    return metrics.agg(
        *[F.avg(c).alias(c) for c in ("iou", "dice", "precision", "recall", "f1", "mae")]
    )


def _known(label: str, n_classes: int) -> Column:
    """The label; one outside 0..n_classes-1, or a missing one, is an error."""
    named = F.coalesce(F.col(label).cast("string"), F.lit("null"))
    wrong = F.raise_error(F.concat(F.lit(f"{label} outside 0..{n_classes - 1}: "), named))
    return F.when(F.col(label).between(0, n_classes - 1), F.col(label)).otherwise(
        wrong.cast("bigint")
    )


def class_counts(df: DataFrame, n_classes: int, label: str = "label") -> DataFrame:
    """Rows per class with zeros for absent classes.  ``n_classes`` is a parameter, so
    the class list is generated, not read.  Other labels are an error."""
    classes = df.sparkSession.range(n_classes).select(F.col("id").alias(label))
    counted = df.groupBy(_known(label, n_classes).alias(label)).agg(F.count("*").alias("n"))
    return classes.join(counted, label, "left").select(
        label, F.coalesce("n", F.lit(0).cast("bigint")).alias("n")
    )


def class_weights(df: DataFrame, n_classes: int, label: str = "label") -> DataFrame:
    """n / (K * n_c); 0 for an empty class."""
    counted = class_counts(df, n_classes, label)
    total = F.sum("n").over(Window.partitionBy())  # K rows
    return counted.select(
        label,
        F.when(
            F.col("n") > 0, total.cast("double") / (F.lit(float(n_classes)) * F.col("n"))
        )
        .otherwise(F.lit(0.0))
        .alias("weight"),
    )


def confusion_matrix(
    df: DataFrame, n_classes: int, truth: str = "label", predicted: str = "predicted"
) -> DataFrame:
    """Dense K x K counts with the share of each true class.

    Labels outside 0..K-1 are an error.  The rows are counted first; all later steps see K * K rows.
    """
    k = F.lit(n_classes)
    cells = df.sparkSession.range(n_classes * n_classes).select(
        F.floor(F.col("id") / k).cast("bigint").alias("label"), (F.col("id") % k).alias("predicted")
    )
    counted = df.groupBy(
        _known(truth, n_classes).alias("label"), _known(predicted, n_classes).alias("predicted")
    ).agg(F.count("*").alias("n"))
    dense = cells.join(counted, ["label", "predicted"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0).cast("bigint"))
    )
    row = F.sum("n").over(Window.partitionBy("label"))
    return dense.withColumn("share", _ratio(F.col("n"), row, 0.0))


def _class_scores(confusion: DataFrame) -> DataFrame:
    """Per class: true positives, support, predicted count."""
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    rows = confusion.groupBy("label").agg(F.sum(hit).alias("tp"), F.sum("n").alias("support"))
    cols = confusion.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("claimed"))
    scored = rows.join(cols, "label").withColumns(
        {
            "recall": _ratio(F.col("tp"), F.col("support"), 0.0),
            "precision": _ratio(F.col("tp"), F.col("claimed"), 0.0),
        }
    )
    both = F.col("precision") + F.col("recall")
    return scored.withColumn(
        "f1",
        F.when(both > 0, 2.0 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0)),
    )


def balanced_metrics(confusion: DataFrame) -> DataFrame:
    """Macro recall, precision and F1; absent classes count as 0."""
    return _class_scores(confusion).agg(
        F.avg("recall").alias("balanced_accuracy"),
        F.avg("precision").alias("balanced_precision"),
        F.avg("f1").alias("balanced_f1"),
    )


def classification_report(confusion: DataFrame) -> DataFrame:
    """Accuracy, balanced accuracy, micro and weighted precision, recall and F1.

    Balanced accuracy here skips classes without true rows.
    """
    scored = _class_scores(confusion)
    n = F.sum("support").cast("double")
    micro = F.sum("tp").cast("double") / n

    def weighted(c: str) -> Column:
        return F.sum(F.col(c) * F.col("support")) / n

    return scored.agg(
        micro.alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("bal_accuracy"),
        micro.alias("global_precision"),
        weighted("precision").alias("weighted_precision"),
        micro.alias("global_recall"),
        weighted("recall").alias("weighted_recall"),
        micro.alias("global_f1_score"),
        weighted("f1").alias("weighted_f1_score"),
    )


def macro_f1(confusion: DataFrame) -> DataFrame:
    """Mean F1 over the classes seen in truth or prediction."""
    seen = (F.col("support") > 0) | (F.col("claimed") > 0)
    return _class_scores(confusion).agg(F.avg(F.when(seen, F.col("f1"))).alias("macro_f1"))


def mean_squared_error(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    gap = F.col(truth).cast("double") - F.col(predicted).cast("double")
    return df.agg(F.avg(gap * gap).alias("mse"))
