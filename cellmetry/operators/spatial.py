"""Joins by position: parents of nuclei, close pairs, pair distances, filled rings.

Work is keyed by (image, grid cell) or (image, chunk pair), never by image alone,
so one crowded image spreads over many tasks.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellmetry.functions import contour as ring
from cellmetry.functions.solvers import closest_vertices, ring_spans
from cellmetry.operators.relational import prefix_columns
from cellmetry.operators.tiles import by_task

GRID = 64  # side of a grid cell in pixels
CHUNK = 512  # fewest objects per chunk in the pair distance step
LARGEST_CHUNK = 20_000  # most objects per chunk, which bounds a task's memory


def _cell(value: Column, grid: int) -> Column:
    return F.floor(value / F.lit(grid)).cast("bigint")


def _over_cells(df: DataFrame, grid: int, margin: int = 0) -> DataFrame:
    """Repeat each object for the grid cells its bounding box (plus margin) meets."""
    low_x, low_y = F.col("_box.x") - margin, F.col("_box.y") - margin
    high_x = F.col("_box.x") + F.col("_box.w") - 1 + margin
    high_y = F.col("_box.y") + F.col("_box.h") - 1 + margin
    return df.withColumn(
        "_cell_y", F.explode(F.sequence(_cell(low_y, grid), _cell(high_y, grid)))
    ).withColumn("_cell_x", F.explode(F.sequence(_cell(low_x, grid), _cell(high_x, grid))))


def nucleus_parents(
    nuclei: DataFrame,
    cytoplasms: DataFrame,
    image: str = "image_id",
    nucleus: str = "nucleus_id",
    parent: str = "object_id",
    point: tuple[str, str] = ("px", "py"),
    grid: int = GRID,
) -> DataFrame:
    """First cytoplasm (by ``parent`` order) of the image whose ring holds the nucleus
    centre ``point``, border included; nuclei without parent drop out.

    Columns: image, nucleus, parent.
    """
    rings = _over_cells(
        cytoplasms.select(
            image,
            parent,
            ring.ring_edges(F.col("contour")).alias("_edges"),
            ring.bounding_box(F.col("contour")).alias("_box"),
        ),
        grid,
    )
    points = nuclei.select(
        image,
        nucleus,
        F.col(point[0]).alias("px"),
        F.col(point[1]).alias("py"),
        _cell(F.col(point[1]), grid).alias("_cell_y"),
        _cell(F.col(point[0]), grid).alias("_cell_x"),
    )
    near = points.join(rings, [image, "_cell_y", "_cell_x"]).filter(
        F.col("px").between(F.col("_box.x"), F.col("_box.x") + F.col("_box.w") - 1)
        & F.col("py").between(F.col("_box.y"), F.col("_box.y") + F.col("_box.h") - 1)
        & (ring.point_side(F.col("_edges"), F.col("px"), F.col("py")) >= 0)
    )
    return near.groupBy(image, nucleus).agg(F.min(parent).alias(parent))


def link_objects(
    nuclei: DataFrame,
    cytoplasms: DataFrame,
    image: str = "image_id",
    nucleus: str = "nucleus_id",
    parent: str = "object_id",
    point: tuple[str, str] = ("px", "py"),
) -> DataFrame:
    """One row per nucleus with a parent: all ``cyto_*`` and all ``nuc_*`` columns."""
    links = nucleus_parents(nuclei, cytoplasms, image, nucleus, parent, point)
    cyto = prefix_columns(cytoplasms, "cyto_")
    nuc = prefix_columns(nuclei, "nuc_")
    with_nucleus = links.withColumnsRenamed(
        {image: "_image", nucleus: "_nucleus", parent: "_parent"}
    ).join(
        nuc,
        (F.col("_image") == F.col(f"nuc_{image}")) & (F.col("_nucleus") == F.col(f"nuc_{nucleus}")),
    )
    return with_nucleus.join(
        cyto,
        (F.col("_image") == F.col(f"cyto_{image}")) & (F.col("_parent") == F.col(f"cyto_{parent}")),
    ).select(*cyto.columns, *nuc.columns)


def contour_min_distance(
    objects: DataFrame,
    max_gap: int,
    image: str = "image_id",
    key: str = "object_id",
    grid: int = GRID,
) -> DataFrame:
    """Closest vertex pair of every two objects of an image at most ``max_gap`` apart.

    Boxes widened by the gap meet in a grid cell; a pair is taken only in the cell
    that holds the corner of the box overlap, so no pair appears twice and none
    needs a distinct.
    """
    small = objects.select(
        image, key, "contour", ring.bounding_box(F.col("contour")).alias("_box")
    )
    left = _over_cells(small, grid, max_gap).withColumnsRenamed(
        {key: "id_a", "contour": "_ca", "_box": "_ba"}
    )
    right = _over_cells(small, grid).withColumnsRenamed(
        {key: "id_b", "contour": "_cb", "_box": "_bb"}
    )
    corner_x = F.greatest(F.col("_ba.x") - max_gap, F.col("_bb.x"))
    corner_y = F.greatest(F.col("_ba.y") - max_gap, F.col("_bb.y"))

    def gap(axis: str, size: str) -> Column:
        a, b = F.col(f"_ba.{axis}"), F.col(f"_bb.{axis}")
        return F.greatest(
            b - (a + F.col(f"_ba.{size}") - 1), a - (b + F.col(f"_bb.{size}") - 1), F.lit(0)
        )

    near = left.join(right, [image, "_cell_y", "_cell_x"]).filter(
        (F.col("id_a") < F.col("id_b"))
        & (F.col("_cell_x") == _cell(corner_x, grid))
        & (F.col("_cell_y") == _cell(corner_y, grid))
        & (gap("x", "w") * gap("x", "w") + gap("y", "h") * gap("y", "h") <= max_gap * max_gap)
    )
    return (
        near.withColumn("_best", closest_vertices(F.col("_ca"), F.col("_cb")))
        .filter(F.col("_best.distance2") <= max_gap * max_gap)
        .select(
            image,
            "id_a",
            "id_b",
            F.sqrt(F.col("_best.distance2").cast("double")).alias("distance"),
            "_best.ax",
            "_best.ay",
            "_best.bx",
            "_best.by",
        )
    )


def _min_distances2(a: tuple, xs: np.ndarray, ys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Smallest squared vertex distance from ring ``a`` to each of several rings."""
    best = np.full(len(xs), np.iinfo(np.int64).max)
    step = max(1, 2_000_000 // len(xs))
    for k in range(0, len(a[0]), step):
        dx = a[0][k : k + step, None] - xs
        dy = a[1][k : k + step, None] - ys
        np.minimum(best, (dx * dx + dy * dy).min(axis=0), out=best)
    return np.minimum.reduceat(best, starts)


def _count_distances(pdf: pd.DataFrame) -> pd.DataFrame:
    """Counts of (label pair, squared distance) for one pair of chunks."""
    pdf = pdf.sort_values("_key", kind="stable").reset_index(drop=True)
    low, high = pdf["_low"].iat[0], pdf["_high"].iat[0]
    rings = [(np.asarray(x), np.asarray(y)) for x, y in zip(pdf["_xs"], pdf["_ys"])]
    chunk, label = pdf["_chunk"].to_numpy(), pdf["_label"].to_numpy()
    second = np.flatnonzero(chunk == high)
    found, held = [], 0

    def folded() -> list[np.ndarray]:
        rows, n = np.unique(np.concatenate([f[:, :3] for f in found]), axis=0, return_inverse=True)
        counts = np.bincount(n.ravel(), np.concatenate([f[:, 3] for f in found]), len(rows))
        return [np.column_stack([rows, counts.astype(np.int64)])]

    if len(second):
        xs = np.concatenate([rings[k][0] for k in second])
        ys = np.concatenate([rings[k][1] for k in second])
        sizes = np.array([len(rings[k][0]) for k in second])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        for position, k in enumerate(np.flatnonzero(chunk == low)):
            skip = position + 1 if low == high else 0
            if skip >= len(second):
                continue
            d = _min_distances2(
                rings[k],
                xs[starts[skip] :],
                ys[starts[skip] :],
                starts[skip:] - starts[skip],
            )
            other = label[second[skip:]]
            found.append(
                np.stack(
                    [np.minimum(label[k], other), np.maximum(label[k], other), d, np.ones_like(d)],
                    axis=1,
                )
            )
            held += len(d)
            if held > 1 << 20:
                found, held = folded(), 0
    if not found:
        return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("label_a", "label_b", "d2", "n")})
    rows = folded()[0]
    return pd.DataFrame(dict(zip(("label_a", "label_b", "d2", "n"), rows.T)))


def pair_distance_counts(
    objects: DataFrame,
    image: str = "image_id",
    key: str = "object_id",
    label: str = "label",
    chunk: int = CHUNK,
) -> DataFrame:
    """How often each smallest contour distance occurs, per sorted label pair.

    Covers every pair of objects of an image without ever holding a row per pair:
    an image is cut into chunks of ``chunk`` objects or more, a task compares two
    chunks and returns counts.  Squared distances of pixel coordinates are whole
    numbers below the squared image diagonal, so the result stays small and
    keeps every distance.
    """
    # Pairs of g x g chunks fill the cores; a contour is copied g times, not n / chunk.
    cores = objects.sparkSession.sparkContext.defaultParallelism
    enough, n = isqrt(2 * cores) + 1, F.count("*")
    chunks = F.greatest(
        F.least(F.ceil(n / F.lit(chunk)), F.lit(enough)), F.ceil(n / F.lit(LARGEST_CHUNK))
    )
    sized = objects.groupBy(image).agg(chunks.cast("bigint").alias("_chunks"))
    placed = (
        objects.filter(F.col(label).isNotNull() & (F.size("contour") > 0))
        .select(
            image,
            F.col(key).alias("_key"),
            F.col(label).cast("bigint").alias("_label"),
            F.col("contour.x").alias("_xs"),
            F.col("contour.y").alias("_ys"),
        )
        .join(sized, image)
        .withColumn("_chunk", F.pmod(F.xxhash64("_key"), F.col("_chunks")))
        .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_chunks") - 1)))
        .withColumn("_low", F.least("_chunk", "_other"))
        .withColumn("_high", F.greatest("_chunk", "_other"))
        .drop("_chunks", "_other")
    )
    unit = [image, "_low", "_high"]
    counted = by_task(placed, *unit).groupBy(*unit).applyInPandas(
        _count_distances, "label_a bigint, label_b bigint, d2 bigint, n bigint"
    )
    return (
        counted.groupBy("label_a", "label_b", "d2")
        .agg(F.sum("n").alias("n_pairs"))
        .select(
            "label_a",
            "label_b",
            F.sqrt(F.col("d2").cast("double")).alias("distance"),
            "n_pairs",
        )
    )


def ordered_pair_counts(counts: DataFrame) -> DataFrame:
    """Ordered pairs with class_1 <= class_2: pairs of one class count twice."""
    twice = F.when(F.col("label_a") == F.col("label_b"), 2).otherwise(1)
    return counts.withColumn("n_pairs", F.col("n_pairs") * twice)


def distance_histogram(counts: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width bins between the smallest and largest distance of each label pair."""
    pair = ["label_a", "label_b"]
    whole = Window.partitionBy(*pair)  # distances of a label pair: below the image diagonal
    place = F.when(F.col("_low") == F.col("_high"), F.lit(bins // 2)).otherwise(
        F.least(
            F.floor(
                F.try_divide(
                    (F.col("distance") - F.col("_low")) * bins, F.col("_high") - F.col("_low")
                )
            ),
            F.lit(bins - 1),
        )
    )
    return (
        counts.withColumns(
            {"_low": F.min("distance").over(whole), "_high": F.max("distance").over(whole)}
        )
        .withColumn("bin", place.cast("bigint"))
        .groupBy(*pair, "bin")
        .agg(F.sum("n_pairs").alias("n_pairs"))
    )


def polygon_rasterize(
    objects: DataFrame, image: str = "image_id", key: str = "object_id"
) -> DataFrame:
    """Pixels (y, x) covered by each ring, border included.

    Spans are generated from the ring itself, so filling needs no join with a pixel
    table and no shuffle.
    """
    spans = objects.select(
        image, key, F.explode(ring_spans(F.col("contour.x"), F.col("contour.y"))).alias("_s")
    )
    return spans.select(
        image, key, F.col("_s.y").alias("y"), F.explode(F.sequence("_s.first", "_s.last")).alias("x")
    )
