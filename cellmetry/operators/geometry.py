"""Shape features of objects.  Every operator here is narrow: no shuffle at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmetry.functions import contour as ring
from cellmetry.functions.solvers import fit_axes, fit_box, interior_pole as pole


def with_ring(df: DataFrame, contour: str = "contour") -> DataFrame:
    """Add ``_edges`` and the one-pass ``_sums`` that the features read."""
    return df.withColumn("_edges", ring.ring_edges(F.col(contour))).withColumn(
        "_sums", ring.ring_sums(F.col("_edges"))
    )


def drop_ring(df: DataFrame) -> DataFrame:
    return df.drop("_edges", "_sums")


def polygon_features(df: DataFrame) -> DataFrame:
    """area, perimeter, cx, cy, radius_ratio about the centroid, roundness."""
    measured = with_ring(df).withColumns(
        {
            "area": ring.area(F.col("_sums")),
            "perimeter": F.col("_sums.length"),
            "cx": ring.centroid_x(F.col("_sums")),
            "cy": ring.centroid_y(F.col("_sums")),
        }
    )
    return drop_ring(
        measured.withColumns(
            {
                "radius_ratio": ring.radius_ratio(F.col("contour"), F.col("cx"), F.col("cy")),
                "roundness": ring.roundness(F.col("area"), F.col("perimeter")),
            }
        )
    )


def bounding_boxes(df: DataFrame) -> DataFrame:
    return df.withColumn("_box", ring.bounding_box(F.col("contour"))).select(
        *df.columns, "_box.x", "_box.y", "_box.w", "_box.h"
    )


def object_centre(df: DataFrame) -> DataFrame:
    """cx_coords, cy_coords: the centroid, or the interior pole where it is not inside."""
    placed = with_ring(df).withColumns(
        {"_cx": ring.centroid_x(F.col("_sums")), "_cy": ring.centroid_y(F.col("_sums"))}
    )
    inside = F.coalesce(
        ring.point_side(F.col("_edges"), F.col("_cx"), F.col("_cy")) > 0, F.lit(False)
    )
    polled = placed.withColumn("_inside", inside).withColumn(
        "_pole", pole(F.when(~F.col("_inside"), F.col("contour")))
    )
    chosen = polled.withColumns(
        {
            "cx_coords": F.when(F.col("_inside"), F.col("_cx")).otherwise(F.col("_pole.x")),
            "cy_coords": F.when(F.col("_inside"), F.col("_cy")).otherwise(F.col("_pole.y")),
        }
    )
    return drop_ring(chosen).drop("_cx", "_cy", "_inside", "_pole")


def interior_poles(df: DataFrame) -> DataFrame:
    """Deepest integer point of every ring and its squared distance is left to the caller."""
    return df.withColumn("_pole", pole(F.col("contour"))).select(
        *df.columns, F.col("_pole.x").alias("pole_x"), F.col("_pole.y").alias("pole_y")
    )


def aspect_and_eccentricity(major: Column, minor: Column) -> tuple[Column, Column]:
    """Aspect and the data set's own eccentricity, which divides by the squared axis."""
    focal = F.sqrt(F.greatest(major * major - minor * minor, F.lit(0.0)))
    return F.try_divide(major, minor), F.try_divide(focal, major * major)


def ellipse_features(df: DataFrame) -> DataFrame:
    fitted = df.withColumn("_fit", fit_axes(F.col("contour")))
    aspect, eccentricity = aspect_and_eccentricity(F.col("_fit.major"), F.col("_fit.minor"))
    return fitted.withColumns({"aspect": aspect, "eccentricity": eccentricity}).drop("_fit")


def area_box(df: DataFrame) -> DataFrame:
    measured = with_ring(df).withColumn("_box_area", fit_box(F.col("contour")))
    return drop_ring(
        measured.withColumn(
            "area_box", F.try_divide(ring.area(F.col("_sums")), F.col("_box_area"))
        )
    ).drop("_box_area")


def irregularity_index(
    aspect: Column, area_box_: Column, radius_ratio: Column, roundness: Column
) -> Column:
    # Published weights of the index.
    return 0.9 * aspect - 0.87 * area_box_ + 0.96 * radius_ratio + 0.92 * roundness


def morpho_features(df: DataFrame) -> DataFrame:
    """All seven shape features and the centre of each object, in one narrow pass."""
    centred = with_ring(object_centre(df))
    fitted = centred.withColumns(
        {"_fit": fit_axes(F.col("contour")), "_box_area": fit_box(F.col("contour"))}
    )
    aspect, eccentricity = aspect_and_eccentricity(F.col("_fit.major"), F.col("_fit.minor"))
    measured = fitted.withColumn("area", ring.area(F.col("_sums"))).withColumns(
        {
            "area_box": F.try_divide(F.col("area"), F.col("_box_area")),
            "radius_ratio": ring.radius_ratio(
                F.col("contour"), F.col("cx_coords"), F.col("cy_coords")
            ),
            "aspect": aspect,
            "eccentricity": eccentricity,
            "roundness": ring.roundness(F.col("area"), F.col("_sums.length")),
        }
    )
    indexed = measured.withColumn(
        "ii",
        irregularity_index(
            F.col("aspect"), F.col("area_box"), F.col("radius_ratio"), F.col("roundness")
        ),
    )
    return drop_ring(indexed).drop("_fit", "_box_area")
