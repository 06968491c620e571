"""Geometry of one closed ring, as column expressions.

A contour is ``ARRAY<STRUCT<x: BIGINT, y: BIGINT>>`` in ring order.  All of these
are narrow: the ring travels inside its row, so no vertex table is shuffled.
Integer arithmetic keeps areas, centroids and containment exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTOUR_TYPE = "array<struct<x:bigint,y:bigint>>"


def ring_edges(contour: Column) -> Column:
    """Edges of the closed ring as ``ARRAY<STRUCT<x1,y1,x2,y2>>``."""
    shifted = F.concat(F.slice(contour, 2, F.size(contour)), F.slice(contour, 1, 1))
    return F.zip_with(
        contour,
        shifted,
        lambda a, b: F.struct(
            a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")
        ),
    )


def _cross(e: Column) -> Column:
    return e["x1"] * e["y2"] - e["x2"] * e["y1"]


def ring_sums(edges: Column) -> Column:
    """One pass over the edges: doubled signed area, doubled first moments, length."""
    zero = F.struct(
        F.lit(0).cast("bigint").alias("a2"),
        F.lit(0).cast("bigint").alias("sx"),
        F.lit(0).cast("bigint").alias("sy"),
        F.lit(0.0).alias("length"),
    )

    def add(acc: Column, e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        return F.struct(
            (acc["a2"] + _cross(e)).alias("a2"),
            (acc["sx"] + (e["x1"] + e["x2"]) * _cross(e)).alias("sx"),
            (acc["sy"] + (e["y1"] + e["y2"]) * _cross(e)).alias("sy"),
            (acc["length"] + F.sqrt((dx * dx + dy * dy).cast("double"))).alias("length"),
        )

    return F.aggregate(edges, zero, add)


def area(sums: Column) -> Column:
    return F.abs(sums["a2"]).cast("double") / F.lit(2.0)


def _truncated_ratio(numerator: Column, denominator: Column) -> Column:
    """Integer quotient truncated toward zero; null for a zero denominator."""
    remainder = F.try_mod(numerator, denominator)
    return F.when(denominator != 0, ((numerator - remainder) / denominator).cast("bigint"))


def centroid_x(sums: Column) -> Column:
    return _truncated_ratio(sums["sx"], 3 * sums["a2"])


def centroid_y(sums: Column) -> Column:
    return _truncated_ratio(sums["sy"], 3 * sums["a2"])


def roundness(area_: Column, perimeter: Column) -> Column:
    """Squared perimeter over 4*pi*area; null for a flat ring."""
    return F.try_divide(perimeter * perimeter, F.lit(4.0) * F.pi() * area_)


def radius_ratio(contour: Column, cx: Column, cy: Column) -> Column:
    """Largest over smallest non-zero distance from the centre to a vertex."""
    squared = F.transform(
        contour, lambda p: (p["x"] - cx) * (p["x"] - cx) + (p["y"] - cy) * (p["y"] - cy)
    )
    nonzero = F.filter(squared, lambda d: d > 0)
    return F.try_divide(
        F.sqrt(F.array_max(squared).cast("double")), F.sqrt(F.array_min(nonzero).cast("double"))
    )


def bounding_box(contour: Column) -> Column:
    """Struct x, y, w, h with w = max - min + 1."""
    xs, ys = contour["x"], contour["y"]
    return F.struct(
        F.array_min(xs).alias("x"),
        F.array_min(ys).alias("y"),
        (F.array_max(xs) - F.array_min(xs) + 1).alias("w"),
        (F.array_max(ys) - F.array_min(ys) + 1).alias("h"),
    )


def point_side(edges: Column, px: Column, py: Column) -> Column:
    """+1 strictly inside, 0 on the ring, -1 outside (crossing parity, exact)."""

    def turn(e: Column) -> Column:
        return (e["x2"] - e["x1"]) * (py - e["y1"]) - (px - e["x1"]) * (e["y2"] - e["y1"])

    def on_edge(e: Column) -> Column:
        return (
            (turn(e) == 0)
            & px.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
            & py.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
        )

    def crosses(e: Column) -> Column:
        rising = e["y2"] > e["y1"]
        return ((e["y1"] > py) != (e["y2"] > py)) & F.when(rising, turn(e) > 0).otherwise(
            turn(e) < 0
        )

    odd = F.size(F.filter(edges, crosses)) % 2 == 1
    return (
        F.when(F.exists(edges, on_edge), F.lit(0))
        .when(odd, F.lit(1))
        .otherwise(F.lit(-1))
        .cast("bigint")
    )


def parse_contour_text(text: Column) -> Column:
    """Text form ``[[[x y]] [[x y]] ...]`` to a contour; null when the text is malformed."""
    shape = r"^\s*\[\s*(\[\s*\[\s*-?\d+\s+-?\d+\s*\]\s*\]\s*)+\]\s*$"
    pairs = F.regexp_extract_all(text, F.lit(r"(-?\d+\s+-?\d+)"), F.lit(1))
    points = F.transform(
        pairs,
        lambda p: F.struct(
            F.split(p, r"\s+")[0].cast("bigint").alias("x"),
            F.split(p, r"\s+")[1].cast("bigint").alias("y"),
        ),
    )
    return F.when(text.rlike(shape), points)
