"""Connected regions of equal value in pixel tables.

Regions are first labelled inside tiles; only pixels on tile borders, about one in
a hundred, are joined to find which tile regions belong together.  That small graph
is contracted to stars in rounds, and each round is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmetry.operators.ranking import bucketed_row_number
from cellmetry.operators.tiles import SIDE, Stack, key_type, listed, over_stacks
from cellmetry.session import cut_lineage

ROW = 1 << 31  # a region is named by its first pixel, y * ROW + x


def _tile_regions(values: np.ndarray, full: bool) -> np.ndarray:
    """Smallest flat index of the region of each cell of arrays (..., row, column), -1 being empty."""
    h, w = values.shape[-2:]
    new = np.ones(values.shape, dtype=bool)
    new[..., 1:] = values[..., 1:] != values[..., :-1]
    starts = np.flatnonzero(new)
    run = (np.cumsum(new.ravel()) - 1).reshape(values.shape)
    a, b = [], []
    for dx in (0, 1, -1) if full else (0,):
        here = (..., slice(0, h - 1), slice(max(0, -dx), w - max(0, dx)))
        there = (..., slice(1, h), slice(max(0, dx), w - max(0, -dx)))
        same = (values[here] == values[there]) & (values[here] >= 0)
        above, below = run[here][same], run[there][same]
        # Runs of pixels touch in runs of equal pairs.
        first = np.ones(len(above), dtype=bool)
        first[1:] = (above[1:] != above[:-1]) | (below[1:] != below[:-1])
        a.append(above[first])
        b.append(below[first])
    a, b = np.concatenate(a), np.concatenate(b)
    root = np.arange(len(starts))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        while True:
            jump = root[root]
            if np.array_equal(jump, root):
                break
            root = jump
        if np.array_equal(root, before):
            return starts[root][run]


def _contract(edges: DataFrame, image: str) -> DataFrame:
    """Region pairs (a, b) to (region, root), root being the smallest name reached.

    Alternating large-star and small-star steps; rounds grow with the logarithm of
    the longest chain of tiles.
    """

    def star(pairs: DataFrame, small: bool) -> DataFrame:
        if small:
            around = pairs.select(
                image, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
            )
        else:
            around = pairs.select(image, F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
                pairs.select(image, F.col("b").alias("u"), F.col("a").alias("v"))
            )
        lowest = around.groupBy(image, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        joined = around.join(lowest.hint("merge"), [image, "u"])
        if small:
            moved = joined.select(image, F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
                joined.select(image, F.col("u").alias("a"), F.col("m").alias("b"))
            )
        else:
            moved = joined.filter(F.col("v") > F.col("u")).select(
                image, F.col("v").alias("a"), F.col("m").alias("b")
            )
        return moved.filter(F.col("a") != F.col("b")).distinct()

    def mark(pairs: DataFrame) -> tuple:
        return tuple(
            pairs.agg(
                F.count("*"), F.sum(F.xxhash64(image, "a", "b").cast("decimal(38,0)"))
            ).first()
        )

    current = cut_lineage(edges.filter(F.col("a") != F.col("b")).distinct())
    seen = mark(current)
    while seen[0]:
        current = cut_lineage(star(star(current, small=False), small=True))
        now = mark(current)
        if now == seen:
            break
        seen = now
    return current.select(
        image, F.greatest("a", "b").alias("region"), F.least("a", "b").alias("root")
    )


def twice_areas(stack: Stack, here: np.ndarray) -> np.ndarray:
    """Twice the area of the contours of hole-free regions, in parts per pixel.

    A square belongs to its upper left pixel or, where that one is missing, to the upper right.
    """
    east, south, west = (stack.core(here, *d) for d in ((0, 1), (1, 0), (0, -1)))
    squares = east.astype(np.int64) + south + stack.core(here, 1, 1)
    twice = np.where(squares == 3, 2, np.where(squares == 2, 1, 0))
    return twice + (~west & south & stack.core(here, 1, -1))


def region_rows(
    pixels: DataFrame,
    column: str,
    image: str = "image_id",
    full: bool = True,
    side: int = SIDE,
    areas: bool = False,
) -> DataFrame:
    """A row per region and tile: (image, column, root, points, top, end, left, right, twice).

    ``points`` are its pixels as y * ROW + x; a tile bounds their number.  ``root`` names the whole
    region by its first pixel, the four next are its extent in the tile, and ``twice``, with
    ``areas`` and if all pixels have one value and regions no holes, its share of twice the area.
    """

    def work(stack: Stack) -> tuple[np.ndarray, dict]:
        values = stack.core(stack.grid(column, -1))
        own = np.flatnonzero(values >= 0)
        first = _tile_regions(values, full).ravel()[own]
        order = np.argsort(first, kind="stable")
        own, first = own[order], first[order]
        starts = np.flatnonzero(np.diff(first, prepend=-1))
        tile, rows, cols = np.unravel_index(own, values.shape)
        y, x = stack.place(tile, rows, cols)
        points = y * ROW + x
        edge = np.isin(y % side, (0, side - 1)) | np.isin(x % side, (0, side - 1))
        per = np.concatenate([[0], np.cumsum(edge)])[starts]
        twice = twice_areas(stack, stack.present).ravel()[own] if areas else np.zeros(len(own), np.int64)

        def each(pick: np.ufunc, of: np.ndarray) -> np.ndarray:
            return pick.reduceat(of, starts) if len(of) else of

        return tile[starts], {
            column: values.ravel()[own[starts]],
            "region": points[starts],
            "points": listed(points, starts),
            "border": listed(points[edge], per),
            "top": each(np.minimum, y),
            "end": each(np.maximum, y),
            "left": each(np.minimum, x),
            "right": each(np.maximum, x),
            "twice": each(np.add, twice),
        }

    numbers = "top bigint, end bigint, left bigint, right bigint, twice bigint"
    lists = "points array<bigint>, border array<bigint>"
    schema = f"{key_type(pixels, image)}, {column} bigint, region bigint, {lists}, {numbers}"
    margin = (0, 1, 1, 1) if areas else (0, 0, 0, 0)
    local = cut_lineage(over_stacks(pixels.filter(F.col(column) > 0), work, schema, [column], margin, image, side))
    border = local.select(image, F.col(column), "region", F.explode("border").alias("_p")).select(
        image, column, "region", *pixel_at("_p")
    )
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if full else [])
    moved = border.select(
        image,
        F.col(column).alias("_from"),
        F.col("region").alias("a"),
        F.floor(F.col("y") / side).alias("_ty"),
        F.floor(F.col("x") / side).alias("_tx"),
        F.explode(
            F.array(
                *[
                    F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"))
                    for dy, dx in steps
                ]
            )
        ).alias("_to"),
    ).filter((F.floor(F.col("_to.y") / side) != F.col("_ty")) | (F.floor(F.col("_to.x") / side) != F.col("_tx")))
    edges = (
        moved.select(image, "_from", "a", "_to.y", "_to.x")
        .join(border.select(image, "y", "x", column, F.col("region").alias("b")).hint("merge"), [image, "y", "x"])
        .filter((F.col("_from") == F.col(column)) & (F.col("a") != F.col("b")))
        .select(image, "a", "b")
    )
    roots = _contract(edges, image)
    return local.drop("border").join(roots.hint("merge"), [image, "region"], "left").select(
        image, column, F.coalesce("root", "region").alias("root"), "points", "top", "end", "left", "right", "twice"
    )


def pixel_at(point: str) -> list[Column]:
    """y and x of a pixel named y * ROW + x."""
    return [F.shiftright(point, 31).alias("y"), F.col(point).bitwiseAND(F.lit(ROW - 1)).alias("x")]


def pixel_regions(
    pixels: DataFrame,
    column: str,
    image: str = "image_id",
    full: bool = True,
    side: int = SIDE,
) -> DataFrame:
    """(image, y, x, column, root): root names the region by its first pixel."""
    rows = region_rows(pixels, column, image, full, side)
    opened = rows.select(image, column, "root", F.explode("points").alias("_p"))
    return opened.select(image, *pixel_at("_p"), column, "root")


def label_components(
    pixels: DataFrame,
    column: str,
    image: str = "image_id",
    full: bool = True,
    side: int = SIDE,
) -> DataFrame:
    """Connected regions numbered 1, 2, ... per image in order of their first pixel.

    Background (0) is left out.  Numbers are wide integers, so no label wraps.
    """
    regions = pixel_regions(pixels, column, image, full, side)
    roots = regions.filter(F.col("root") == F.col("y") * F.lit(ROW) + F.col("x")).select(
        image, "root", "y"
    )
    numbered = bucketed_row_number(
        roots, [image], F.floor(F.col("y") / 64), [F.col("root")], "component"
    ).select(image, "root", "component")
    return regions.join(numbered.hint("merge"), [image, "root"]).select(image, "y", "x", column, "component")
