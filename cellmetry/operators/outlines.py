"""Outer contours of mask regions: their area, and their points in order.

The contour of a region runs through the centres of its border pixels.  Its area
needs no order: a square of four neighbouring pixels adds one if all belong to the
region and a half if three do.  The order comes from the successor of each step, which the
eight neighbours of a pixel decide: steps are chained inside tiles, and only chains that leave
a tile are joined, by doubling the distance to the start of the contour.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmetry.operators.components import ROW, _contract, pixel_at, region_rows, twice_areas
from cellmetry.operators.tiles import RING, SIDE, Stack, key_type, listed, over_stacks
from cellmetry.session import cut_lineage, discard


def outside_filled(
    pixels: DataFrame, column: str, image: str = "image_id", side: int = SIDE
) -> DataFrame:
    """Pixels (image, y, x) of a mask and of the background it encloses.

    Background is connected through sides, not corners; regions of it that touch the
    border of the (dense) image are open.  Regions nested in a hole are filled with it.
    """
    mask = F.coalesce(F.col(column), F.lit(0)) > 0
    empty = pixels.filter(~mask).select(image, "y", "x", F.lit(1).cast("bigint").alias("_v"))
    rest = region_rows(empty, "_v", image, False, side)
    edge = pixels.groupBy(image).agg(
        F.min("y").alias("_y0"), F.max("y").alias("_y1"), F.min("x").alias("_x0"), F.max("x").alias("_x1")
    )
    reach = rest.groupBy(image, "root").agg(
        F.min("top").alias("_top"), F.max("end").alias("_end"), F.min("left").alias("_left"), F.max("right").alias("_right")
    )
    on_edge = (
        (F.col("_top") == F.col("_y0"))
        | (F.col("_end") == F.col("_y1"))
        | (F.col("_left") == F.col("_x0"))
        | (F.col("_right") == F.col("_x1"))
    )
    opened = reach.join(edge.hint("merge"), image).filter(on_edge).select(image, "root")
    holes = rest.join(opened.hint("merge"), [image, "root"], "left_anti")
    holes = holes.select(image, F.explode("points").alias("_p")).select(image, *pixel_at("_p"))
    return pixels.filter(mask).select(image, "y", "x").unionByName(holes)


def contour_areas(regions: DataFrame, image: str = "image_id", side: int = SIDE) -> DataFrame:
    """(image, root, area) of the contours of hole-free regions (image, y, x, root).

    Tiles return one number per region, so a region's size bounds no task.  Single
    pixels and lines have area 0, as their contours enclose nothing.
    """

    def work(stack: Stack) -> tuple[np.ndarray, dict]:
        root = stack.grid("root", -1)
        here = stack.core(root)
        own = np.flatnonzero(here >= 0)
        tile, name = own // here[0].size, here.ravel()[own]
        order = np.lexsort((name, tile))
        own, tile, name = own[order], tile[order], name[order]
        starts = np.flatnonzero((np.diff(tile, prepend=-1) != 0) | (np.diff(name, prepend=-1) != 0))
        twice = twice_areas(stack, root >= 0).ravel()[own]
        return tile[starts], {"root": name[starts], "twice": np.add.reduceat(twice, starts) if len(own) else twice}

    schema = f"{key_type(regions, image)}, root bigint, twice bigint"
    parts = over_stacks(regions, work, schema, ["root"], (0, 1, 1, 1), image, side)
    return parts.groupBy(image, "root").agg((F.sum("twice") / 2).alias("area"))


def component_size_filter(
    pixels: DataFrame,
    column: str,
    smallest: int = 0,
    largest: int = 100000,
    fill_holes: bool = True,
    image: str = "image_id",
    side: int = SIDE,
) -> DataFrame:
    """Pixels (image, y, x) of outermost regions whose contour area lies within the limits.

    The area is that of the outer contour through pixel centres: holes count, the outer
    half of the border pixels doesn't.  Regions inside a hole belong to what surrounds
    them.  With ``fill_holes`` the whole inside is returned, else only pixels of the mask.
    Images are dense; an empty table gives an empty result.
    """
    filled = outside_filled(pixels, column, image, side).withColumn("_v", F.lit(1).cast("bigint"))
    regions = region_rows(filled, "_v", image, True, side, areas=True)
    sized = regions.groupBy(image, "root").agg((F.sum("twice") / 2).alias("area"))
    kept = sized.filter(F.col("area").between(smallest, largest)).select(image, "root")
    inside = regions.join(kept.hint("merge"), [image, "root"], "left_semi")
    inside = inside.select(image, F.explode("points").alias("_p")).select(image, *pixel_at("_p"))
    if fill_holes:
        return inside
    return pixels.filter(F.col(column) > 0).select(image, "y", "x").join(inside.hint("merge"), [image, "y", "x"], "left_semi")


def _ranked(before: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and distance from it for each step of a tile, given the step before (-1: none).

    Closed chains start at their smallest name.
    """
    n = len(before)
    at = np.arange(n)
    up = np.where(before < 0, at, before)
    low = names.copy()
    for _ in range(n.bit_length() + 1):
        low, up = np.minimum(low, low[up]), up[up]
    closed = before[up] >= 0
    up = np.where((before < 0) | (closed & (low == names)), at, before)
    far = (up != at).astype(np.int64)
    while not np.array_equal(up[up], up):
        far, up = far + far[up], up[up]
    return up, far


def _chains(labels: DataFrame, column: str, image: str, side: int) -> DataFrame:
    """Steps along all borders, a row per chain in a tile: (image, column, chain, steps, link, turn).

    A step is named by its pixel and the direction it leaves in, a chain by its first step;
    ``steps`` are in order.  ``link`` names the step of another tile before the first one,
    ``turn`` is the sum of the cross products of the points and those that follow them.
    """

    def work(stack: Stack) -> tuple[np.ndarray, dict]:
        grid = stack.grid(column, 0)
        here = stack.core(grid)
        same = np.stack([stack.core(grid, dy, dx) == here for dy, dx in RING])
        alone = ~same.any(0)
        found = []
        for empty in (0, 2, 4, 6):
            tile, rows, cols = np.nonzero((here > 0) & ~same[empty])
            near = same[:, tile, rows, cols]
            # First neighbour of the region after the empty side, and the last one before it.
            leave = (np.argmax(near[[(empty + k) % 8 for k in range(8)]], 0) + empty) % 8
            enter = (empty - np.argmax(near[[(empty - k) % 8 for k in range(8)]], 0)) % 8
            found.append(np.stack([tile, rows, cols, leave, enter]))
        tile, rows, cols, leave, enter = np.concatenate(found, axis=1)
        single = alone[tile, rows, cols]
        leave[single] = 0
        dy, dx = np.array(RING).T
        high, wide = here.shape[1] + 2, here.shape[2] + 2
        code = (((tile * high + rows + 1) * wide + cols + 1) << 3) + leave
        code, first = np.unique(code, return_index=True)
        tile, rows, cols, leave, enter, single = (v[first] for v in (tile, rows, cols, leave, enter, single))
        back = (enter + 4) % 8
        earlier = (((tile * high + rows + 1 + dy[enter]) * wide + cols + 1 + dx[enter]) << 3) + back
        earlier = np.where(single, code, earlier)
        at = np.minimum(np.searchsorted(code, earlier), max(len(code) - 1, 0))
        known = code[at] == earlier if len(code) else np.zeros(0, dtype=bool)
        start, far = _ranked(np.where(known, at, -1), code)
        y, x = stack.place(tile, rows, cols)
        name = ((y * ROW + x) << 4) + leave
        link = (((y + dy[enter]) * ROW + x + dx[enter]) << 4) + back
        cross = np.where(single, 0, x * dy[leave] - y * dx[leave])
        order = np.lexsort((far, start))
        starts = np.flatnonzero(np.diff(start[order], prepend=-1))
        chain = start[order][starts]
        return tile[chain], {
            column: here[tile[chain], rows[chain], cols[chain]],
            "chain": name[chain],
            "steps": listed(name[order], starts),
            "link": pa.array(link[chain], mask=known[chain]),
            "turn": np.add.reduceat(cross[order], starts) if len(order) else cross,
        }

    schema = (
        f"{key_type(labels, image)}, {column} bigint, chain bigint, steps array<bigint>, link bigint, turn bigint"
    )
    return over_stacks(labels.filter(F.col(column) > 0), work, schema, [column], (1,) * 4, image, side)


def mask_outlines(
    labels: DataFrame, column: str = "obj", image: str = "image_id", side: int = SIDE
) -> DataFrame:
    """(image, column, part, contour): the outer contours of the regions of each label.

    ``contour`` lists (x, y) of the border pixels in order, once for each time the contour
    passes them, beginning at the first pixel by row; a label in several pieces has several
    rows, told apart by ``part``.  Contours of holes are left out.  Background (0, null) has none.
    """
    chains = cut_lineage(_chains(labels, column, image, side))
    before = chains.filter(F.col("link").isNotNull()).select(image, "chain", F.col("link").alias("step"))
    # The step before a chain leaves its own tile, so it is the last of its chain.
    ends = chains.select(
        image, F.element_at("steps", -1).alias("step"), F.col("chain").alias("up"), F.size("steps").cast("bigint").alias("far")
    )
    joined = cut_lineage(before.join(ends.hint("merge"), [image, "step"]).select(image, "chain", "up", "far"))
    loops = _contract(joined.select(image, F.col("chain").alias("a"), F.col("up").alias("b")), image)
    loops = cut_lineage(
        joined.select(image, "chain")
        .join(loops.withColumnRenamed("region", "chain").hint("merge"), [image, "chain"], "left")
        .select(image, "chain", F.coalesce("root", "chain").alias("loop"))
    )
    first = F.col("chain") == F.col("loop")
    places = cut_lineage(
        joined.join(loops.hint("merge"), [image, "chain"]).select(
            image,
            "chain",
            "loop",
            F.when(~first, F.col("up")).alias("up"),
            F.when(first, 0).otherwise(F.col("far")).alias("far"),
        )
    )
    while places.filter(F.col("up").isNotNull()).limit(1).count():
        jump = places.select(image, F.col("chain").alias("up"), F.col("up").alias("up2"), F.col("far").alias("far2"))
        further = cut_lineage(
            places.join(jump.hint("merge"), [image, "up"], "left").select(
                image, "chain", "loop", F.col("up2").alias("up"), (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far")
            )
        )
        discard(places)
        places = further
    found = places.select(image, "chain", "loop", "far").hint("merge")
    placed = chains.join(found, [image, "chain"], "left").select(
        image,
        column,
        F.coalesce("loop", "chain").alias("loop"),
        "turn",
        F.struct(F.coalesce("far", F.lit(0)).alias("rank"), "steps").alias("part"),
    )
    rings = placed.groupBy(image, column, "loop").agg(
        F.sum("turn").alias("turn"), F.array_sort(F.collect_list("part")).alias("parts")
    )
    # Inner contours run the other way round their hole.
    turned = rings.filter("turn <= 0").select(image, column, F.flatten("parts.steps").alias("steps"))
    turned = turned.select(image, column, "steps", F.array_min("steps").alias("first"))
    return turned.select(
        image,
        column,
        F.shiftrightunsigned("first", 4).alias("part"),
        F.expr(
            f"""transform(concat(slice(steps, cast(array_position(steps, first) as int), size(steps)),
            slice(steps, 1, cast(array_position(steps, first) as int) - 1)),
            p -> named_struct('x', shiftright(p, 4) & {ROW - 1}L, 'y', shiftright(p, 35)))"""
        ).alias("contour"),
    )
