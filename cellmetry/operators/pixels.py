"""Pixel-table operators made of plain expressions, aggregates and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmetry.functions.solvers import equalising_curve


def channel_blend(
    a: DataFrame, b: DataFrame, value: str = "v", image: str = "image_id"
) -> DataFrame:
    """Half and half of two channels, rounded half to even."""
    left = a.select(image, "y", "x", F.col(value).alias("_a"))
    right = b.select(image, "y", "x", F.col(value).alias("_b"))
    return left.join(right.hint("merge"), [image, "y", "x"]).select(
        image, "y", "x", F.bround(0.5 * F.col("_a") + 0.5 * F.col("_b"), 0).cast("bigint").alias(value)
    )


def apply_mask(
    pixels: DataFrame, mask: DataFrame, column: str, image: str = "image_id"
) -> DataFrame:
    """Zero the pixels that are not in ``mask`` (rows image, y, x)."""
    inside = mask.select(image, "y", "x", F.lit(True).alias("_in"))
    return (
        pixels.join(inside.hint("merge"), [image, "y", "x"], "left")
        .withColumn(column, F.when(F.col("_in"), F.col(column)).otherwise(F.lit(0)))
        .drop("_in")
    )


def object_ids(pixels: DataFrame, obj: str = "obj", image: str = "image_id") -> DataFrame:
    """Distinct non-zero labels per image."""
    return pixels.filter(F.col(obj) > 0).select(image, obj).distinct()


def object_pixel_counts(pixels: DataFrame, obj: str = "obj", image: str = "image_id") -> DataFrame:
    """Pixels inside and outside of each object.

    Objects are counted first, so the join to the image totals is over objects.
    """
    inside = pixels.groupBy(image, obj).agg(F.count("*").alias("n_inside"))
    total = inside.groupBy(image).agg(F.sum("n_inside").alias("_total"))
    return (
        inside.filter(F.col(obj) > 0)
        .join(total, image)
        .select(image, obj, "n_inside", (F.col("_total") - F.col("n_inside")).alias("n_outside"))
    )


def remove_small_objects(
    pixels: DataFrame, least: int = 64, obj: str = "obj", image: str = "image_id"
) -> DataFrame:
    """Set labels with fewer than ``least`` pixels to background.

    Background pixels, one giant key, take no part in the join.
    """
    small = (
        pixels.filter(F.col(obj) > 0)
        .groupBy(image, obj)
        .agg(F.count("*").alias("_n"))
        .filter(F.col("_n") < least)
        .select(image, obj, F.lit(True).alias("_small"))
    )
    marked = pixels.filter(F.col(obj) > 0).join(small, [image, obj], "left")
    cleaned = marked.withColumn(
        obj, F.when(F.col("_small"), F.lit(0)).otherwise(F.col(obj)).cast("bigint")
    ).drop("_small")
    return pixels.filter(F.col(obj) <= 0).unionByName(cleaned)


def threshold_mask(value: Column, lower: int = 30, upper: int = 255) -> Column:
    """255 from the lower to the upper level, else 0 (with lower 0, dropped levels pass too)."""
    dropped = F.when(value > upper, F.lit(0)).otherwise(value)
    return F.when(dropped >= lower, F.lit(255)).otherwise(F.lit(0)).cast("bigint")


def _with_image_stats(pixels: DataFrame, stats: list[Column], image: str) -> DataFrame:
    """Per-image aggregates joined back.

    The aggregate combines before its shuffle and leaves one row per image; Spark
    broadcasts it while it is small and otherwise splits a hot image (skew join).  The
    pixels, whose size Spark cannot estimate, are the outer side and never broadcast.
    """
    known = F.col(image).isNotNull()
    return pixels.filter(known).join(pixels.groupBy(image).agg(*stats), image, "left")


def zscore_rescale(
    pixels: DataFrame, column: str = "grayscale", image: str = "image_id"
) -> DataFrame:
    """Standardise, stretch to 0..255 and truncate.

    The smallest and largest z follow from the extreme levels, so one aggregate is
    enough.  Mean and variance come from whole-number sums.
    """
    v = F.col(column).cast("bigint")
    joined = _with_image_stats(
        pixels,
        [
            F.count(v).cast("double").alias("_n"),
            F.sum(v).cast("double").alias("_s"),
            F.sum(v * v).cast("double").alias("_ss"),
            F.min(v).cast("double").alias("_low"),
            F.max(v).cast("double").alias("_high"),
        ],
        image,
    )
    mean = F.col("_s") / F.col("_n")
    variance = (F.col("_n") * F.col("_ss") - F.col("_s") * F.col("_s")) / (
        F.col("_n") * F.col("_n")
    )
    spread = F.sqrt(variance) + 1e-6
    z, low, high = ((c - mean) / spread for c in (F.col(column), F.col("_low"), F.col("_high")))
    scaled = 255.0 * (z - low) / (high - low + 1e-6)
    return joined.withColumn(column, F.floor(scaled).cast("bigint")).drop(
        "_n", "_s", "_ss", "_low", "_high"
    )


def minmax_image(
    pixels: DataFrame, columns: list[str], image: str = "image_id"
) -> DataFrame:
    """(v - min) / (max - min + 1e-6) per image and column."""
    stats = [f(c).cast("double").alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]
    joined = _with_image_stats(pixels, stats, image)
    return joined.withColumns(
        {
            c: (F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}") + 1e-6)
            for c in columns
        }
    ).drop(*[f"_{n}_{c}" for c in columns for n in ("lo", "hi")])


def channel_adjust(
    pixels: DataFrame, channels: list[str], wanted: int, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Bring a pixel to ``wanted`` channels (c0, c1, ...).

    One channel is repeated; two become three by repeating the first; otherwise
    the list is cut.  More channels than there are is an error.
    """
    if len(channels) == 1 and wanted > 1:
        source = channels * wanted
    elif len(channels) == 2 and wanted == 3:
        source = [*channels, channels[0]]
    else:
        source = channels
    if len(source) < wanted:
        raise ValueError(f"cannot make {wanted} channels from {len(channels)}")
    return pixels.select(*keep, *[F.col(c).alias(f"c{k}") for k, c in enumerate(source[:wanted])])


def image_sizes(pixels: DataFrame, image: str = "image_id") -> DataFrame:
    return pixels.groupBy(image).agg(
        (F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width")
    )


def resize_bilinear(
    pixels: DataFrame,
    size: tuple[int, int],
    column: str = "grayscale",
    image: str = "image_id",
) -> DataFrame:
    """Resize dense images to (height, width), half-pixel centres, no antialiasing.

    Each source pixel names the targets it touches (those whose sampling point is
    less than one pixel away), so no neighbour join is needed; contributions are
    summed before the shuffle.
    """

    def reach(axis: str, length: str, count: int) -> Column:
        scale = F.col(length).cast("double") / F.lit(float(count))
        low = F.floor((F.col(axis) - 0.5) / scale - 0.5)
        high = F.ceil((F.col(axis) + 1.5) / scale - 0.5)
        return F.explode(
            F.sequence(F.greatest(low, F.lit(0)), F.least(high, F.lit(count - 1)))
        )

    def weight(target: str, axis: str, length: str, count: int) -> Column:
        size_ = F.col(length).cast("double")
        at = (F.col(target) + 0.5) * (size_ / F.lit(float(count))) - 0.5
        return 1.0 - F.abs(F.least(F.greatest(at, F.lit(0.0)), size_ - 1.0) - F.col(axis))

    sized = pixels.select(image, "y", "x", F.col(column).alias("_v")).join(
        image_sizes(pixels, image).hint("merge"), image
    )
    rows = (
        sized.withColumn("_ty", reach("y", "height", size[0]))
        .withColumn("_wy", weight("_ty", "y", "height", size[0]))
        .filter(F.col("_wy") > 0)
    )
    both = (
        rows.withColumn("_tx", reach("x", "width", size[1]))
        .withColumn("_wx", weight("_tx", "x", "width", size[1]))
        .filter(F.col("_wx") > 0)
    )
    return both.groupBy(image, F.col("_ty").alias("y"), F.col("_tx").alias("x")).agg(
        F.sum(F.col("_wy") * F.col("_wx") * F.col("_v")).alias(column)
    )


def clahe(
    pixels: DataFrame,
    column: str = "grayscale",
    clip_limit: int = 2,
    tiles: int = 8,
    image: str = "image_id",
) -> DataFrame:
    """Contrast-limited equalisation on a grid of tiles.

    Each tile's level counts give its curve, and a pixel blends the curves of its four
    nearest tiles.  Curves travel packed by the cell between four tile centres, so the
    pixel table is joined once and an image spreads over many keys.  Where a side is no
    multiple of ``tiles``, both sides are lengthened to the next one (a whole ``tiles``
    if they are multiples already), mirrored about the last line: pixels near the end count
    once more for each mirrored place, and no padded pixel is made.
    """
    sides = image_sizes(pixels, image)
    uneven = (F.col("height") % tiles != 0) | (F.col("width") % tiles != 0)
    for side in ("height", "width"):
        sides = sides.withColumn(f"_{side}", F.when(uneven, tiles - F.col(side) % tiles).otherwise(0))
    sized = pixels.join(sides.hint("merge"), image)
    high = (F.col("height") + F.col("_height")) / tiles
    wide = (F.col("width") + F.col("_width")) / tiles

    def places(axis: str, side: str, tile: Column) -> Column:
        """Grid lines of a pixel and of its mirrored places."""
        length, more, at = F.col(side), F.col(f"_{side}"), F.col(axis)
        period = F.greatest(2 * (length - 1), F.lit(1))
        turned = lambda t: length - 1 - F.abs(t % period - length + 1)
        added = F.filter(F.sequence(length, length + more - 1), lambda t: turned(t) == at)
        near = (more > 0) & (at >= length - 1 - more)
        lines = F.when(near, F.concat(F.array(at), added)).otherwise(F.array(at))
        return F.transform(lines, lambda t: F.floor(t / tile))

    rows = sized.withColumn("_ty", F.explode(places("y", "height", high)))
    seen = (
        rows.withColumn("_tx", F.explode(places("x", "width", wide)))
        .groupBy(image, "_ty", "_tx", F.col(column).alias("_v"))
        .agg(F.count("*").alias("_n"), F.first(high * wide).alias("_area"))
    )
    # one row per tile: at most 256 (level, count) entries
    packed = seen.groupBy(image, "_ty", "_tx").agg(
        F.collect_list(F.struct("_v", "_n")).alias("_h"), F.first("_area").alias("_area")
    )
    curves = packed.select(
        image,
        "_ty",
        "_tx",
        equalising_curve(
            F.col("_h._v"), F.col("_h._n"), F.col("_area"), F.lit(clip_limit)
        ).alias("_curve"),
    )
    # a tile serves the cells (ty, ty+1) x (tx, tx+1); edge tiles also the outer cells
    last = tiles - 1

    def cells(tile: Column) -> Column:
        below = F.struct((tile + 1).alias("cell"), F.lit(0).alias("side"))
        above = F.struct(tile.alias("cell"), F.lit(1).alias("side"))
        first = F.struct(F.lit(0).cast("bigint").alias("cell"), F.lit(0).alias("side"))
        end = F.struct(F.lit(tiles).cast("bigint").alias("cell"), F.lit(1).alias("side"))
        return F.filter(
            F.array(below, above, F.when(tile == 0, first), F.when(tile == last, end)),
            lambda c: c.isNotNull(),
        )

    corner = curves.withColumn("_cy", F.explode(cells(F.col("_ty")))).withColumn(
        "_cx", F.explode(cells(F.col("_tx")))
    )
    blocks = corner.groupBy(
        image, F.col("_cy.cell").alias("_cell_y"), F.col("_cx.cell").alias("_cell_x")
    ).agg(
        *[
            F.max(
                F.when((F.col("_cy.side") == a) & (F.col("_cx.side") == b), F.col("_curve"))
            ).alias(f"_c{a}{b}")
            for a in (0, 1)
            for b in (0, 1)
        ]
    )
    at_y, at_x = F.col("y") / high - 0.5, F.col("x") / wide - 0.5
    placed = sized.select(
        image,
        "y",
        "x",
        F.col(column).cast("int").alias("_v"),
        (F.floor(at_y) + 1).alias("_cell_y"),
        (F.floor(at_x) + 1).alias("_cell_x"),
        (at_y - F.floor(at_y)).alias("_fy"),
        (at_x - F.floor(at_x)).alias("_fx"),
    )
    joined = placed.join(blocks.hint("merge"), [image, "_cell_y", "_cell_x"])

    def curve(a: int, b: int) -> Column:
        return F.get(F.col(f"_c{a}{b}"), F.col("_v"))

    fy, fx = F.col("_fy"), F.col("_fx")
    upper = curve(0, 0) * (1.0 - fx) + curve(0, 1) * fx
    lower = curve(1, 0) * (1.0 - fx) + curve(1, 1) * fx
    return joined.select(
        image, "y", "x", F.bround(upper * (1.0 - fy) + lower * fy, 0).cast("bigint").alias(column)
    )


def crop_window_size(boxes: DataFrame) -> DataFrame:
    """Largest short side and largest long side over all bounding boxes (w, h)."""
    return boxes.agg(
        F.max(F.least("w", "h")).alias("max_width"), F.max(F.greatest("w", "h")).alias("max_height")
    )


def object_crop(
    object_pixels: DataFrame,
    windows: DataFrame,
    sizes: DataFrame,
    limits: DataFrame,
    image: str = "image_id",
    key: str = "obj",
) -> DataFrame:
    """Crop of each object in local coordinates, only its own pixels, zeros left out.

    ``object_pixels`` (image, key, y, x, v) is the filled object, ``windows``
    (image, key, cx, cy, w, h) its centre and box, ``sizes`` (image, height, width), and
    ``limits`` the one row of ``crop_window_size`` over all boxes, read as a scalar
    subquery.  With the centre of the box no pixel of an object is cut.  A wide object takes a turned window and is rotated 90 degrees clockwise.  The
    window is cut at the image border and the rest is padded evenly.
    """
    turned = F.col("w") > F.col("h")
    max_width = limits.select("max_width").scalar()
    max_height = limits.select("max_height").scalar()
    span_x = F.when(turned, max_height).otherwise(max_width)
    span_y = F.when(turned, max_width).otherwise(max_height)

    def low(centre: Column, span: Column) -> Column:
        edge = centre.cast("double") - span / 2.0
        return F.greatest(F.when(edge < 0, F.ceil(edge)).otherwise(F.floor(edge)), F.lit(0))

    def high(centre: Column, span: Column, limit: Column) -> Column:
        edge = centre.cast("double") + span / 2.0
        return F.least(F.when(edge < 0, F.ceil(edge)).otherwise(F.floor(edge)), limit)

    framed = windows.join(sizes.hint("merge"), image).select(
        image,
        key,
        turned.alias("_turned"),
        low(F.col("cx"), span_x).alias("_x1"),
        high(F.col("cx"), span_x, F.col("width")).alias("_x2"),
        low(F.col("cy"), span_y).alias("_y1"),
        high(F.col("cy"), span_y, F.col("height")).alias("_y2"),
        span_x.cast("bigint").alias("_span_x"),
        span_y.cast("bigint").alias("_span_y"),
    )

    def pad(span: str, a: str, b: str) -> Column:
        return F.floor(F.greatest(F.col(span) - (F.col(b) - F.col(a)), F.lit(0)) / 2)

    joined = object_pixels.join(framed.hint("merge"), [image, key]).filter(
        (F.col("y") >= F.col("_y1"))
        & (F.col("y") < F.col("_y2"))
        & (F.col("x") >= F.col("_x1"))
        & (F.col("x") < F.col("_x2"))
    )
    local_y = F.col("y") - F.col("_y1") + pad("_span_y", "_y1", "_y2")
    local_x = F.col("x") - F.col("_x1") + pad("_span_x", "_x1", "_x2")
    height = F.greatest(F.col("_span_y"), F.col("_y2") - F.col("_y1"))
    return joined.select(
        image,
        key,
        F.when(F.col("_turned"), local_x).otherwise(local_y).cast("bigint").alias("crop_y"),
        F.when(F.col("_turned"), height - 1 - local_y)
        .otherwise(local_x)
        .cast("bigint")
        .alias("crop_x"),
        "v",
    ).filter(F.col("v") != 0)
