"""Neighbourhood operators on pixel tables.

A pixel table is shuffled once into square tiles.  Each tile also receives the
margin of pixels its neighbourhood reaches into, so a tile is complete on its own
and its size is bounded by (side + margins) squared, whatever the image size.
Inside a tile the work is array arithmetic.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from cellmetry.session import cut_lineage

SIDE = 256
#: Pixels a task takes where their number is known; one pixel can make some 64 counts.
TASK_PIXELS = 1 << 16
#: Rows read before tiles are stacked, and cells of a stack.
STACK_ROWS = 1 << 17
STACK_CELLS = 1 << 20
RING = [(0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1)]


class Tile:
    """Dense arrays of one tile with its margin, cut to the pixels it holds."""

    def __init__(self, pdf: pd.DataFrame, side: int, margin: tuple[int, int, int, int]):
        self.up, down, self.left, right = margin
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        own = (y // side == pdf["_ty"].iat[0]) & (x // side == pdf["_tx"].iat[0])
        self.empty = not own.any()
        if self.empty:
            return
        self.top, self.first = int(y[own].min()), int(x[own].min())
        self.height = int(y[own].max()) - self.top + 1
        self.width = int(x[own].max()) - self.first + 1
        self.shape = (self.height + self.up + down, self.width + self.left + right)
        rows, cols = y - self.top + self.up, x - self.first + self.left
        self.near = (rows >= 0) & (rows < self.shape[0]) & (cols >= 0) & (cols < self.shape[1])
        self.rows, self.cols = rows[self.near], cols[self.near]
        self.pdf = pdf
        self.present = np.zeros(self.shape, dtype=bool)
        self.present[self.rows, self.cols] = True
        self.core_rows, self.core_cols = np.nonzero(self.core(self.present))

    def grid(self, column: str, fill: int) -> np.ndarray:
        out = np.full(self.shape, fill, dtype=np.int64)
        out[self.rows, self.cols] = self.pdf[column].to_numpy()[self.near]
        return out

    def core(self, values: np.ndarray, dy: int = 0, dx: int = 0) -> np.ndarray:
        """The tile proper, read at an offset within the margin."""
        top, first = self.up + dy, self.left + dx
        return values[top : top + self.height, first : first + self.width]

    def mark(self, above: pd.DataFrame) -> None:
        """Keep the marks that lie on pixels of the tile proper."""
        rows = above["y"].to_numpy() - self.top
        cols = above["x"].to_numpy() - self.first
        inside = (rows >= 0) & (rows < self.height) & (cols >= 0) & (cols < self.width)
        rows, cols = rows[inside], cols[inside]
        here = self.core(self.present)[rows, cols]
        numbers = above["_mark"].to_numpy().astype(np.int64)[inside]
        self.marks = (rows[here], cols[here], numbers[here])

    def rows_out(self, keys: dict, **values: np.ndarray) -> pd.DataFrame:
        """One row per present core pixel."""
        at = (self.core_rows, self.core_cols)
        data = {k: np.full(len(at[0]), v) for k, v in keys.items()}
        data["y"] = at[0] + self.top
        data["x"] = at[1] + self.first
        data.update({k: v[at] for k, v in values.items()})
        return pd.DataFrame(data)


def key_type(pixels: DataFrame, image: str) -> str:
    """The image key with its type, for the schema of what tiles return."""
    return f"{image} {pixels.schema[image].dataType.simpleString()}"


def by_task(df: DataFrame, *keys: str, pixels: int = 0) -> DataFrame:
    """Hash partitions of a fixed number, one per ``TASK_PIXELS`` of the pixels if these are more.

    The cost of a group lies in the array work, not in its bytes, so the partitions
    must not be merged by size.  The grouping that follows needs no second shuffle.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(tasks, -(-pixels // TASK_PIXELS)), *keys)


def _in_tiles(
    pixels: DataFrame, columns: list[str], margin: tuple[int, int, int, int], image: str, side: int
) -> DataFrame:
    """The pixels with the tile (_ty, _tx) they are needed in, once for each."""
    for c in columns:
        if not isinstance(pixels.schema[c].dataType, IntegralType):
            raise TypeError(f"column {c} must hold whole numbers")
    up, down, left, right = margin

    def tiles(axis: str, before: int, after: int) -> Column:
        last = F.floor((F.col(axis) + before) / F.lit(side))
        if not before and not after:
            return last
        low = F.greatest(F.floor((F.col(axis) - after) / F.lit(side)), F.lit(0))
        return F.explode(F.sequence(low, last))

    rows = pixels.select(image, "y", "x", *columns)
    return rows.withColumn("_ty", tiles("y", up, down)).withColumn("_tx", tiles("x", left, right))


class Stack:
    """Dense arrays (tile, row, column) of many tiles with their margins, cut to what they hold.

    ``ty`` and ``tx`` place the tiles; a cell of the tile proper is (tile, y - ty * side, x - tx * side).
    """

    def __init__(self, data: dict[str, np.ndarray], side: int, margin: tuple[int, int, int, int]):
        self.up, down, self.left, right = margin
        self.side, self.data, self.tile = side, data, data["tile"]
        first = np.searchsorted(self.tile, np.arange(self.tile[-1] + 1))
        self.ty, self.tx = data["_ty"][first], data["_tx"][first]
        self.rows = data["y"] - data["_ty"] * side + self.up
        self.cols = data["x"] - data["_tx"] * side + self.left
        self.shape = (len(first), int(self.rows.max()) + 1 + down, int(self.cols.max()) + 1 + right)
        self.height, self.width = self.shape[1] - self.up - down, self.shape[2] - self.left - right
        self.present = np.zeros(self.shape, dtype=bool)
        self.present[self.tile, self.rows, self.cols] = True

    def grid(self, column: str, fill: int) -> np.ndarray:
        out = np.full(self.shape, fill, dtype=np.int64)
        out[self.tile, self.rows, self.cols] = self.data[column]
        return out

    def core(self, values: np.ndarray, dy: int = 0, dx: int = 0) -> np.ndarray:
        """The tiles proper, read at an offset within the margin."""
        top, first = self.up + dy, self.left + dx
        core = values[:, top : min(top + self.side, top + self.height), :]
        return core[:, :, first : min(first + self.side, first + self.width)]

    def place(self, tile: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(y, x) of cells of the tiles proper."""
        return rows + self.ty[tile] * self.side, cols + self.tx[tile] * self.side


def listed(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    """Lists of the values, each from one start to the next."""
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), pa.array(values))


def over_stacks(
    pixels: DataFrame,
    work: Callable[[Stack], tuple[np.ndarray, dict]],
    schema: str,
    columns: list[str],
    margin: tuple[int, int, int, int],
    image: str = "image_id",
    side: int = SIDE,
) -> DataFrame:
    """Run ``work`` on stacks of many whole tiles, so that small tiles cost what their pixels do.

    ``margin`` is as in ``over_tiles``.  ``work`` returns the tile of each row and the columns of
    the schema after the image.
    """

    def stacked(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        data = {c: rows.column(c).to_numpy() for c in ("y", "x", "_ty", "_tx", *columns)}
        ends = np.append(starts[1:], rows.num_rows)
        high = int((data["y"] - data["_ty"] * side).max()) + 1 + margin[0] + margin[1]
        wide = int((data["x"] - data["_tx"] * side).max()) + 1 + margin[2] + margin[3]
        many = max(1, STACK_CELLS // (high * wide))
        for k in range(0, len(starts), many):
            at = slice(starts[k], ends[min(k + many, len(starts)) - 1])
            sizes = ends[k : k + many] - starts[k : k + many]
            part = {c: v[at] for c, v in data.items()}
            tile, out = work(Stack({**part, "tile": np.repeat(np.arange(len(sizes)), sizes)}, side, margin))
            names = rows.column(image).take(pa.array(starts[k : k + many][tile])).combine_chunks()
            yield pa.RecordBatch.from_arrays([names, *map(_as_arrow, out.values())], names=[image, *out])

    def tile_starts(rows: pa.Table) -> np.ndarray:
        codes = rows.column(image).combine_chunks().dictionary_encode().indices.fill_null(-1)
        new = np.ones(rows.num_rows, dtype=bool)
        new[1:] = np.diff(codes.to_numpy(zero_copy_only=False)) != 0
        for c in ("_ty", "_tx"):
            new[1:] |= np.diff(rows.column(c).to_numpy()) != 0
        return np.flatnonzero(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= STACK_ROWS:
                rows = pa.Table.from_batches(held).combine_chunks()
                starts = tile_starts(rows)
                if len(starts) > 1:  # the last tile may go on in the next batch
                    yield from stacked(rows.slice(0, starts[-1]), starts[:-1])
                    rows = rows.slice(starts[-1])
                held, count = rows.to_batches(), rows.num_rows
        if count:
            rows = pa.Table.from_batches(held).combine_chunks()
            yield from stacked(rows, tile_starts(rows))

    placed = by_task(_in_tiles(pixels, columns, margin, image, side), image, "_ty", "_tx")
    return placed.sortWithinPartitions(image, "_ty", "_tx").mapInArrow(run, schema)


def _as_arrow(values: np.ndarray | pa.Array) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values)


def over_tiles(
    pixels: DataFrame,
    work: Callable[[Tile, dict], pd.DataFrame],
    schema: str,
    columns: list[str],
    margin: tuple[int, int, int, int],
    image: str = "image_id",
    side: int = SIDE,
    marks: DataFrame | None = None,
    counted: int = 0,
) -> DataFrame:
    """Run ``work`` on every tile; ``margin`` is (up, down, left, right).

    ``counted`` is the number of pixels, if it is known.
    ``marks`` (image, y, x, mark) are further numbers on pixels, several on one if need
    be; those of a tile are in ``tile.marks`` as rows, columns and numbers.
    """
    placed = _in_tiles(pixels, columns, margin, image, side)

    if marks is not None:
        placed = placed.withColumn("_mark", F.lit(None).cast("bigint")).unionByName(
            marks.select(
                image,
                "y",
                "x",
                F.col("mark").cast("bigint").alias("_mark"),
                F.floor(F.col("y") / F.lit(side)).alias("_ty"),
                F.floor(F.col("x") / F.lit(side)).alias("_tx"),
            ),
            allowMissingColumns=True,
        )
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    marked = marks is not None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        above = pdf[pdf["_mark"].notna()] if marked else None
        if marked:
            pdf = pdf[pdf["_mark"].isna()].astype({c: "int64" for c in columns})
        tile = Tile(pdf, side, margin) if len(pdf) else None
        if tile is None or tile.empty:
            return pd.DataFrame(columns=names)
        if marked:
            tile.mark(above)
        return work(tile, {image: pdf[image].iat[0]})

    tasks = by_task(placed, image, "_ty", "_tx", pixels=counted)
    return tasks.groupBy(image, "_ty", "_tx").applyInPandas(run, schema)


def gaussian_weights(size: int, sigma: float) -> list[int]:
    """Symmetric weights in 256ths; rounding errors go on to the next weight, the rest to the middle."""
    raw = [math.exp(-((k - size // 2) ** 2) / (2 * sigma * sigma)) for k in range(size)]
    half, over = [], 0.0
    for w in raw[: size // 2]:
        exact = 256 * w / sum(raw) + over
        half.append(round(exact))
        over = exact - half[-1]
    return [*half, 256 - 2 * sum(half), *reversed(half)]


def _mirror(present: np.ndarray) -> np.ndarray:
    """Index along one axis with missing ends mirrored about the last present line."""
    low, high = np.flatnonzero(present)[[0, -1]]
    at = np.arange(len(present))
    at = np.where(at < low, 2 * low - at, at)
    at = np.where(at > high, 2 * high - at, at)
    return np.clip(at, low, high)


def gaussian_blur(
    pixels: DataFrame,
    column: str = "grayscale",
    size: int = 5,
    sigma: float = 4.0,
    image: str = "image_id",
    side: int = SIDE,
) -> DataFrame:
    """Separable blur of a dense image with mirrored borders.

    Weights have eight binary digits and both passes are whole numbers, so results do not
    depend on a machine's rounding; the last step rounds halves up.  ``size`` is odd.
    """
    weights, reach = gaussian_weights(size, sigma), size // 2

    def work(tile: Tile, keys: dict) -> pd.DataFrame:
        v = tile.grid(column, 0)
        v = v[_mirror(tile.present.any(1))][:, _mirror(tile.present.any(0))]
        across = sum(
            w * v[:, reach + k : v.shape[1] - reach + k]
            for w, k in zip(weights, range(-reach, reach + 1))
        )
        both = sum(
            w * across[reach + k : v.shape[0] - reach + k]
            for w, k in zip(weights, range(-reach, reach + 1))
        )
        return tile.rows_out(keys, **{column: (both + (1 << 15)) >> 16})

    schema = f"{key_type(pixels, image)}, y bigint, x bigint, {column} bigint"
    return over_tiles(pixels, work, schema, [column], (reach,) * 4, image, side)


def _extreme(values: np.ndarray, pick) -> np.ndarray:
    """3 x 3 maximum or minimum; the outermost lines are not meaningful."""
    out = values.copy()
    h, w = values.shape
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            out[1 : h - 1, 1 : w - 1] = pick(
                out[1 : h - 1, 1 : w - 1], values[1 + dy : h - 1 + dy, 1 + dx : w - 1 + dx]
            )
    return out


def grey_close_3x3(
    pixels: DataFrame, column: str = "obj", image: str = "image_id", side: int = SIDE
) -> DataFrame:
    """Dilation, then erosion, with a 3 x 3 square; what lies off the image is ignored."""

    def work(tile: Tile, keys: dict) -> pd.DataFrame:
        wide = _extreme(tile.grid(column, np.iinfo(np.int64).min), np.maximum)
        wide[~tile.present] = np.iinfo(np.int64).max
        return tile.rows_out(keys, **{column: tile.core(_extreme(wide, np.minimum))})

    schema = f"{key_type(pixels, image)}, y bigint, x bigint, {column} bigint"
    return over_tiles(pixels, work, schema, [column], (2, 2, 2, 2), image, side)


def boundary_pixels(
    pixels: DataFrame, obj: str = "obj", image: str = "image_id", side: int = SIDE
) -> DataFrame:
    """Object pixels with at least one of eight neighbours outside the object."""

    def work(tile: Tile, keys: dict) -> pd.DataFrame:
        labels = tile.grid(obj, 0)
        here = tile.core(labels)
        same = sum((tile.core(labels, dy, dx) == here).astype(int) for dy, dx in RING)
        out = tile.rows_out(keys, **{obj: here, "_same": same})
        return out[(out["_same"] < 8) & (out[obj] > 0)].drop(columns="_same")

    schema = f"{key_type(pixels, image)}, y bigint, x bigint, {obj} bigint"
    return over_tiles(pixels.filter(F.col(obj) > 0), work, schema, [obj], (1,) * 4, image, side)


# Sampling position of the diagonal neighbours (5 decimals), scaled.
_NEAR, _FAR, _UNIT = 29289, 70711, 100000


def _pattern_bits(tile: Tile, values: np.ndarray) -> list[np.ndarray]:
    """Neighbour >= centre around the unit circle; diagonals are interpolated exactly."""
    here = tile.core(values)
    bits = []
    for dy, dx in RING:
        if dy == 0 or dx == 0:
            bits.append(tile.core(values, dy, dx) >= here)
        else:
            mixed = (
                _FAR * _FAR * tile.core(values, dy, dx)
                + _FAR * _NEAR * (tile.core(values, dy, 0) + tile.core(values, 0, dx))
                + _NEAR * _NEAR * here
            )
            bits.append(mixed >= _UNIT * _UNIT * here)
    return bits


def _uniform_code(bits: list[np.ndarray]) -> np.ndarray:
    """Number of ones when the circle changes at most twice, else 9."""
    changes = sum((bits[k] != bits[k - 1]).astype(np.int64) for k in range(8))
    ones = sum(b.astype(np.int64) for b in bits)
    return np.where(changes <= 2, ones, 9)


def lbp_codes(
    pixels: DataFrame,
    channels: list[str],
    obj: str = "obj",
    image: str = "image_id",
    side: int = SIDE,
) -> DataFrame:
    """Uniform binary pattern code (8 points, radius 1) of every pixel and channel."""

    def work(tile: Tile, keys: dict) -> pd.DataFrame:
        codes = {c: _uniform_code(_pattern_bits(tile, tile.grid(c, 0))) for c in channels}
        return tile.rows_out(keys, **{obj: tile.core(tile.grid(obj, 0))}, **codes)

    schema = f"{key_type(pixels, image)}, y bigint, x bigint, {obj} bigint, " + ", ".join(
        f"{c} bigint" for c in channels
    )
    return over_tiles(pixels, work, schema, [obj, *channels], (1,) * 4, image, side)


def _lbp_parts(tile: Tile, channels: list[str], obj: str, filled: bool) -> list[tuple]:
    """(object, channel * 10 + code, n): codes of labels, or of marks and of the whole tile as 0."""
    at = (tile.core_rows, tile.core_cols)
    if filled:
        rows, cols, marks = tile.marks
        at = tuple(np.concatenate(p) for p in zip(at, (rows, cols)))
        owner = np.concatenate([np.zeros(len(tile.core_rows), np.int64), marks])
    else:
        owner = tile.core(tile.grid(obj, 0))[at]
    ids, place = np.unique(owner, return_inverse=True)
    parts = []
    for number, c in enumerate(channels):
        code = _uniform_code(_pattern_bits(tile, tile.grid(c, 0)))[at]
        n = np.bincount(place * 10 + code, minlength=len(ids) * 10)
        hit = np.flatnonzero(n)
        parts.append((ids[hit // 10], number * 10 + hit % 10, n[hit]))
    return parts


def _merged(tile_rows: DataFrame, image: str, obj: str, pixels: int) -> DataFrame:
    """(image, object, cell, n) of the packed counts of tiles.

    Counts are shuffled packed and opened after it.  What follows by image and object
    finds them together and needs no further shuffle.
    """
    entry = F.explode(F.arrays_zip("cells", "ns")).alias("_e")
    opened = by_task(tile_rows, image, obj, pixels=pixels).select(image, obj, entry)
    return opened.groupBy(image, obj, F.col("_e.cells").alias("cell")).agg(F.sum("_e.ns").alias("n"))


def _packed_schema(pixels: DataFrame, image: str, obj: str) -> str:
    return f"{key_type(pixels, image)}, {obj} bigint, cells array<int>, ns array<int>"


def _packed(parts: list[tuple], keys: dict, obj: str) -> pd.DataFrame:
    """A row (image, object, cells, ns) per object of parts (object, cell, n); n is a tile's at most."""
    if not parts:
        return pd.DataFrame(columns=[*keys, obj, "cells", "ns"])
    owner, cell, n = (np.concatenate(p) for p in zip(*parts))
    order = np.argsort(owner, kind="stable")
    ids, first = np.unique(owner[order], return_index=True)
    cells, ns = (np.split(v[order].astype(np.int32), first[1:]) for v in (cell, n))
    return pd.DataFrame({**{k: [v] * len(ids) for k, v in keys.items()}, obj: ids, "cells": cells, "ns": ns})


def labelled(pixels: DataFrame, obj: str) -> int:
    """The number of labelled pixels."""
    return pixels.filter(F.col(obj) > 0).count()


def _pick(values: list, at: Column) -> Column:
    return F.array(*[F.lit(v) for v in values])[at]


def _lbp_rows(merged: DataFrame, channels: list[str], image: str, obj: str) -> DataFrame:
    return merged.select(
        image,
        obj,
        _pick(channels, F.floor(F.col("cell") / 10).cast("int")).alias("channel"),
        (F.col("cell") % 10).cast("bigint").alias("code"),
        "n",
    )


def lbp_counts(
    pixels: DataFrame,
    channels: list[str],
    obj: str = "obj",
    image: str = "image_id",
    side: int = SIDE,
    filled: DataFrame | None = None,
) -> DataFrame:
    """Pixels per (image, object, channel, code), counted inside the tile.

    With ``filled`` (image, object, y, x), the pixels within each object's outer contour,
    an object counts all of these, holes and other labels included, and object 0 counts
    the whole image; without, an object counts the pixels of its label.
    """
    by_contour = filled is not None
    tile_rows = over_tiles(
        pixels,
        lambda tile, keys: _packed(_lbp_parts(tile, channels, obj, by_contour), keys, obj),
        _packed_schema(pixels, image, obj),
        [obj, *channels],
        (1,) * 4,
        image,
        side,
        filled.withColumnRenamed(obj, "mark") if by_contour else None,
    )
    return _lbp_rows(_merged(tile_rows, image, obj, 0), channels, image, obj)


def rotation_min_codes(
    pixels: DataFrame,
    channel: str = "grayscale",
    obj: str = "obj",
    image: str = "image_id",
    side: int = SIDE,
) -> DataFrame:
    """Smallest rotation of the 8-bit pattern, for pixels whose neighbours share the object."""

    def work(tile: Tile, keys: dict) -> pd.DataFrame:
        labels, values = tile.grid(obj, 0), tile.grid(channel, 0)
        here, centre = tile.core(labels), tile.core(values)
        whole = here > 0
        code = np.zeros(here.shape, dtype=np.int64)
        for dy, dx in RING:
            whole &= tile.core(labels, dy, dx) == here
            code = code * 2 + (tile.core(values, dy, dx) >= centre)
        best = code
        for _ in range(7):
            code = ((code << 1) & 255) | (code >> 7)
            best = np.minimum(best, code)
        out = tile.rows_out(keys, **{obj: here, "code": best, "_whole": whole})
        out = out[out["_whole"]].drop(columns="_whole")
        return out.assign(code=[format(int(v), "08b") for v in out["code"]])

    schema = f"{key_type(pixels, image)}, y bigint, x bigint, {obj} bigint, code string"
    return over_tiles(
        pixels.filter(F.col(obj) > 0), work, schema, [obj, channel], (1,) * 4, image, side
    )


def glcm_offsets(distances: list[int], angles: list[int]) -> list[tuple[int, int, int, int]]:
    """(distance, angle, dy, dx) with rounded steps."""
    return [
        (
            d,
            a,
            int(round(math.sin(math.radians(a)) * d)),
            int(round(math.cos(math.radians(a)) * d)),
        )
        for d in distances
        for a in angles
    ]


def _glcm_margin(offsets: list[tuple]) -> tuple[int, int, int, int]:
    dys, dxs = [o[2] for o in offsets], [o[3] for o in offsets]
    return max(0, -min(dys)), max(0, max(dys)), max(0, -min(dxs)), max(0, max(dxs))


def _glcm_parts(
    tile: Tile, channels: list[str], offsets: list[tuple], levels: int, obj: str
) -> list[tuple]:
    """(object, (channel, offset, i, j) as one number, n)."""
    square = levels * levels
    labels = tile.grid(obj, 0)
    here = tile.core(labels)
    ids, place = np.unique(here, return_inverse=True)
    place = place.reshape(here.shape)
    levels_of = [np.minimum(tile.grid(c, 0) * levels // 256, levels - 1) for c in channels]
    parts = []
    for at, (_, _, dy, dx) in enumerate(offsets):
        pair = (here > 0) & (tile.core(labels, dy, dx) == here)
        if not pair.any():
            continue
        base = place[pair] * square
        for number, q in enumerate(levels_of):
            cell = base + tile.core(q)[pair] * levels + tile.core(q, dy, dx)[pair]
            if len(ids) * square > 8 * len(cell) + 65536:
                hit, n = np.unique(cell, return_counts=True)
            else:
                n = np.bincount(cell)
                hit = np.flatnonzero(n)
                n = n[hit]
            kind = (number * len(offsets) + at) * square
            parts.append((ids[hit // square], kind + hit % square, n))
    return parts


def _glcm_rows(
    merged: DataFrame, channels: list[str], offsets: list[tuple], levels: int, image: str, obj: str
) -> DataFrame:
    kind = F.floor(F.col("cell") / (levels * levels)).cast("int")
    offset = kind % len(offsets)
    return merged.select(
        image,
        obj,
        _pick(channels, F.floor(kind / len(offsets)).cast("int")).alias("channel"),
        _pick([o[0] for o in offsets], offset).cast("bigint").alias("d"),
        _pick([o[1] for o in offsets], offset).cast("bigint").alias("angle"),
        (F.floor(F.col("cell") / levels) % levels).alias("i"),
        (F.col("cell") % levels).cast("bigint").alias("j"),
        "n",
    )


def glcm_pairs(
    pixels: DataFrame,
    channels: list[str],
    distances: list[int],
    angles: list[int],
    levels: int = 32,
    obj: str = "obj",
    image: str = "image_id",
    side: int = SIDE,
) -> DataFrame:
    """Level pairs inside objects: (image, obj, channel, d, angle, i, j, n).

    All channels and offsets are counted from one shuffle of the object pixels; a
    tile returns its pair counts, never the pairs.
    """
    offsets = glcm_offsets(distances, angles)
    counted = labelled(pixels, obj)
    tile_rows = over_tiles(
        pixels.filter(F.col(obj) > 0),
        lambda tile, keys: _packed(_glcm_parts(tile, channels, offsets, levels, obj), keys, obj),
        _packed_schema(pixels, image, obj),
        [obj, *channels],
        _glcm_margin(offsets),
        image,
        side,
        counted=counted,
    )
    return _glcm_rows(_merged(tile_rows, image, obj, counted), channels, offsets, levels, image, obj)


def _level_parts(tile: Tile, channels: list[str], obj: str) -> list[tuple]:
    """(object, channel * 256 + level, n) of the labelled pixels; levels are 0 to 255."""
    labels = tile.core(tile.grid(obj, 0))
    inside = labels > 0
    ids, place = np.unique(labels[inside], return_inverse=True)
    parts = []
    for number, c in enumerate(channels):
        n = np.bincount(place * 256 + tile.core(tile.grid(c, 0))[inside], minlength=len(ids) * 256)
        hit = np.flatnonzero(n)
        parts.append((ids[hit // 256], number * 256 + hit % 256, n[hit]))
    return parts


def object_counts(
    pixels: DataFrame,
    filled: DataFrame,
    channels: list[str],
    distances: list[int],
    angles: list[int],
    levels: int = 32,
    obj: str = "obj",
    image: str = "image_id",
    side: int = SIDE,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Level counts, pattern counts and level pairs of all objects from one pass.

    The pixel table is shuffled once; what leaves a tile is counts, which are
    written to the shared folder because three tables are made of them.  The results are
    those of counting by level (image, obj, c, v, n), ``lbp_counts`` and ``glcm_pairs``.
    """
    offsets = glcm_offsets(distances, angles)
    margin = tuple(max(1, m) for m in _glcm_margin(offsets))
    first_lbp = 256 * len(channels)
    first_pair = first_lbp + 10 * len(channels)

    def work(tile: Tile, keys: dict) -> pd.DataFrame:
        parts = _level_parts(tile, channels, obj)
        parts += [(o, first_lbp + c, n) for o, c, n in _lbp_parts(tile, channels, obj, True)]
        pairs = _glcm_parts(tile, channels, offsets, levels, obj)
        parts += [(o, first_pair + c, n) for o, c, n in pairs]
        return _packed(parts, keys, obj)

    counted = labelled(pixels, obj)
    tile_rows = over_tiles(
        pixels,
        work,
        _packed_schema(pixels, image, obj),
        [obj, *channels],
        margin,
        image,
        side,
        filled.withColumnRenamed(obj, "mark"),
        counted,
    )
    counts = cut_lineage(_merged(tile_rows, image, obj, counted))
    cell = F.col("cell")
    level_rows = counts.filter(cell < first_lbp).select(
        image, obj, F.floor(cell / 256).cast("int").alias("c"), (cell % 256).cast("bigint").alias("v"), "n"
    )
    patterns = counts.filter((cell >= first_lbp) & (cell < first_pair))
    pairs = counts.filter(cell >= first_pair)
    return (
        level_rows,
        _lbp_rows(patterns.withColumn("cell", cell - first_lbp), channels, image, obj),
        _glcm_rows(
            pairs.withColumn("cell", cell - first_pair), channels, offsets, levels, image, obj
        ),
    )
