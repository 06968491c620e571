"""Small per-object solvers that SQL expressions cannot hold, as Arrow functions.

Each call sees one batch of rings as two list columns (x values, y values).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, ShortType, StructField, StructType

_ELLIPSE_POINTS = 5


def _struct(kind, *names: str) -> StructType:
    return StructType([StructField(n, kind) for n in names])



def _ellipse_axes(xs: pd.Series, ys: pd.Series) -> np.ndarray:
    """Full axis lengths (major, minor) of the least-squares ellipse of each ring.

    Two stages: a general conic through the centred and scaled points gives the
    centre; a conic about that centre gives the axes.  All rings of the batch are
    solved together.  Rows are NaN where fewer than five points or no ellipse exists.
    """
    out = np.full((len(xs), 2), np.nan)
    usable = [
        k for k, v in enumerate(xs) if v is not None and len(v) >= _ELLIPSE_POINTS
    ]
    if not usable:
        return out
    sizes = np.array([len(xs.iloc[k]) for k in usable])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    x = np.concatenate([np.asarray(xs.iloc[k], dtype=float) for k in usable])
    y = np.concatenate([np.asarray(ys.iloc[k], dtype=float) for k in usable])

    def total(v):
        return np.add.reduceat(v, starts)

    def spread(v):
        return np.repeat(v, sizes)

    x = x - spread(total(x) / sizes)
    y = y - spread(total(y) / sizes)
    scale = np.maximum(np.maximum.reduceat(np.maximum(abs(x), abs(y)), starts), 1e-12)
    x, y = x / spread(scale), y / spread(scale)

    def normal_solve(terms):
        n = len(terms)
        left = np.empty((len(usable), n, n))
        right = np.empty((len(usable), n))
        for a in range(n):
            right[:, a] = total(terms[a])
            for b in range(a, n):
                left[:, a, b] = left[:, b, a] = total(terms[a] * terms[b])
        fine = np.linalg.cond(left) < 1e13
        answer = np.full((len(usable), n), np.nan)
        if fine.any():
            answer[fine] = np.linalg.solve(left[fine], right[fine][:, :, None])[:, :, 0]
        return answer

    g = normal_solve([-x * x, -y * y, -x * y, x, y])
    det = 4 * g[:, 0] * g[:, 1] - g[:, 2] ** 2
    with np.errstate(all="ignore"):
        cx = (2 * g[:, 1] * g[:, 3] - g[:, 2] * g[:, 4]) / det
        cy = (2 * g[:, 0] * g[:, 4] - g[:, 2] * g[:, 3]) / det
        sound = np.isfinite(cx) & np.isfinite(cy)
        u = x - spread(np.where(sound, cx, 0.0))
        w = y - spread(np.where(sound, cy, 0.0))
        q = normal_solve([u * u, w * w, u * w])
        half = np.sqrt((q[:, 0] - q[:, 1]) ** 2 + q[:, 2] ** 2)
        small, large = (q[:, 0] + q[:, 1] - half) / 2, (q[:, 0] + q[:, 1] + half) / 2
        good = sound & (small > 0)
        axes = np.stack([2 / np.sqrt(small), 2 / np.sqrt(large)], axis=1) * scale[:, None]
    axes[~good] = np.nan
    out[usable] = axes
    return out


def _hull(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def chain(seq):
        kept: list[tuple[int, int]] = []
        for p in seq:
            while len(kept) > 1 and (kept[-1][0] - kept[-2][0]) * (p[1] - kept[-2][1]) <= (
                kept[-1][1] - kept[-2][1]
            ) * (p[0] - kept[-2][0]):
                kept.pop()
            kept.append(p)
        return kept[:-1]

    return chain(points) + chain(points[::-1])


def _min_box_area(x: np.ndarray, y: np.ndarray) -> float:
    """Area of the smallest rectangle, which always rests on one hull edge.

    Only the lowest and highest vertex of each x can lie on the hull.
    """
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    edge = np.flatnonzero(np.diff(x))
    ends = np.unique(np.concatenate([[0], edge, edge + 1, [len(x) - 1]]))
    hull = np.array(_hull(list(zip(x[ends].tolist(), y[ends].tolist()))))
    if len(hull) < 3:
        return 0.0
    step = np.roll(hull, -1, axis=0) - hull
    along = step @ hull.T
    across = np.stack([-step[:, 1], step[:, 0]], axis=1) @ hull.T
    sides = (along.max(1) - along.min(1)) * (across.max(1) - across.min(1))
    return float((sides / (step**2).sum(1)).min())


def _segment_distance2(px, py, x1, y1, x2, y2):
    dx, dy = x2 - x1, y2 - y1
    length = np.maximum(dx * dx + dy * dy, 1e-300)
    t = np.clip(((px[:, None] - x1) * dx + (py[:, None] - y1) * dy) / length, 0.0, 1.0)
    return ((px[:, None] - x1 - t * dx) ** 2 + (py[:, None] - y1 - t * dy) ** 2).min(1)


def _signed_distance(px, py, ring):
    """Distance to the ring, negative outside."""
    x1, y1, x2, y2 = ring
    over = (y1 > py[:, None]) != (y2 > py[:, None])
    with np.errstate(all="ignore"):
        left = px[:, None] < x1 + (py[:, None] - y1) * (x2 - x1) / (y2 - y1)
    inside = (over & left).sum(1) % 2 == 1
    d = np.sqrt(_segment_distance2(px, py, x1, y1, x2, y2))
    return np.where(inside, d, -d)


def _interior_pole(x: np.ndarray, y: np.ndarray) -> tuple[int, int] | None:
    """Integer point inside the ring that lies furthest from it.

    Squares are halved down to single pixels and dropped once their centre
    distance plus half diagonal cannot reach the best value.  Ties take the
    smallest (y, x).
    """
    x, y = x.astype(float), y.astype(float)
    ring = (x, y, np.roll(x, -1), np.roll(y, -1))
    side = 1
    while side < max(np.ptp(x), np.ptp(y)) + 1:
        side *= 2
    cells = np.array([[x.min(), y.min()]])
    best = 0.0
    while len(cells):
        middle = (side - 1) / 2.0
        parts, chunk = [], max(1, 4_000_000 // len(x))
        for k in range(0, len(cells), chunk):
            part = cells[k : k + chunk]
            parts.append(_signed_distance(part[:, 0] + middle, part[:, 1] + middle, ring))
        reach = np.concatenate(parts)
        if side == 1:
            top = reach.max()
            if top <= 0:
                return None
            ties = cells[reach >= top - 1e-9]
            pick = ties[np.lexsort((ties[:, 0], ties[:, 1]))[0]]
            return int(pick[0]), int(pick[1])
        # some pixel of the square is at most half a diagonal step from its middle
        best = max(best, float((reach - math.sqrt(0.5)).max()))
        cells = cells[reach + middle * math.sqrt(2.0) + 1e-9 >= best]
        side //= 2
        cells = np.concatenate([cells + np.array([a, b]) * side for a in (0, 1) for b in (0, 1)])
    return None


@F.pandas_udf(_struct(DoubleType(), "major", "minor"))
def _fit_axes(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
    axes = _ellipse_axes(xs, ys)
    out = pd.DataFrame({"major": axes[:, 0], "minor": axes[:, 1]})
    return out.astype(object).where(out.notna(), None)


@F.pandas_udf(DoubleType())
def _fit_box(xs: pd.Series, ys: pd.Series) -> pd.Series:
    return pd.Series(
        [
            None if v is None or len(v) == 0 else _min_box_area(np.asarray(v), np.asarray(w))
            for v, w in zip(xs, ys)
        ],
        dtype="Float64",
    )


@F.pandas_udf(_struct(LongType(), "x", "y"))
def _find_pole(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
    found = [
        None if v is None or len(v) < 3 else _interior_pole(np.asarray(v), np.asarray(w))
        for v, w in zip(xs, ys)
    ]
    return pd.DataFrame(
        {
            "x": pd.array([p and p[0] for p in found], dtype="Int64"),
            "y": pd.array([p and p[1] for p in found], dtype="Int64"),
        }
    )


def fit_axes(contour: Column) -> Column:
    """Struct (major, minor): axes of the fitted ellipse."""
    return _fit_axes(contour["x"], contour["y"])


def fit_box(contour: Column) -> Column:
    """Area of the smallest rectangle around the ring."""
    return _fit_box(contour["x"], contour["y"])


def interior_pole(contour: Column) -> Column:
    """Struct (x, y): deepest integer point of the ring; null rings cost nothing."""
    return _find_pole(contour["x"], contour["y"])


def _closest(ax, ay, bx, by) -> tuple[int, int, int]:
    """(squared distance, index in a, index in b), first minimum in row-major order."""
    best = (None, 0, 0)
    chunk = max(1, 2_000_000 // max(len(bx), 1))
    for k in range(0, len(ax), chunk):
        d = (ax[k : k + chunk, None] - bx) ** 2 + (ay[k : k + chunk, None] - by) ** 2
        at = int(d.argmin())
        value = d.flat[at]
        if best[0] is None or value < best[0]:
            best = (value, k + at // len(bx), at % len(bx))
    return best


@F.pandas_udf(_struct(LongType(), "distance2", "ax", "ay", "bx", "by"))
def _closest_vertices(
    ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series
) -> pd.DataFrame:
    """Closest vertex pair of two rings given as four list columns."""
    rows = []
    for pax, pay, pbx, pby in zip(ax, ay, bx, by):
        pax, pay, pbx, pby = (np.asarray(v) for v in (pax, pay, pbx, pby))
        d, i, j = _closest(pax, pay, pbx, pby)
        rows.append((d, pax[i], pay[i], pbx[j], pby[j]))
    return pd.DataFrame(rows, columns=["distance2", "ax", "ay", "bx", "by"])


def closest_vertices(a: Column, b: Column) -> Column:
    """Closest vertex pair of two contours.

    Declared non-deterministic only so that a filter on the result does not make
    Spark work it out twice.
    """
    return _closest_vertices.asNondeterministic()(a["x"], a["y"], b["x"], b["y"])


def _spans(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint spans (y, first x, last x) of the pixels a ring covers, border included.

    On each pixel row the crossings of half-open edges pair up from left to right;
    span ends are whole-number quotients, so they are exact.  Vertices and flat
    edges are added, then touching spans of a row are merged.
    """
    x2, y2 = np.roll(x, -1), np.roll(y, -1)
    lines = np.arange(y.min(), y.max() + 1)
    rows, edges = [], []
    chunk = max(1, 4_000_000 // len(x))
    for k in range(0, len(lines), chunk):
        part = lines[k : k + chunk, None]
        r, e = np.nonzero((y > part) != (y2 > part))
        rows.append(r + k)
        edges.append(e)
    row, edge = np.concatenate(rows), np.concatenate(edges)
    rise = y2[edge] - y[edge]
    over = (lines[row] - y[edge]) * (x2[edge] - x[edge]) * np.sign(rise)
    rise = np.abs(rise)
    order = np.lexsort((x[edge] + over / rise, row))
    low = (x[edge] + over // rise)[order]
    high = (x[edge] - (-over) // rise)[order]
    at = lines[row[order]]
    flat = y == y2
    ys = np.concatenate([at[0::2], y[flat], y])
    first = np.concatenate([high[0::2], np.minimum(x, x2)[flat], x])
    last = np.concatenate([low[1::2], np.maximum(x, x2)[flat], x])
    some = first <= last
    ys, first, last = ys[some], first[some], last[some]
    wide = last.max() - first.min() + 2
    start, stop = ys * wide + first - first.min(), ys * wide + last - first.min()
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    head = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    tail = np.r_[head[1:] - 1, len(start) - 1]
    return ys[order][head], first[order][head], reach[tail] - ys[order][head] * wide + first.min()


@F.arrow_udf(ArrayType(_struct(LongType(), "y", "first", "last")))
def ring_spans(xs: pa.Array, ys: pa.Array) -> pa.Array:
    """Covered pixel spans of each ring, as flat arrays: no Python object per span is made."""
    found, ends = [np.empty((3, 0), np.int64)], [0]
    for x, y in zip(xs, ys):
        if x.is_valid and len(x):
            points = (v.values.to_numpy(zero_copy_only=False) for v in (x, y))
            found.append(np.stack(_spans(*points)).astype(np.int64))
        else:
            found.append(found[0])
        ends.append(ends[-1] + found[-1].shape[1])
    flat = pa.StructArray.from_arrays(list(np.concatenate(found, axis=1)), names=["y", "first", "last"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)


@F.pandas_udf(ArrayType(ShortType()))
def equalising_curve(
    levels: pd.Series, counts: pd.Series, area: pd.Series, clip_limit: pd.Series
) -> pd.Series:
    """Contrast-limited curve (256 values) of each tile from its level counts.

    The excess over the clip goes evenly to all levels, its rest to evenly spaced ones.
    """

    def curve(v, n, pixels, limit):
        clip = max(int(limit * pixels / 256), 1)
        bins = np.zeros(256, dtype=np.int64)
        bins[np.asarray(v, dtype=np.int64)] = n
        excess = int(np.maximum(bins - clip, 0).sum())
        batch, rest = divmod(excess, 256)
        bins = np.minimum(bins, clip) + batch
        if rest:
            bins[:: max(256 // rest, 1)][:rest] += 1
        return np.minimum(np.rint(np.cumsum(bins) * (255.0 / pixels)), 255).astype(np.int16)

    return pd.Series([curve(*row) for row in zip(levels, counts, area, clip_limit)])


@F.pandas_udf(DoubleType())
def chi_square_tail(statistic: pd.Series, freedom: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution for whole degrees of freedom."""

    def tail(x: float, k: int) -> float | None:
        if x is None or math.isnan(x):
            return None
        if x <= 0 or k < 1:
            return 1.0
        half = x / 2.0
        if k % 2:
            value, term = math.erfc(math.sqrt(half)), math.sqrt(half / math.pi) * 2 * math.exp(-half)
            first = 1.5
        else:
            value, term = math.exp(-half), half * math.exp(-half)
            first = 2.0
        for step in range((k - 1) // 2):
            value += term
            term *= half / (first + step)
        return min(value, 1.0)

    return pd.Series([tail(x, int(k)) for x, k in zip(statistic, freedom)], dtype="float64")


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)))
