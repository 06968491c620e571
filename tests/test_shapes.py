"""Closed forms and brute force for contours."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmetry.functions import contour as ring
from cellmetry.functions.solvers import _interior_pole, _min_box_area, _spans
from cellmetry.operators import geometry, spatial
from cellmetry.sources import derived
from conftest import SF

SCHEMA = "image_id bigint, object_id bigint, label bigint, contour array<struct<x:bigint,y:bigint>>"
SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10)]
DIAMOND = [(10, 0), (20, 10), (10, 20), (0, 10)]
ELL = [(0, 0), (30, 0), (30, 4), (4, 4), (4, 30), (0, 30)]


def frame(spark, *rings):
    return spark.createDataFrame([(0, k, 0, r) for k, r in enumerate(rings)], SCHEMA)


def test_square_and_diamond(spark):
    rows = geometry.morpho_features(frame(spark, SQUARE, DIAMOND)).orderBy("object_id").collect()
    assert rows[0]["area"] == 100 and rows[0]["area_box"] == pytest.approx(1)
    assert (rows[0]["cx_coords"], rows[0]["cy_coords"]) == (5, 5)
    assert rows[0]["radius_ratio"] == pytest.approx(1)
    assert rows[0]["roundness"] == pytest.approx(1600 / (400 * math.pi))
    assert rows[0]["aspect"] is None  # four points define no ellipse
    assert rows[1]["area"] == 200 and rows[1]["area_box"] == pytest.approx(1)


def test_centroid_outside_takes_the_pole(spark):
    row = geometry.object_centre(frame(spark, ELL)).first()
    side = ring.point_side(ring.ring_edges(F.col("contour")), F.col("cx_coords"), F.col("cy_coords"))
    inside = geometry.object_centre(frame(spark, ELL)).select(side.alias("s")).first()["s"]
    assert inside == 1 and row["cx_coords"] is not None


def test_exact_ellipse_axes(spark):
    t = np.linspace(0, 2 * np.pi, 400, endpoint=False)
    scale, turn = 1000, 0.5
    x, y = 40 * scale * np.cos(t), 17 * scale * np.sin(t)
    points = np.rint(
        np.stack([x * np.cos(turn) - y * np.sin(turn), x * np.sin(turn) + y * np.cos(turn)], 1)
    ).astype(int)
    row = geometry.ellipse_features(frame(spark, [tuple(p) for p in points.tolist()])).first()
    assert row["aspect"] == pytest.approx(40 / 17, rel=1e-4)
    major, minor = 80 * scale, 34 * scale
    assert row["eccentricity"] == pytest.approx(math.sqrt(major**2 - minor**2) / major**2, rel=1e-4)


def _covers(x, y, px, py):
    odd = False
    for x1, y1, x2, y2 in zip(x, y, np.roll(x, -1), np.roll(y, -1)):
        turn = (x2 - x1) * (py - y1) - (px - x1) * (y2 - y1)
        if turn == 0 and min(x1, x2) <= px <= max(x1, x2) and min(y1, y2) <= py <= max(y1, y2):
            return 0
        if (y1 > py) != (y2 > py) and ((turn > 0) if y2 > y1 else (turn < 0)):
            odd = not odd
    return 1 if odd else -1


@pytest.mark.parametrize("points", [SQUARE, DIAMOND, ELL, [(0, 0), (7, 3), (13, 1), (9, 12), (3, 8)]])
def test_spans_cover_what_containment_says(points):
    x, y = np.array(points).T
    ys, first, last = _spans(x, y)
    covered = [(b, a) for a, f, g in zip(ys, first, last) for b in range(f, g + 1)]
    assert len(covered) == len(set(covered))
    grid = [(a, b) for a in range(-1, 32) for b in range(-1, 32)]
    assert set(covered) == {p for p in grid if _covers(x, y, *p) >= 0}


def test_poles_against_full_search(spark):
    rows = derived.crescents(spark, SF).limit(6).collect()
    for row in rows:
        x = np.array([p["x"] for p in row["contour"]])
        y = np.array([p["y"] for p in row["contour"]])
        x1, y1, x2, y2 = x, y, np.roll(x, -1), np.roll(y, -1)
        best, depth = None, 0.0
        for py in range(y.min(), y.max() + 1):
            for px in range(x.min(), x.max() + 1):
                dx, dy = x2 - x1, y2 - y1
                t = np.clip(((px - x1) * dx + (py - y1) * dy) / np.maximum(dx * dx + dy * dy, 1), 0, 1)
                d = np.sqrt(((px - x1 - t * dx) ** 2 + (py - y1 - t * dy) ** 2).min())
                if d > depth + 1e-9 and _covers(x, y, px, py) == 1:
                    best, depth = (px, py), d
        assert _interior_pole(x, y) == best


def test_min_box_of_turned_rectangle():
    assert _min_box_area(*np.array([(0, 0), (4, 3), (-2, 11), (-6, 8)]).T) == pytest.approx(50)


def test_contour_text(spark):
    rows = spark.createDataFrame(
        [("[[[1 2]] [[ 3   4]]\n [[5 6]]]",), ("[[[1 2]] [[3]]]",), ("nonsense",)], "t string"
    ).select(ring.parse_contour_text(F.col("t")).alias("c"))
    got = [None if r["c"] is None else [tuple(p) for p in r["c"]] for r in rows.collect()]
    assert got == [[(1, 2), (3, 4), (5, 6)], None, None]


def test_parent_rules(spark):
    cyto = frame(spark, SQUARE, [(-5, -5), (15, -5), (15, 15), (-5, 15)])
    points = [(0, 1, 5, 5), (0, 2, 10, 5), (0, 3, 12, 12), (0, 4, 99, 99), (1, 5, 5, 5)]
    nuclei = spark.createDataFrame(points, "image_id bigint, nucleus_id bigint, px bigint, py bigint")
    got = {r["nucleus_id"]: r["object_id"] for r in spatial.nucleus_parents(nuclei, cyto, grid=4).collect()}
    assert got == {1: 0, 2: 0, 3: 1}  # first wins, the border counts, no parent drops out


def test_pair_counts_do_not_depend_on_chunks(spark):
    cyto = derived.cytoplasms(spark, SF)
    whole = sorted(map(tuple, spatial.pair_distance_counts(cyto).collect()))
    cut = sorted(map(tuple, spatial.pair_distance_counts(cyto, chunk=3).collect()))
    assert whole == cut
