"""Brute force and closed forms for pixel tables and masks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellmetry.operators import components, evaluate, outlines, pixels as px, texture, tiles

PIXEL = "image_id bigint, y bigint, x bigint, v bigint"


def image(spark, array, name="v", image_id=0):
    h, w = array.shape
    pdf = pd.DataFrame(
        {
            "image_id": image_id,
            "y": np.repeat(np.arange(h), w),
            "x": np.tile(np.arange(w), h),
            name: array.ravel().astype("int64"),
        }
    )
    return spark.createDataFrame(pdf)


def dense(df, shape, column, fill=0):
    out = np.full(shape, fill)
    for r in df.collect():
        out[r["y"], r["x"]] = r[column]
    return out


def flood(mask):
    """Regions of equal non-zero value, eight neighbours, numbered by first pixel."""
    out, n = np.zeros(mask.shape, dtype=int), 0
    for sy, sx in zip(*np.nonzero(mask)):
        if out[sy, sx]:
            continue
        n += 1
        stack = [(sy, sx)]
        out[sy, sx] = n
        while stack:
            y, x = stack.pop()
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    a, b = y + dy, x + dx
                    if (
                        0 <= a < mask.shape[0]
                        and 0 <= b < mask.shape[1]
                        and not out[a, b]
                        and mask[a, b] == mask[sy, sx]
                    ):
                        out[a, b] = n
                        stack.append((a, b))
    return out


@pytest.mark.parametrize("side", [7, 256])
def test_components_match_flood_fill(spark, side):
    mask = (np.random.default_rng(1).random((40, 33)) < 0.45).astype(int)
    mask[10:20, 5:25] *= 2
    got = dense(components.label_components(image(spark, mask), "v", side=side), mask.shape, "component")
    assert (got == flood(mask)).all()


def test_snake_through_many_tiles(spark):
    mask = np.zeros((25, 25), dtype=int)
    mask[::4] = 1
    for k, y in enumerate(range(2, 25, 4)):
        mask[y - 1 : y + 2, 24 if k % 2 == 0 else 0] = 1
    got = components.label_components(image(spark, mask), "v", side=5)
    assert got.select("component").distinct().count() == 1


def test_closing_and_blur_do_not_depend_on_tiles(spark):
    array = np.random.default_rng(2).integers(0, 256, (30, 21))
    for run in (tiles.grey_close_3x3, tiles.gaussian_blur):
        a = dense(run(image(spark, array), "v", side=8), array.shape, "v")
        b = dense(run(image(spark, array), "v"), array.shape, "v")
        assert (a == b).all()


def test_texture_does_not_depend_on_tiles(spark):
    rng = np.random.default_rng(3)
    array = rng.integers(0, 256, (30, 30))
    labelled = image(spark, array).join(
        image(spark, np.kron(np.arange(4).reshape(2, 2), np.ones((15, 15))), "obj"),
        ["image_id", "y", "x"],
    )
    args = (["v"], texture.DISTANCES, texture.ANGLES)
    a = sorted(map(tuple, tiles.glcm_pairs(labelled, *args, side=9).collect()))
    b = sorted(map(tuple, tiles.glcm_pairs(labelled, *args).collect()))
    assert a == b and a
    c = sorted(map(tuple, tiles.lbp_counts(labelled, ["v"], side=9).collect()))
    assert c == sorted(map(tuple, tiles.lbp_counts(labelled, ["v"]).collect()))


def test_constant_image_texture(spark):
    flat = image(spark, np.full((12, 12), 77)).selectExpr("*", "1L as obj")
    pairs = tiles.glcm_pairs(flat, ["v"], texture.DISTANCES, texture.ANGLES)
    rows = texture.glcm_features(pairs, texture.object_channels(flat, ["v"])).collect()
    by_d = {r["d"]: r for r in rows}
    assert by_d[3]["contrast"] == 0 and by_d[3]["energy"] == 1 and by_d[3]["correlation"] == 1
    assert by_d[18]["energy"] == 0 and by_d[18]["correlation"] == 1  # no pair fits


def outside_of(mask):
    """Background joined to the border through sides, by plain search."""
    seen = np.zeros(np.array(mask.shape) + 2, dtype=bool)
    wide = np.pad(mask, 1)
    stack = [(0, 0)]
    while stack:
        y, x = stack.pop()
        if 0 <= y < wide.shape[0] and 0 <= x < wide.shape[1] and not seen[y, x] and not wide[y, x]:
            seen[y, x] = True
            stack += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    return seen[1:-1, 1:-1]


def walk(mask):
    """Border of the region of the first pixel, walked from there against the clock."""
    ring, wide = tiles.RING, np.pad(mask, 1)
    start = at = tuple(np.argwhere(wide)[0])
    points, look, first = [], 2, None  # the pixel above is empty
    while True:
        points.append((int(at[1]) - 1, int(at[0]) - 1))
        k = next((k % 8 for k in range(look, look + 8) if wide[at[0] + ring[k % 8][0], at[1] + ring[k % 8][1]]), None)
        if k is None or (at, k) == first:
            return points[:-1] if k is not None else points
        first = first or (start, k)
        at, look = (at[0] + ring[k][0], at[1] + ring[k][1]), (k + 5) % 8


def shoelace(points):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1]))) / 2


def hard_mask():
    mask = (np.random.default_rng(4).random((26, 31)) < 0.55).astype(int)
    mask[3:17, 8:25] = 0
    mask[4:16, 9:24] = 1
    mask[6:13, 11:20] = 0
    mask[8:10, 13:16] = 1  # nested in the hole
    mask[20:, :] = 0
    mask[22, 3:29] = 1
    mask[24, 5] = 1
    return mask


@pytest.mark.parametrize("side", [13, 256])
def test_outlines_match_a_walk_along_the_border(spark, side):
    mask = hard_mask()
    regions = flood((~outside_of(mask)).astype(int))
    want = {i: walk(regions == i) for i in range(1, regions.max() + 1)}
    rows = outlines.mask_outlines(image(spark, regions, "obj"), side=side).collect()
    got = {r["obj"]: [(p["x"], p["y"]) for p in r["contour"]] for r in rows}
    assert len(rows) == len(got) and got == want
    filled = outlines.outside_filled(image(spark, mask), "v", side=side)
    named = components.pixel_regions(filled.selectExpr("*", "1L as one"), "one", side=side)
    areas = outlines.contour_areas(named, side=side).collect()
    found = {regions[divmod(r["root"], components.ROW)]: r["area"] for r in areas}
    assert found == {i: shoelace(p) for i, p in want.items()}


def test_outlines_of_touching_labels_with_holes(spark):
    labels = np.zeros((20, 20), dtype=int)
    labels[2:15, 2:9], labels[2:15, 9:18] = 1, 2
    labels[5:9, 11:14] = 0  # the hole has no outline of its own
    labels[18, 18] = 2  # a second piece
    rows = outlines.mask_outlines(image(spark, labels, "obj"), side=8).collect()
    got = {(r["obj"], r["part"]): [(p["x"], p["y"]) for p in r["contour"]] for r in rows}
    row = components.ROW
    assert set(got) == {(1, 2 * row + 2), (2, 2 * row + 9), (2, 18 * row + 18)}
    assert got[1, 2 * row + 2] == walk(labels == 1) and got[2, 18 * row + 18] == [(18, 18)]
    assert shoelace(got[2, 2 * row + 9]) == 12 * 8
    empty = image(spark, np.zeros((3, 3)), "obj")
    assert outlines.mask_outlines(empty).count() == 0
    assert outlines.mask_outlines(empty.limit(0)).count() == 0


@pytest.mark.parametrize("side", [13, 256])
def test_regions_are_kept_by_contour_area(spark, side):
    mask = hard_mask()
    regions = flood((~outside_of(mask)).astype(int))
    areas = {i: shoelace(walk(regions == i)) for i in range(1, regions.max() + 1)}
    kept = np.isin(regions, [i for i, a in areas.items() if 0.5 <= a <= 200])
    for fill, want in ((True, kept), (False, kept & (mask > 0))):
        got = outlines.component_size_filter(image(spark, mask), "v", 0.5, 200, fill, side=side)
        assert {(r["y"], r["x"]) for r in got.collect()} == set(zip(*np.nonzero(want)))
    lines = outlines.component_size_filter(image(spark, mask), "v", 0, 0, side=side)
    zero = np.isin(regions, [i for i, a in areas.items() if a == 0])
    assert {(r["y"], r["x"]) for r in lines.collect()} == set(zip(*np.nonzero(zero)))


def test_channel_adjust_refuses_missing_channels(spark):
    with pytest.raises(ValueError):
        px.channel_adjust(image(spark, np.ones((2, 2))), ["a", "b"], 4)


def masks(spark, gt, pred):
    return evaluate.instance_overlap(image(spark, gt, "obj"), image(spark, pred, "pred"))


def test_low_threshold_equals_greedy_loop(spark):
    rng = np.random.default_rng(4)
    gt = np.kron(rng.integers(0, 9, (6, 6)), np.ones((4, 4), dtype=int))
    pred = np.roll(np.kron(rng.integers(0, 9, (8, 8)), np.ones((3, 3), dtype=int)), 1, 1)
    pairs = []
    for g in range(1, 9):
        for p in range(1, 9):
            inter = int(((gt == g) & (pred == p)).sum())
            union = int(((gt == g) | (pred == p)).sum())
            if inter and inter * 20 >= union:
                pairs.append((-inter / union, g, p))
    want, used_g, used_p = set(), set(), set()
    for _, g, p in sorted(pairs):
        if g not in used_g and p not in used_p:
            want.add((g, p))
            used_g.add(g)
            used_p.add(p)
    got = evaluate.greedy_match(masks(spark, gt, pred), 1, 20)
    assert {(r["obj"], r["pred"]) for r in got.collect()} == want


def test_empty_masks(spark):
    none, some = np.zeros((4, 4), dtype=int), np.zeros((4, 4), dtype=int)
    some[1:3, 1:3] = 3

    def score(gt, pred):
        overlap = masks(spark, gt, pred)
        return evaluate.segmentation_metrics(overlap, evaluate.greedy_match(overlap)).first()

    both = score(none, none)
    assert [both[c] for c in ("iou", "dice", "precision", "recall", "f1", "mae")] == [1, 1, 1, 1, 1, 0]
    missed = score(some, none)
    assert (missed["precision"], missed["recall"], missed["f1"]) == (1, 0, 0)
    assert missed["mae"] == pytest.approx(0.75)


def test_counts_of_one_pass(spark):
    """Levels, contour patterns and level pairs at once, over tiles of another size."""
    rng = np.random.default_rng(8)
    rows = [
        (img, y, x, 1 if (y - 9) ** 2 + (x - 9) ** 2 < 50 and (y, x) != (9, 9) else 2 * int(x > 20), int(v))
        for img in (1, 2)
        for y in range(20)
        for x in range(30)
        for v in [rng.integers(0, 256)]
    ]
    table = spark.createDataFrame(rows, "image_id long, y long, x long, obj long, v long")
    # a contour that goes over the hole, and one that crosses the other object
    filled = spark.createDataFrame(
        [(i, 1, y, x) for i in (1, 2) for y in range(5, 14) for x in range(5, 14)]
        + [(i, 2, y, x) for i in (1, 2) for y in range(3, 8) for x in range(10, 29)],
        "image_id long, obj long, y long, x long",
    )

    def rows_of(df):
        return sorted(map(tuple, df.select(sorted(df.columns)).collect()))

    levels, patterns, pairs = tiles.object_counts(
        table, filled, ["v"], texture.DISTANCES, texture.ANGLES, side=9
    )
    assert rows_of(pairs) == rows_of(tiles.glcm_pairs(table, ["v"], texture.DISTANCES, texture.ANGLES))
    assert rows_of(patterns) == rows_of(tiles.lbp_counts(table, ["v"], filled=filled))
    by_level = table.filter("obj > 0").groupBy("image_id", "obj", F.lit(0).alias("c"), "v").agg(F.count("*").alias("n"))
    assert rows_of(levels) == rows_of(by_level)
    codes = tiles.lbp_codes(table, ["v"]).withColumnRenamed("v", "code").drop("obj")
    inside = filled.join(codes, ["image_id", "y", "x"]).groupBy("image_id", "obj", "code").agg(F.count("*").alias("n"))
    assert rows_of(patterns.filter("obj > 0").drop("channel")) == rows_of(inside)
