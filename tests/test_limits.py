"""Nothing is cut, dropped or capped: crops, masks, labels, matches, constant features."""

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cellmetry.operators import components, evaluate, outlines, pixels, relational, stats, tiles
from cellmetry.session import shared_folder
from cellmetry.sources import derived
from conftest import SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_crops_keep_every_pixel(spark):
    rows = [
        (i, o, y, x, 1 + (y * x) % 200)
        for i, o, y0, x0, h, w in [(1, 1, 20, 20, 3, 30), (1, 2, 40, 30, 12, 5), (2, 7, 30, 30, 1, 1)]
        for y in range(y0, y0 + h)
        for x in range(x0, x0 + w)
    ]
    own = spark.createDataFrame(rows, "image_id long, obj long, y long, x long, v long")
    windows = own.groupBy("image_id", "obj").agg(
        ((F.min("x") + F.max("x") + 1) / 2).alias("cx"),
        ((F.min("y") + F.max("y") + 1) / 2).alias("cy"),
        (F.max("x") - F.min("x") + 1).alias("w"),
        (F.max("y") - F.min("y") + 1).alias("h"),
    )
    sizes = spark.createDataFrame([(1, 64, 64), (2, 64, 64)], "image_id long, height long, width long")
    crops = pixels.object_crop(own, windows, sizes, pixels.crop_window_size(windows))
    assert crops.count() == len(rows)
    assert crops.distinct().count() == len(rows)
    shape = crops.agg(F.max("crop_y"), F.max("crop_x")).first()
    assert shape[0] < 30 and shape[1] < 5 + 1


def test_masks_with_pixels_on_one_side(spark):
    truth = spark.createDataFrame(
        [(1, 0, 0, 5), (1, 0, 1, 0), (2, 0, 0, 6)], "image_id long, y long, x long, obj long"
    )
    pred = spark.createDataFrame(
        [(1, 0, 1, 0), (1, 0, 2, 8), (3, 0, 0, 9)], "image_id long, y long, x long, pred long"
    )
    overlap = evaluate.instance_overlap(truth, pred)
    assert sorted(map(tuple, overlap.collect())) == [
        (1, 0, 0, 1), (1, 0, 8, 1), (1, 5, 0, 1), (2, 6, 0, 1), (3, 0, 9, 1)
    ]
    metrics = evaluate.segmentation_metrics(overlap, evaluate.greedy_match(overlap)).collect()
    assert {r.image_id: r.f1 for r in metrics} == {1: 0.0, 2: 0.0, 3: 0.0}


def test_long_chain_of_matches(spark):
    pairs = [(1, i, j, 1000 - 2 * i - (j - i)) for i in range(1, 24) for j in (i, i + 1)]
    overlap = spark.createDataFrame(pairs, "image_id long, obj long, pred long, inter long")
    got = evaluate.greedy_match(overlap, 1, 10).collect()
    scored = [(-r.inter / r.union, r.obj, r.pred) for r in evaluate.scored_pairs(overlap).collect()]
    want = []
    for _, o, p in sorted(scored):
        if o not in [w[0] for w in want] and p not in [w[1] for w in want]:
            want.append((o, p))
    assert len(want) > 20 and {(r.obj, r.pred) for r in got} == set(want)


@pytest.mark.parametrize("label", [7, -1, None])
def test_labels_outside_the_classes_fail(spark, label):
    df = spark.createDataFrame([(0, 1), (label, 0)], "label long, predicted long")
    for counted in (
        evaluate.class_counts(df, 3), evaluate.class_weights(df, 3), evaluate.confusion_matrix(df, 3)
    ):
        with pytest.raises(PySparkException):
            counted.collect()


def test_a_constant_feature_gives_null(spark):
    rows = [(i % 3, float(i), 5.0) for i in range(30)]
    df = spark.createDataFrame(rows, "label long, a double, b double")
    got = {r.feature: r.statistic for r in stats.kruskal_wallis(df, ["a", "b"]).collect()}
    assert got["b"] is None and got["a"] is not None
    assert {r.feature for r in stats.dunn_posthoc(df, ["a", "b"], level=1.1).collect()} == {"a"}
    one = spark.createDataFrame([(0, 1.0)], "label long, a double")
    assert stats.kruskal_wallis(one, ["a"]).first().statistic is None


def _table(spark, array):
    h, w = array.shape
    rows = [(1, y, x, int(array[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "image_id long, y long, x long, grayscale long")


@pytest.mark.parametrize("shape, more", [((21, 30), (3, 2)), ((16, 13), (8, 3)), ((3, 5), (5, 3)), ((1, 8), (7, 8))])
def test_uneven_images_equal_mirrored_ones(spark, shape, more):
    array = np.random.default_rng(6).integers(0, 256, shape)
    wide = np.pad(array, ((0, more[0]), (0, more[1])), mode="reflect" if shape[0] > 1 else "symmetric")
    if shape[0] == 1:  # a single line has no other to mirror
        wide = np.pad(np.repeat(array, 8, axis=0), ((0, 0), (0, 8)), mode="reflect")
    want = {(r.y, r.x): r.grayscale for r in pixels.clahe(_table(spark, wide)).collect()}
    got = {(r.y, r.x): r.grayscale for r in pixels.clahe(_table(spark, array)).collect()}
    assert len(got) == array.size and all(want[k] == v for k, v in got.items())


def test_blur_in_whole_numbers(spark):
    array = np.random.default_rng(7).integers(0, 256, (9, 14))
    kernel = np.array(tiles.gaussian_weights(5, 4.0))
    assert kernel.sum() == 256 and (kernel == kernel[::-1]).all()
    wide = np.pad(array, 2, mode="reflect")
    want = {
        (y, x): int((kernel[:, None] * kernel * wide[y : y + 5, x : x + 5]).sum() + 32768) // 65536
        for y in range(9)
        for x in range(14)
    }
    got = tiles.gaussian_blur(_table(spark, array), side=6).collect()
    assert {(r.y, r.x): r.grayscale for r in got} == want


def test_named_images_and_fractions(spark):
    named = spark.range(100).selectExpr(
        "concat('img', id div 50, '.tif') as image_name", "(id % 50) div 10 as y", "id % 10 as x",
        "id % 7 as v", "1L as obj",
    )
    for got in (
        tiles.gaussian_blur(named, "v", image="image_name"),
        tiles.lbp_counts(named, ["v"], image="image_name"),
        components.pixel_regions(named, "v", image="image_name"),
    ):
        assert {r.image_name for r in got.collect()} == {"img0.tif", "img1.tif"}
    with pytest.raises(TypeError):
        tiles.gaussian_blur(named.withColumn("v", F.col("v") / 2), "v", image="image_name")


def test_plans(spark):
    objects = derived.features(spark, SF).withColumn("obj_id", F.col("vec_id"))
    first = plan(relational.dedup_keep_first(objects, ["image_name", "object_id"]))
    assert "SortAggregate" not in first and "WindowGroupLimit" in first
    assert "Exchange" not in plan(objects.select("vec_id", "label"))


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError):
        shared_folder(Session(), "x")


def test_stacks_hold_whole_tiles(spark):
    """Regions of small tiles, read in several parts of one partition, equal those of large tiles."""
    mask = np.random.default_rng(11).integers(1, 3, (400, 410))
    at = np.indices(mask.shape).reshape(2, -1)
    frame = pd.DataFrame({"image_id": "a", "y": at[0], "x": at[1], "v": mask.ravel()})
    frame = spark.createDataFrame(frame)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        assert mask.size > tiles.STACK_ROWS
        small, large = (components.pixel_regions(frame, "v", side=side).toPandas() for side in (24, 256))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = ["y", "x"]
    assert len(small) == mask.size
    assert small.sort_values(order).reset_index(drop=True).equals(large.sort_values(order).reset_index(drop=True))


def test_a_region_is_a_row_of_its_tile(spark):
    """Many tiles are worked on at once, and regions are joined, not their pixels."""
    frame = _table(spark, np.ones((60, 50), int)).withColumnRenamed("grayscale", "v")
    rows = components.region_rows(frame, "v", side=20, areas=True).collect()
    assert len(rows) == 9 and {r.root for r in rows} == {0}
    assert sum(len(r.points) for r in rows) == 3000 and sum(r.twice for r in rows) == 2 * 59 * 49
    areas = plan(outlines.contour_areas(components.pixel_regions(frame, "v"), side=20))
    assert "MapInArrow" in areas and "FlatMapGroupsInPandas" not in areas


def test_a_chain_is_a_row_of_its_tile(spark):
    frame = _table(spark, np.ones((60, 50), int)).withColumnRenamed("grayscale", "v")
    chains = outlines._chains(frame, "v", "image_id", 20)
    assert "MapInArrow" in plan(chains) and "FlatMapGroupsInPandas" not in plan(chains)
    rows = chains.collect()
    assert len(rows) == 8 and sum(len(r.steps) for r in rows) == 2 * (59 + 49)
    assert sum(r.turn for r in rows) == -2 * 59 * 49
