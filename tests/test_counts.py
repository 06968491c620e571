"""Counts leave tiles packed and need one shuffle; partitions grow with the pixels."""

import itertools

import numpy as np

from cellmetry.functions.names import CHANNELS
from cellmetry.operators import texture, tiles
from cellmetry.plans import images  # noqa: F401
from cellmetry.plans.registry import QUERIES
from cellmetry.sources import derived
from conftest import SF


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def test_pairs_are_shuffled_once_after_the_tiles(spark):
    # images, tiles, packed counts and nothing more
    assert exchanges(QUERIES["glcm_pairs"](spark, SF)) == 3
    assert exchanges(QUERIES["glcm_matrix"](spark, SF)) == 3


def test_objects_over_several_tiles(spark):
    pixels = derived.pixels(spark, SF).withColumn("obj", (derived.F.col("x") < 50).cast("bigint"))
    one, many = (
        tiles.glcm_pairs(pixels, CHANNELS, texture.DISTANCES, texture.ANGLES, 32, side=side).orderBy(
            "image_id", "obj", "channel", "d", "angle", "i", "j"
        )
        for side in (256, 24)
    )
    assert one.where("image_id < 2").collect() == many.where("image_id < 2").collect()


def test_partitions_grow_with_the_input(spark):
    rows = spark.range(1000)
    assert tiles.by_task(rows, "id", pixels=100 * tiles.TASK_PIXELS).rdd.getNumPartitions() == 100
    assert derived._spread(rows, 50 * derived.TASK_VECTORS, "id").rdd.getNumPartitions() == 50


def test_spans_make_no_object_each():
    """Spans of many rings in a batch take some bytes each, not a Python object."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from cellmetry.functions.solvers import ring_spans

    ring = pa.array([[0, 300, 300, 0]] * 200 + [[], None], pa.list_(pa.int64()))
    across = pa.array([[0, 0, 300, 300]] * 200 + [[], None], pa.list_(pa.int64()))
    tracemalloc.start()
    spans = ring_spans.func(ring, across)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    lengths = [len(s) for s in spans]
    assert set(lengths[:200]) == {301} and lengths[200:] == [0, 0]
    assert peak < 100 * sum(lengths) and np.all(np.asarray(spans.flatten().field("last")) == 300)


def test_distances_of_two_blocks_are_taken_once(spark, monkeypatch):
    """Blocks are bounded, and more of them give the same silhouettes."""
    from cellmetry.operators import ml

    assert ml.LARGEST_BLOCK <= 1 << 14
    df = derived.features(spark, SF)
    features = ["nuc_area", "cyto_area", "cyto_ii"]
    features = [f for f in features if f in df.columns] or [c for c, k in df.dtypes if k == "double"][:3]
    want = sorted(map(tuple, ml.silhouette_feature_pairs(df, "vec_id", "label", features, 10**6).collect()))
    monkeypatch.setattr(ml, "LARGEST_BLOCK", 60)
    got = sorted(map(tuple, ml.silhouette_feature_pairs(df, "vec_id", "label", features).collect()))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) < 1e-12 for g, w in zip(got, want))


def test_feature_pairs_leave_tasks_as_sums(spark):
    """A task returns a row per subset whatever its points; blocks do not change what a missing feature does."""
    from cellmetry.operators import ml

    rng = np.random.default_rng(5)
    rows = [(i, i % 3, *rng.normal(size=3).tolist()) for i in range(90)]
    rows += [(90, 1, None, 1.0, 2.0), (91, None, 0.5, 1.0, 2.0), (7, 2, 0.1, 0.2, 0.3), (None, 0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k long, l int, a double, b double, c double")
    one, many = (sorted(map(tuple, ml.silhouette_feature_pairs(df, "k", "l", list("abc"), b).collect())) for b in (1000, 9))
    assert [r[:2] for r in one] == [("a", "b"), ("a", "c"), ("b", "c")] == [r[:2] for r in many]
    assert all(abs(x[2] - y[2]) < 1e-12 for x, y in zip(one, many))
    pairs = ml.silhouette_feature_pairs(derived.features(spark, SF), "vec_id", "label", ml_features(spark))
    assert exchanges(pairs) <= 2  # points once to their tasks, then sums per subset


def ml_features(spark):
    return [c for c, k in derived.features(spark, SF).dtypes if k == "double"][:4]


def test_feature_pairs_keep_totals_of_one_class():
    """Points and columns in numpy against all distances; memory does not follow columns or classes."""
    import tracemalloc

    from cellmetry.operators import ml

    rng = np.random.default_rng(1)
    points, labels = rng.normal(size=(1200, 4)), np.sort(rng.integers(0, 40, 1200))
    mine = slice(300, 330)
    tracemalloc.start()
    scores = ml._PairScores(np.arange(30), labels[mine], np.ones(30, bool), points[mine])
    for c in range(0, 1200, 100):
        for label in np.unique(labels[c : c + 100]):
            scores.add(label, points[c : c + 100][labels[c : c + 100] == label])
    total, count = scores.scores()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == 30 and peak < 3 * 2 * 4 * ml.ROWS * ml.COLUMNS * 8
    for subset, (f, g) in enumerate(itertools.combinations(range(4), 2)):
        far = np.hypot(*(points[mine, None, x] - points[None, :, x] for x in (f, g)))
        sums = np.stack([far[:, labels == k].sum(1) for k in range(40)], 1)
        n, own = np.bincount(labels, minlength=40), np.arange(40) == labels[mine][:, None]
        a, b = (sums[own] / (n[labels[mine]] - 1)), np.where(own, np.inf, sums / n).min(1)
        assert abs(total[subset] - ((b - a) / np.maximum(a, b)).sum()) < 1e-9
