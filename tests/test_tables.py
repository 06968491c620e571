"""Ranking, splits, statistics, models and sinks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmetry.functions import names
from cellmetry.functions.solvers import chi_square_tail
from cellmetry.operators import ml, ranking, relational as rel, splits, stats
from cellmetry.session import shared_folder
from cellmetry.sources import derived, manifests, tables
from conftest import SF


@pytest.fixture(scope="module")
def rows(spark):
    """One class holds nine tenths of the rows."""
    return spark.range(1000).selectExpr("id as vec_id", "case when id % 10 = 0 then id % 3 else 7 end as label")


def test_split_sizes_are_exact(rows):
    counts = {
        (r["label"], r["part"]): r["count"]
        for r in splits.stratified_split(rows, "vec_id").groupBy("label", "part").count().collect()
    }
    assert counts[(7, "train")] == 630 and counts[(7, "val")] == 135 and counts[(7, "test")] == 135
    whole = {r["part"]: r["count"] for r in splits.random_split(rows, "vec_id").groupBy("part").count().collect()}
    assert whole == {"train": 700, "val": 150, "test": 150}
    with pytest.raises(ValueError):
        splits.random_split(rows, "vec_id", 0.9, 0.1)


def test_folds_are_disjoint_and_even(rows):
    folded = splits.stratified_kfold(rows, "vec_id")
    assert folded.count() == folded.select("vec_id").distinct().count() == 1000
    sizes = [r["count"] for r in folded.filter("label = 7").groupBy("fold").count().collect()]
    assert sizes == [180] * 5
    long = splits.kfold_expand(folded)
    assert long.filter("part = 'val'").count() == 1000 and long.count() == 5000


def test_row_numbers_over_range_partitions(spark):
    df = spark.range(500).selectExpr("500 - id as v")
    got = ranking.sorted_row_number(df, [F.col("v")], "n").collect()
    assert all(r["v"] == r["n"] for r in got) and len(got) == 500


def test_cumulative_counts_with_a_hot_value(spark):
    values = [0.0] * 700 + [float(k) for k in range(1, 301)]
    df = spark.createDataFrame([("f", v) for v in values], "feature string, value double")
    counts = df.groupBy("feature", "value").agg(F.count("*").alias("n"))
    got = {
        r["value"]: (r["before"], r["total"])
        for r in ranking.cumulative_counts(counts, ["feature"], "value", "n", "feature", 16).collect()
    }
    assert got[0.0] == (0, 1000) and got[1.0] == (700, 1000) and got[300.0] == (999, 1000)


def test_chi_square_tails(spark):
    df = spark.createDataFrame([(7.8147, 3), (5.9915, 2), (11.0705, 5), (9.4877, 4)], "x double, k int")
    for r in df.select(chi_square_tail("x", "k").alias("p")).collect():
        assert r["p"] == pytest.approx(0.05, abs=1e-5)


def test_constant_features_scale_to_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "a double, b double")
    assert [tuple(r) for r in stats.minmax_scale(df, ["a", "b"]).collect()] == [(0, 0), (0, 1)]
    assert [tuple(r) for r in stats.standard_scale(df, ["a", "b"]).collect()] == [(0, -1), (0, 1)]


def test_silhouette_does_not_depend_on_blocks(spark):
    df = derived.features(spark, SF)
    a = ml.silhouette(df, "vec_id", "label", names.BASE_FEATURES[:3]).first()[0]
    b = ml.silhouette(df, "vec_id", "label", names.BASE_FEATURES[:3], block=90).first()[0]
    assert a == pytest.approx(b, abs=1e-12) and -1 < a < 1


def test_labels_and_votes(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (1, 1), (0, 1), (None, 1)], "a int, b int")
    got = [r[0] for r in df.select(names.phenotype_label(F.col("a"), F.col("b"))).collect()]
    assert got == [0, 1, 2, 3, None]
    vote = spark.createDataFrame([(1, 1, 0), (0, 1, 0), (1, None, 1)], "a int, b int, c int")
    got = [r[0] for r in vote.select(names.majority_vote(*[F.col(c) for c in "abc"])).collect()]
    assert got == [1, 0, None]


def test_missing_keys_match_each_other(spark):
    a = spark.createDataFrame([(None, 1), ("i", 2)], "image string, n int")
    b = spark.createDataFrame([(None, 5), ("j", 6)], "name string, m int")
    assert [tuple(r) for r in rel.label_join(a, b, {"image": "name"}).collect()] == [(None, 1, 5)]


def test_sinks_and_file_listing(spark):
    path = shared_folder(spark, "t")
    crops = derived.embeddings(spark, SF).select(
        names.crop_name(F.col("image_name"), F.col("object_id")).alias("crop_name"),
        names.decode_label(F.col("label"), names.LABEL_FOLDERS).alias("label_name"),
    )
    tables.class_partition_sink(crops, path)
    back = spark.read.parquet(path)
    assert back.count() == 500
    one = back.filter("label_name = 'normal'")
    assert "PartitionFilters: [isnotnull(label_name" in one._jdf.queryExecution().toString()
    listed = manifests.list_files(spark, path, "*.parquet")
    assert {r[0].split("=")[-1] for r in listed.select("class_name").distinct().collect()} == set(
        names.LABEL_FOLDERS.values()
    )


def test_blacklist_file(spark, tmp_path):
    file = tmp_path / "reject.json"
    file.write_text('{"data_dict": {"img1.tif": [1, 2], "img2.tif": [3]}}')
    got = rel.blacklist_explode(tables.read_blacklist(spark, str(file))).collect()
    assert sorted(map(tuple, got)) == [("img1.tif", 1), ("img1.tif", 2), ("img2.tif", 3)]


def test_models(spark):
    df = derived.features(spark, SF)
    ratios = [r["ratio"] for r in ml.pca(df, names.BASE_FEATURES).collect()]
    assert ratios == sorted(ratios, reverse=True) and sum(ratios) < 1
    model, report = ml.decision_tree(df, names.BASE_FEATURES, "vec_id")
    parts = {r["part"]: r for r in report.collect()}
    assert parts["train"]["accuracy"] > parts["test"]["accuracy"] > 0
    total = ml.feature_importance(df, model, names.BASE_FEATURES).agg(F.sum("importance")).first()[0]
    assert math.isclose(total, 1.0, abs_tol=1e-6)
    clusters = ml.kmeans(df, names.CYTO_FEATURES, k=5, restarts=2)
    assert clusters.select("cluster").distinct().count() == 5


def test_kmeans_seeds_and_rounds_equal_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(m, 0.3, (60, 2)) for m in (0, 3, 9)] + [np.full((40, 2), 5.0)])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(v)], "id long, a double, b double")
    points = ml._cached_points(df, ["a", "b"])
    rows = points.collect()
    h, w = np.array([r.h for r in rows]), np.array([r.v for r in rows])
    seeds = ml.seeds_plus_plus(points, 4, 3, 42)
    for r, got in enumerate(seeds):
        want = []
        for step in range(4):
            weight = np.array([min((sum((x - c) ** 2) for c in want), default=1.0) for x in w])
            times = [d / m if m > 0 else np.inf for d, m in zip(ml.race_draws(h, 42 + r * 1009 + step), weight)]
            want.append(w[int(np.argmin(times))])
        assert (got == np.array(want)).all()
    cost, centres = ml._lloyd(points, [seeds[0]], 0.0)[0]
    want = seeds[0]
    for _ in range(100):
        own = ((w[:, None] - want) ** 2).sum(2).argmin(1)
        want = np.array([w[own == c].mean(0) if (own == c).any() else want[c] for c in range(4)])
    assert np.allclose(centres, want) and math.isclose(cost, ((w - want[own]) ** 2).sum(), rel_tol=1e-9)
    elbow = [r.inertia for r in ml.kmeans_elbow(df, ["a", "b"], 6, 4).collect()]
    assert elbow == sorted(elbow, reverse=True) and len(elbow) == 6
    first, again = (sorted(map(tuple, ml.kmeans(df, ["a", "b"], 4, 3).collect())) for _ in range(2))
    assert first == again and len({c for _i, c in first}) == 4
    few = df.filter("id >= 180")  # one point, forty times
    assert {r.cluster for r in ml.kmeans(few, ["a", "b"], 3, 2).collect()} == {0}
    assert ml.kmeans(df.limit(0), ["a", "b"]).count() == ml.kmeans_elbow(df.limit(0), ["a", "b"]).count() == 0


def test_kmeans_draws_follow_the_weights():
    times = ml.race_draws(np.arange(-20000, 20000), 7)
    assert abs(times.mean() - 1) < 0.02 and abs((times > 1).mean() - math.exp(-1)) < 0.01
