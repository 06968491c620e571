"""Registered queries against their check SQL."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from conftest import SF

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
# Quick ones run with the tests; the driver compares every query.
QUICK = [
    "annotator_join",
    "blacklist_anti_join",
    "class_manifest",
    "classification_report",
    "contour_min_distance",
    "crop_label_lookup",
    "dedup_keep_first",
    "ellipse_features",
    "feature_quantiles",
    "kruskal_wallis",
    "nucleus_parent_join",
    "object_id",
    "pair_consistency",
    "pairwise_ordered",
    "segmentation_metrics",
    "stratified_split",
    "tied_ranks",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    result = duck.execute(oracle_sql()[name])
    order = [c[0] for c in result.description]
    assert sorted(order) == columns
    at = [order.index(c) for c in columns]
    want = sorted(repr(tuple(r[i] for i in at)) for r in result.fetchall())
    assert got == want


def test_every_check_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    rows = entry(spark).collect()
    assert sum(r["n_cells"] for r in rows) > 0
    assert {r["label"] for r in rows} <= {None, 0, 1, 2, 3}
