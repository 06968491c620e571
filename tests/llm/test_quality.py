"""The additive model: held-out accuracy, table sums and edges of the input."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from cellmetry.llm import quality
from cellmetry.session import ship
from llm_fixtures import SF01, docs_frame


def tables(spark):
    return (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))


def test_held_out_rows(spark):
    ship(spark)
    docs, labels = tables(spark)
    scores = quality.quality_scores(docs, quality.train_quality(docs, labels)).cache()
    rows = scores.collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = {r.truth: r for r in quality.held_out_accuracy(scores, labels, "quality").collect()}
    assert min(r.accuracy for r in held.values()) > 0.9
    good = quality.good_documents(docs, labels)
    assert good.columns == docs.columns
    assert good.count() == sum(r.predicted for r in rows)


def test_score_is_a_sum_of_table_entries():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, len(quality.FEATURES)))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality.fit_additive(x, y)
    assert ((model.scores(x) >= 0.5) == y).mean() > 0.9, "a pair of features decides"
    at = model.bins(x[:5])
    for row, logit in zip(at, model.logits(x[:5])):
        plain = model.bias + sum(t[b] for t, b in zip(model.tables, row))
        plain += sum(g[row[i], row[j]] for (i, j), g in zip(model.pairs, model.grids))
        assert abs(plain - logit) < 1e-9


def test_edges_of_the_input(spark):
    ship(spark)
    docs, labels = tables(spark)
    model = quality.train_quality(docs, labels)
    rows = [(1, None), (2, ""), (3, "word " * 200000), (4, "same"), (4, "same"), (None, "no id")]
    odd = docs_frame(spark, rows).withColumn("score", F.lit("x")).withColumn("y", F.lit(1))
    got = quality.quality_scores(odd, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 4}) == 1
    assert quality.quality_scores(odd.limit(0), model).count() == 0
    nothing = labels.limit(0)
    assert {r.score for r in quality.quality_scores(odd, quality.train_quality(docs, nothing)).collect()} == {0.5}
    assert quality.good_documents(odd, nothing).count() == len(rows)
    null = spark.createDataFrame([(None, 1, 0), (1, None, None), (2, 7, 0)], labels.schema)
    assert quality.good_documents(odd, null).columns == odd.columns


def test_rejected_text_of_a_repeated_id_goes(spark):
    ship(spark)
    docs, labels = (spark.read.parquet(f"{SF01}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.train_quality(docs, labels)
    scored = quality.quality_scores(docs, model).collect()
    bad = next(r.doc_id for r in scored if not r.predicted)
    good = next(r.doc_id for r in scored if r.predicted and r.held_out)  # never trained on
    again = docs.where(F.col("doc_id") == bad).withColumn("doc_id", F.lit(good))
    kept = quality.good_documents(docs.union(again), labels).where(F.col("doc_id") == good)
    assert [r.text for r in kept.collect()] == [docs.where(F.col("doc_id") == good).first().text]
