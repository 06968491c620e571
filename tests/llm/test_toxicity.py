"""The recurrent network: gradients, windows, held-out accuracy and edges of the input."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from cellmetry.llm import toxicity
from cellmetry.llm.quality import held_out_accuracy
from cellmetry.session import ship
from llm_fixtures import SF01, docs_frame


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network.start({"a": 1, "bb": 2}, rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words, y = ["a", "bb", "ccc", "dddd"], np.array([1.0, 0.0, 1.0])
    at = np.array([[1, 2, 3, 0, 0], [4, 3, 2, 1, 1], [2, 2, 0, 0, 0]])

    def loss():
        logit = net.window_logits(words, at)
        return float(np.mean((np.log1p(np.exp(logit)) - y * logit) * np.where(y, 2, 1)))

    got = net.gradients(words, at, y, 2)
    for k, v in net.p.items():
        rows = {"char": toxicity.trigram_rows(words)[0][:4], "word": range(3)}.get(k, range(min(4, len(v))))
        for row in rows:
            i = (int(row),) + (1,) * (v.ndim - 1)
            v[i] += 1e-3
            high = loss()
            v[i] -= 2e-3
            low = loss()
            v[i] += 1e-3
            assert abs((high - low) / 2e-3 - got[k][i]) < 1e-4 + 0.02 * abs(got[k][i]), (k, i)


def test_windows_cover_all_words():
    rows = [np.arange(1, n + 1, dtype=np.int32) for n in (0, 1, 32, 33, 56, 57, 1000)]
    at, first = toxicity.windows(rows)
    ends = [*first[1:], len(at)]
    for r, a, b in zip(rows, first, ends):
        assert set(at[a:b].ravel()) - {0} == set(r.tolist())
        for one, two in zip(at[a:b], at[a + 1 : b]):
            assert (one[toxicity.STRIDE :] == two[: toxicity.WINDOW - toxicity.STRIDE]).all()


def test_trigrams():
    grams, first = toxicity.trigram_rows(["abc", "é", "x"])
    assert first.tolist() == [0, 3, 5] and len(grams) == 6
    assert (toxicity.trigram_rows(["abc"])[0] == grams[:3]).all()


def test_learns_stems_and_whole_texts(spark):
    ship(spark)
    rng = np.random.default_rng(3)
    plain = ["".join(rng.choice(list("aeioulmnrst"), 5)) for _ in range(300)]
    texts, labels = [], []
    for i in range(500):
        words = rng.choice(plain, rng.integers(20, 300)).tolist()
        if i % 5 == 0:
            for _ in range(3):
                words.insert(int(rng.integers(0, len(words))), "zorg" + rng.choice(["ak", "ek", "ik", "ok", "uk"]))
        texts.append(" ".join(words))
        labels.append(int(i % 5 == 0))
    docs = docs_frame(spark, list(enumerate(texts)))
    truth = spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)], "doc_id long, quality int, toxic int")
    network = toxicity.train_toxicity(docs, truth)
    scores = toxicity.toxicity_scores(docs, network)
    held = {r.truth: r.accuracy for r in held_out_accuracy(scores, truth, "toxic").collect()}
    assert held[1] >= 0.9 and held[0] >= 0.95
    late = " ".join(plain * 20) + " zorgak zorgxx zorgek"
    score = toxicity.Scorer(network).scores([late, " ".join(plain * 20), "a zorgyy b"])
    assert score[0] >= 0.5 > score[1] and score[2] >= 0.5


def test_edges_of_the_input(spark):
    ship(spark)
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    network = toxicity.train_toxicity(docs.limit(200), labels)
    rows = [(1, None), (2, ""), (3, "word " * 200000), (4, "same"), (4, "same"), (None, "no id"), (6, " \t\n")]
    odd = docs_frame(spark, rows).withColumn("score", F.lit("x")).withColumn("y", F.lit(1))
    got = toxicity.toxicity_scores(odd, network).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 6)}) == 1
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0) for r in got)
    assert toxicity.toxicity_scores(odd.limit(0), network).count() == 0
    none = toxicity.train_toxicity(odd, labels.limit(0))
    assert {r.score for r in toxicity.toxicity_scores(odd, none).collect()} == {0.5}
    one = toxicity.train_toxicity(docs, labels.where("toxic = 0"))
    assert max(r.score for r in toxicity.toxicity_scores(odd, one).collect()) < 0.1
