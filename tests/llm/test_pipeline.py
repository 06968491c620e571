"""The pipeline's stages one by one against brute force, and its whole run."""

import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cellmetry.llm import quality
from llm_fixtures import SF01
from test_decontaminate import brute
from test_mixing import plain_mix
from test_near_copies import brute_kept


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """The input and the output of every stage, as the check writes and reads them."""
    at = tmp_path_factory.mktemp("stages")
    tables = [spark.read.parquet(f"{SF01}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], SF01).write.parquet(f"{at}/{k}")
        tables.append(spark.read.parquet(f"{at}/{k}"))
    return tables


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_columns(written):
    assert all(t.columns == written[0].columns for t in written[:-1])
    assert written[-1].columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_quality_stage(spark, written):
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    scores = quality.quality_scores(written[0], quality.train_quality(written[0], labels))
    assert ids(written[1]) == Counter(r.doc_id for r in scores.collect() if r.predicted)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    kept = ids(written[1])
    good = [i for i, q in truth.items() if q == 1 and i in ids(written[0])]
    assert np.mean([i in kept for i in good]) > 0.95


def test_near_duplicate_stage(written):
    """Five words and a similarity of 0.8, as stages on word shingles have it."""
    rows = sorted((r.doc_id, r.text) for r in written[1].collect())
    want = brute_kept(rows)
    assert ids(written[2]) == want and sum(want.values()) < len(rows)


def test_decontamination_stage(spark, written):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF01}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in written[2].collect()]
    leaks = {d for d, *_ in brute(docs, items)}
    assert leaks and ids(written[3]) == Counter(d for d, _ in docs if d not in leaks)


def test_mixing_stage(written):
    rows = [(r.doc_id, r.text, r.source) for r in written[3].collect()]
    taken, _ = plain_mix(rows)
    want = Counter({d: n // size for (d, _, size), n in taken.items()})
    assert ids(written[4]) == +want and max(want.values()) > 1


def test_token_stage(written):
    tokenizer, start, want = Tokenizer.from_file(corpus_pipeline.TOKENIZER), 0, []
    for r in sorted(written[4].collect(), key=lambda r: r.doc_id):
        data = np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        want.append((r.doc_id, start, len(data), zlib.crc32(data.tobytes())))
        start += len(data)
    assert sorted(map(tuple, written[5].collect())) == want


def test_whole_run_and_empty_input(spark, written):
    assert ids(corpus_pipeline.run(spark, SF01)) == ids(written[5])
    docs = written[0].limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF01)
        assert docs.columns == written[0].columns and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF01).count() == 0
