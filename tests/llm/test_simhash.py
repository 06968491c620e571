"""Golay keys, fingerprints and groups against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmetry.llm import simhash
from cellmetry.llm.common import components
from cellmetry.session import ship
from llm_fixtures import SF001, docs_frame


def brute_components(prints):
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    root = np.arange(len(prints))
    while True:
        low = np.array([root[row].min() for row in near])
        if (low == root).all():
            return root
        root = low


def test_golay_code_is_perfect():
    code, nearest, triples, around = simhash.golay()
    assert len(np.unique(code)) == 4096 and np.bitwise_count(code[1:]).min() == 7
    words = np.arange(1 << 23)
    assert np.bitwise_count(words ^ code[nearest]).max() == 3
    assert around.shape == (1771, 5) and len(triples) == 1771


def test_words_one_bit_apart_meet():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 5000)
    y = x ^ (1 << rng.integers(0, 23, 5000))
    found, valid = simhash.code_indices(x)
    first = simhash.code_indices(y)[0][:, :1]
    assert ((found == first) & valid).any(1).all()


@pytest.mark.parametrize("flips", [1, 2, 3])
def test_links_lose_no_pair(spark, flips):
    ship(spark)
    rng = np.random.default_rng(flips)
    base = rng.integers(0, 1 << 63, 300, dtype=np.int64).astype(np.uint64)
    twin = base.copy()
    for i in range(len(base)):
        for bit in rng.choice(64, flips, replace=False):
            twin[i] ^= np.uint64(1) << np.uint64(bit)
    prints = np.unique(np.concatenate([base, twin]))
    df = spark.createDataFrame([(int(v),) for v in prints.view(np.int64)], "fp long")
    got = {(r.u, r.v) for r in simhash.fingerprint_links(df).collect()}
    near = np.bitwise_count(prints[:, None] ^ prints[None, :])
    signed = prints.view(np.int64)
    want = {
        tuple(sorted((int(signed[i]), int(signed[j]))))
        for i, j in zip(*np.nonzero((near <= 3) & (near > 0)))
    }
    assert len(got) >= 300 and got == want


def test_hash_is_the_engines(spark):
    texts = ["", "a", "one two three", "é" * 40, "word " * 20]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t"))
    ours = [simhash.xxhash.xxh64_intdigest(t, 42) for t in texts]
    assert [r[0] % (1 << 64) for r in df.collect()] == ours


def test_groups_match_brute_force(spark):
    ship(spark)
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    prints = np.array([simhash.fingerprint(r.text) for r in rows], np.uint64)
    root = brute_components(prints)
    want = {
        rows[i].doc_id: (f"{int(prints[i]):016x}", rows[root[i]].doc_id) for i in range(len(rows))
    }
    got = simhash.simhash_groups(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want
    kept = simhash.near_duplicates_removed(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids) == sorted({c for _, c in want.values()})


def test_edges_of_the_input(spark):
    ship(spark)
    long = "alpha beta gamma delta " * 30000
    rows = [(4, None), (2, ""), (9, " \t"), (7, long), (5, long), (5, long), (None, "x y z"), (3, "X Y Z")]
    docs = docs_frame(spark, rows).withColumn("component_id", F.lit(1)).withColumn("fp", F.lit(2))
    got = sorted(
        (r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id)
        for r in simhash.simhash_groups(docs).collect()
    )
    zero = "0" * 16
    assert [(i, c) for i, f, c in got if f == zero] == [(2, 2), (4, 2), (9, 2)]
    assert [(i, c) for i, f, c in got if f != zero] == [(-1, 3), (3, 3), (5, 5), (5, 5), (7, 5)]
    kept = simhash.near_duplicates_removed(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "5", "None"]
    empty = docs.limit(0)
    assert simhash.simhash_groups(empty).count() == 0
    assert simhash.near_duplicates_removed(empty).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u long, v long")
    got = {(r.node, r.component) for r in components(links).collect()}
    assert got == {(i, 0) for i in range(1, 61)} | {(101, 100)}
