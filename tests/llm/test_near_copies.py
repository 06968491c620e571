"""Near-copies against brute-force Jaccard similarities of five-word shingles."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmetry.llm import near_copies, simhash
from cellmetry.llm.common import LOWER_ASCII, WORD
from cellmetry.session import ship
from llm_fixtures import SF01, docs_frame


def plain_set(text):
    words = re.findall(WORD, (text or "").translate(LOWER_ASCII))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    """Smallest (id, row) of each component of rows (id, text) with similarity >= 0.8."""
    sets = [plain_set(t) for _, t in rows]
    root, held = list(range(len(rows))), {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        met = Counter(j for x in s for j in held.get(x, ()))
        for j, both in [*met.items(), *((j, 0) for j in range(i) if not s and not sets[j])]:
            if 5 * both >= 4 * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
        for x in s:
            held.setdefault(x, []).append(i)
    first = {}
    for i, (doc, _) in enumerate(rows):
        first[find(i)] = min(first.get(find(i), doc), doc)
    return Counter(first.values())


def kept_ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def varied(words, n, rng, vocabulary):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = rng.choice(vocabulary)
    return " ".join(words)


@pytest.fixture(scope="module")
def vocabulary():
    return [f"w{i}" for i in range(3000)]


def test_given_documents(spark):
    ship(spark)
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = near_copies.near_copies_removed(docs)
    assert kept.columns == docs.columns
    assert kept_ids(kept) == brute_kept(rows)


def test_copies_beyond_three_bits_leave_and_unlike_texts_stay(spark, vocabulary):
    ship(spark)
    rng = random.Random(3)
    rows = []
    for i in range(60):
        words = rng.choices(vocabulary, k=300)
        rows.append((3 * i, " ".join(words)))
        rows.append((3 * i + 1, varied(words, rng.choice((4, 5, 6)), rng, vocabulary)))
        rows.append((3 * i + 2, varied(words, 12, rng, vocabulary)))
    bits = [(simhash.fingerprint(rows[i][1]) ^ simhash.fingerprint(rows[i + 1][1])).bit_count() for i in range(0, 180, 3)]
    assert sum(b > 3 for b in bits) > 10
    want = brute_kept(rows)
    assert 60 < sum(want.values()) < 140
    assert kept_ids(near_copies.near_copies_removed(docs_frame(spark, rows))) == want


def test_large_groups_by_pivots(spark, vocabulary, monkeypatch):
    ship(spark)
    rng = random.Random(4)
    words = rng.choices(vocabulary, k=200)
    rows = [(i, varied(words, rng.choice((0, 1, 2, 3, 5)), rng, vocabulary)) for i in range(200)]
    rows += [(i, " ".join(rng.choices(vocabulary, k=40))) for i in range(200, 230)]
    monkeypatch.setattr(near_copies, "PAIRS_PER_ROW", 0.01)
    assert kept_ids(near_copies.near_copies_removed(docs_frame(spark, rows))) == brute_kept(rows)


def test_bands_of_similar_sets(spark):
    rng, missed = np.random.default_rng(5), 0
    for _ in range(300):
        a = rng.integers(0, 1 << 64, 180, dtype=np.uint64)
        b = np.concatenate([a[:160], rng.integers(0, 1 << 64, 20, dtype=np.uint64)])
        missed += not (near_copies.band_keys(a) == near_copies.band_keys(b)).any()
    assert missed == 0


def test_edges_of_the_input(spark):
    ship(spark)
    long = "alpha beta gamma delta " * 30000
    rows = [(4, None), (2, ""), (9, " \t"), (7, long), (5, long), (5, long), (None, "x y z"), (3, "X Y Z"),
            (11, "one two"), (11, "quite another text of more than five words"), (12, "ONE  two")]
    docs = docs_frame(spark, rows).withColumn("node", F.lit(1)).withColumn("key", F.lit(2))
    kept = near_copies.near_copies_removed(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["11", "11", "2", "3", "5", "None"]
    assert near_copies.near_copies_removed(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        near_copies.near_copies_removed(docs, 0.7)


def test_repeated_id_with_other_text(spark, vocabulary):
    ship(spark)
    rng = random.Random(6)
    one, two, three = (" ".join(rng.choices(vocabulary, k=60)) for _ in range(3))
    rows = [(1, one), (7, two), (7, one), (7, three), (7, three), (9, two)]
    for removed in (near_copies.near_copies_removed, simhash.near_duplicates_removed):
        kept = removed(docs_frame(spark, rows)).collect()
        assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, one), (7, two), (7, three)])


def passage_pairs(spark, n, rng, vocabulary):
    """Rows of n unlike texts around one passage, and the pairs that are compared at last."""
    passage = " ".join(rng.choices(vocabulary, k=100))
    rows = [(i, passage + " " + " ".join(rng.choices(vocabulary, k=60))) for i in range(n)]
    rows += [(n + i, rows[i][1] + " extra") for i in range(20)]
    sets = [near_copies.shingle_set(t) for _, t in rows]
    nodes = [(i, len(s), i, True) for i, s in enumerate(sets)]
    pairs = near_copies._by_prefix(
        spark.createDataFrame(nodes, "node long, n int, group long, left boolean"),
        near_copies._sets(spark.createDataFrame(rows, "node long, text string")),
        0.8,
    )
    return rows, [(r.u, r.v) for r in pairs.collect()]


def test_texts_around_one_passage_do_not_all_meet(spark, vocabulary):
    ship(spark)
    rng, found = random.Random(8), []
    for n in (150, 300):
        rows, pairs = passage_pairs(spark, n, rng, vocabulary)
        assert {(i, n + i) for i in range(20)} <= set(pairs)
        found.append(len(pairs))
    assert found == [20, 20]  # of 11,175 and 44,850
    kept = near_copies.near_copies_removed(docs_frame(spark, rows))
    assert kept_ids(kept) == brute_kept(rows) and kept.count() == 300


def test_parities_differ_in_no_more_bits_than_sets(vocabulary):
    rng = random.Random(10)
    for n in (0, 1, 5, 80, 3000):
        words = rng.choices(vocabulary, k=n)
        a, b = (near_copies.shingle_set(t) for t in (" ".join(words), varied(words, n // 5, rng, vocabulary)))
        x, y = (near_copies.parities(s).view(np.uint64) for s in (a, b))
        assert len(x) == near_copies.PARITIES
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_prefixes_lose_no_similar_pair(spark, vocabulary):
    ship(spark)
    rng = random.Random(9)
    base = [rng.choices(vocabulary, k=rng.randint(6, 60)) for _ in range(60)]
    rows = [(i, varied(w, rng.randint(0, 2), rng, vocabulary)) for i, w in enumerate(base * 4)]
    sets = {i: near_copies.shingle_set(t) for i, t in rows}
    nodes = [(i, len(s), i, True) for i, s in sets.items()]
    sets_df = near_copies._sets(spark.createDataFrame(rows, "node long, text string"))
    nodes_df = spark.createDataFrame(nodes, "node long, n int, group long, left boolean")
    pairs = near_copies._by_prefix(nodes_df, sets_df, 0.8)
    got = {(r.u, r.v) for r in near_copies._verified(pairs, sets_df, 0.8).collect()}
    want = set()
    for i, a in sets.items():
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if 5 * both >= 4 * (len(a) + len(sets[j]) - both):
                want.add((j, i))
    assert got == want and len(want) > 60


def test_fingerprints_within_three_bits_are_compared(spark):
    """Each node is paired by the Golay keys with one near it, and these pairs alone make links."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 40)
    prints = [int(b) for b in base]
    prints += [int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base[:30] for i, j in [rng.choice(62, 2, False)]]
    prints += [int(b) for b in base[:5]]
    nodes = spark.createDataFrame([(k, 10, p) for k, p in enumerate(prints)], "node long, n int, fp long")
    got = {tuple(r) for r in near_copies._fuzzy_pairs(nodes, 0.8).collect()}
    every = {
        (a, b) for a in range(len(prints)) for b in range(a + 1, len(prints)) if (prints[a] ^ prints[b]).bit_count() <= 3
    }
    assert got <= every and {k for p in got for k in p} == {k for p in every for k in p}
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words), " ".join([*words[:199], "end"]), " ".join(f"x{i}" for i in range(50))]
    sets = near_copies._sets(spark.createDataFrame(list(enumerate(texts)), "node long, text string"))
    bare = spark.createDataFrame([(k, 196, []) for k in range(3)], "node long, n int, keys array<long>")
    near = spark.createDataFrame([(0, 1), (0, 2)], "u long, v long")
    assert {tuple(r) for r in near_copies._components(bare, sets, 0.8, near).collect()} == {(1, 0)}


def test_fingerprint_of_a_set():
    hashes = near_copies.shingle_set("a b c d e f g h")
    bits = [sum(int(h) >> i & 1 for h in hashes) * 2 > len(hashes) for i in range(64)]
    assert near_copies.set_fingerprint(hashes) % (1 << 64) == sum(b << i for i, b in enumerate(bits))
    assert near_copies.set_fingerprint(hashes[:0]) == 0
