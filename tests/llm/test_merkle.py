"""The manifest against a tree built node by node."""

import zlib
from hashlib import sha256

import pytest

from cellmetry.llm import merkle
from cellmetry.llm.queries import QUERIES
from llm_fixtures import DOCS, SF01


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    fields = []
    for value in (row.doc_id, row.source, row.lang, row.n_chars, text):
        fields.append("-" if value is None else f"{len(str(value).encode())}:{value}")
    return H(*fields)


def climb(nodes):
    """Root of a list of digests and the (left, right) siblings of each on its way."""
    ways, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for i, at in enumerate(place):
            run = runs[at // 8]
            ways[i].append((run[: at % 8], run[at % 8 + 1 :]))
            place[i] = at // 8
        nodes = [H(*run) for run in runs]
    return nodes[0], ways


def brute(rows):
    langs = {}
    for row in rows:
        langs.setdefault(row.lang, []).append((row.doc_id, leaf(row, row.text), row))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in order:
        known = sorted(langs[lang], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append((known, *climb([x[1] for x in known])))
    root, top = climb([t[1] for t in trees])
    out = []
    for (known, subroot, ways), above in zip(trees, top):
        for (doc_id, digest, row), way in zip(known, ways):
            node, text = digest, row.text
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and text is not None:
                node = leaf(row, text.translate({i: i + 32 for i in range(65, 91)}))
            proof = H(*(x for left, right in way + above for x in left + right))
            for left, right in way + above:
                node = H(*left, node, *right)
            out.append((doc_id, digest, subroot, root, proof, node, node == root))
    return out


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def check(spark, rows):
    df = spark.createDataFrame(rows, DOCS)
    got = merkle.verified(merkle.manifest(df))
    assert as_rows(got) == sorted(brute(df.collect()), key=repr)


def test_whole_table(spark):
    got = QUERIES["op13_merkle_manifest"](spark, SF01)
    want = brute(spark.read.parquet(f"{SF01}/documents.parquet").collect())
    assert as_rows(got) == sorted(want, key=repr)
    assert {w[-1] for w in want} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 520])
def test_sizes_of_one_language(spark, n):
    check(spark, [(i, f"Text {i}", "en", "s", 6) for i in range(n)])


def test_languages_of_many_sizes(spark):
    rows = [(i, "A", f"l{i}", "s", 1) for i in range(75)]  # every language a lone leaf
    check(spark, rows)
    rows += [(1000 + i, "Bc", None, None, None) for i in range(70)]
    rows += [(2000 + i, None, "é", "s", 1) for i in range(9)]
    check(spark, rows)


def test_nulls_ties_and_shuffled_rounds(spark, monkeypatch):
    rows = [(7, "X", "en", "s", 1)] * 3 + [(7, "Y", "en", None, 1), (None, "Z", "en", "s", None)]
    rows += [(8, "", "", "", 0), (9, None, "", "", 0), (10, "Ä" * 100_000, "en", "s", 1)]
    monkeypatch.setattr(merkle, "MAX_SEGMENT_BYTES", -1)
    check(spark, rows + [(i, "q", "en", "s", 1) for i in range(100, 190)])


def test_empty_and_clashing_columns(spark):
    docs = spark.createDataFrame([], DOCS)
    assert merkle.verified(merkle.manifest(docs)).count() == 0
    more = "doc_id long, text string, lang string, source string, n_chars long, tree long, idx long, leaf string"
    rows = [(1, "A", "en", "s", 1, 5, 5, "x"), (2, "B", "de", "s", 1, 5, 5, "y")]
    got = merkle.verified(merkle.manifest(spark.createDataFrame(rows, more)))
    assert as_rows(got) == sorted(brute(spark.createDataFrame([r[:5] for r in rows], DOCS).collect()), key=repr)
