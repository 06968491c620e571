"""Fair mixing against a plain queue, and targets."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cellmetry.llm import mixing
from cellmetry.session import ship
from llm_fixtures import SF001, docs_frame


def plain_mix(rows, most=3):
    """Taken words per (doc_id, source, size), by one sorted list of finish times."""
    sized = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows]
    names = sorted({s for _, s, _ in sized}, key=lambda s: (s is None, s or ""))
    totals = Counter()
    for _, s, n in sized:
        totals[s] += n
    targets = dict(
        zip(names, mixing.fair_targets([totals[s] for s in names], [i % 3 + 1 for i in range(len(names))], sum(totals.values()), most))
    )
    key = lambda r: (hashlib.md5(f"7:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, r[2])
    queue = []
    for at, s in enumerate(names):
        sent = 0
        for r in sorted((r for r in sized if r[1] == s), key=key):
            sent += r[2]
            if r[2]:
                queue += [((k * totals[s] + sent) / targets[s], at, k, sent, r) for k in range(most)]
    taken, words = Counter(), 0
    for *_, r in sorted(queue, key=lambda q: q[:4]):
        words += r[2]
        if words > sum(totals.values()):
            break
        taken[r] += r[2]
    return taken, targets


def test_targets():
    assert mixing.fair_targets([10, 10, 10], [1, 2, 3], 30, 3) == [5.0, 10.0, 15.0]
    assert mixing.fair_targets([100, 1, 1], [1, 2, 3], 102, 3) == [96.0, 3.0, 3.0]
    assert mixing.fair_targets([0, 0], [1, 2], 0, 3) == [0.0, 0.0]
    assert mixing.fair_targets([], [], 0, 3) == []


@pytest.mark.parametrize("per_task", [None, 3])
def test_mix_is_the_plain_queue(spark, monkeypatch, per_task):
    ship(spark)
    if per_task:
        monkeypatch.setattr(mixing, "_per_task", lambda rows, least: per_task)
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    want, targets = plain_mix(rows)
    got = mixing.fair_mix(docs).collect()
    assert {r.doc_id: r.taken for r in got} == {
        i: want[(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t)))] for i, t, s in rows
    }
    words, longest = Counter(), defaultdict(int)
    for r in got:
        assert r.target == targets[r.source] and r.taken <= 3 * r.size
        words[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    assert all(abs(words[s] - t) <= 2 * max(longest.values()) for s, t in targets.items())
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    copies = Counter(r.doc_id for r in mixed.collect())
    assert copies == Counter({r.doc_id: r.taken // r.size for r in got if r.taken})


def test_edges_of_the_input(spark):
    ship(spark)
    rows = [(1, None, "a"), (2, "", None), (3, "x " * 300000, "b"), (4, "p q", None), (4, "p q", None),
            (None, "r s t", "a"), (None, "u v w", "a"), (6, "one", "é")]
    docs = docs_frame(spark, rows).withColumn("target", F.lit("t")).withColumn("s", F.lit("s"))
    docs = docs.withColumn("size", F.lit(0))
    got = mixing.fair_mix(docs).collect()
    want, _ = plain_mix(rows)
    assert len(got) == len(rows)
    assert sum(r.taken for r in got) == sum(want.values())
    assert {r.doc_id: r.taken for r in got if r.size == 0} == {1: 0, 2: 0}
    assert sorted(r.taken for r in got) == sorted(r.taken for r in mixing.fair_mix(docs).collect())
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = F.size(F.regexp_extract_all("text", F.lit("([^ ]+)")))
    assert mixed.agg(F.sum(words)).first()[0] == sum(want.values())
    assert mixing.fair_mix(docs.limit(0)).count() == 0
    assert mixing.mixed_documents(docs.limit(0)).count() == 0
