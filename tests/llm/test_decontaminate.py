"""Contained benchmark items against brute force."""

import re

from pyspark.sql import functions as F

from cellmetry.llm import decontaminate
from cellmetry.session import ship
from llm_fixtures import SF01, docs_frame


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    if len(w) < 5:
        return {" ".join(w)} if w else set()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs, items, least=0.8):
    found = set()
    sets = [(i, shingles(t)) for i, t in items]
    for d, text in docs:
        have = shingles(text)
        for i, s in sets:
            if s and len(s & have) >= least * len(s) - 1e-9:
                found.add((d, i, len(s), len(s & have)))
    return found


def test_finds_what_brute_force_finds(spark):
    docs, items = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "benchmark"))
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    wanted = [(r.item_id, r.text) for r in items.collect()]
    # Parts of items around the limit, in the middle of a document.
    for n, (i, t) in enumerate(wanted):
        words = t.split()
        keep = int(len(words) * (0.7 + 0.02 * (n % 15)))
        texts.append((100_000 + i, "before it " * 300 + " ".join(words[:keep]).upper() + " after it" * 300))
    got = decontaminate.contained_items(docs_frame(spark, texts), items).drop("text_hash")
    want = brute(texts, wanted)
    assert len(want) > 40 and {tuple(r) for r in got.collect()} == want
    clean = decontaminate.without_items(docs, items)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in texts if d < 100_000} - {d for d, *_ in want}


def test_plan_runs_no_python(spark):
    docs, items = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = decontaminate.without_items(docs, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan


def test_large_sketches_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr("cellmetry.llm.common.MAX_BROADCAST_ROWS", 1)
    rows = [(1, "a b c d e f g"), (2, "x y z")]
    items = spark.createDataFrame([(9, "b c d e f")], "item_id long, text string")
    got = decontaminate.contained_items(docs_frame(spark, rows), items).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 9)]


def test_edges_of_the_input(spark):
    leak = "one two three four five six seven"
    rows = [(1, None), (2, ""), (3, "filler words " * 100000 + leak), (4, leak), (4, leak), (4, "clean text here"),
            (None, leak), (None, "a clean text without an id"), (5, "Few, WORDS")]
    items = spark.createDataFrame(
        [(1, leak), (1, leak), (2, None), (3, ""), (None, leak + " eight"), (4, "few words")],
        "item_id long, text string",
    ).withColumn("doc_id", F.lit(3))
    docs = docs_frame(spark, rows).withColumn("h", F.lit(1)).withColumn("item_key", F.lit(1))
    got = decontaminate.contained_items(docs, items).drop("text_hash").collect()
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(map(key, got)) == [(-1, 1, 3, 3), (3, 1, 3, 3), (4, 1, 3, 3), (5, 4, 1, 1)]
    kept = decontaminate.without_items(docs, items)
    assert kept.columns == docs.columns
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in kept.collect()) == [
        (-1, "a clean text without an id"), (1, None), (2, ""), (4, "clean text here")
    ]
    assert decontaminate.contained_items(docs.limit(0), items).count() == 0
    assert decontaminate.without_items(docs, items.limit(0)).count() == len(rows)
