"""Words, near words and roots against brute force."""

import random
import re
import zlib
from collections import Counter

from cellmetry.llm import spelling
from cellmetry.llm.queries import QUERIES
from llm_fixtures import SF001, docs_frame

ASCII = {i: i + 32 for i in range(65, 91)}


def brute_counts(rows):
    words = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_near(counts):
    """Near words by all words with one code point left out or any replaced."""
    holes = {}
    for w in counts:
        for i in range(len(w)):
            holes.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    near = {w: set() for w in counts}
    for (left, right), words in holes.items():
        for w in words:
            near[w] |= words
            if left + right in counts:
                near[w].add(left + right)
                near[left + right].add(w)
    return {w: {x for x in found if x != w and one_edit(w, x)} for w, found in near.items()}


def brute(rows):
    counts = brute_counts(rows)
    near, forms = brute_near(counts), {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        form = forms[w]
        out.append((w, n, len(near[w]), form, counts.get(form), root))
    return sorted(out)


def as_rows(df):
    return sorted(map(tuple, df.select("word", "n", "n_near", "form", "form_n", "root").collect()))


def test_whole_table(spark):
    got = as_rows(QUERIES["op12_spelling_variants"](spark, SF001))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    want = brute(rows)
    assert got == want and any(w[3] for w in want)


def test_near_words_lose_no_pair(spark):
    rng, words = random.Random(4), set()
    while len(words) < 300:
        words.add("".join(rng.choice("abé") for _ in range(rng.randint(7, 9))))
    for w in list(words):
        at = rng.randrange(len(w))
        words |= {w[:at] + "ñ" + w[at:], w[:at] + "z" + w[at + 1 :], (w[:at] + w[at + 1 :]).ljust(7, "a")}
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    got = [(r.u, r.v) for r in spelling.near_words(df).collect()]
    want = {
        (a, b) for a in words for b in words if (len(a), a) < (len(b), b) and one_edit(a, b)
    }
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 900


def test_roots_follow_chains(spark):
    chain = ["aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb", "aaabbbb"]
    rows = [(w, 2 * 10**i, 1, chain[i + 1] if i < 4 else None) for i, w in enumerate(chain)]
    text = " ".join(" ".join([w] * n) for w, n, *_ in rows)
    got = {r.word: r for r in spelling.variants(docs_frame(spark, [(1, text)])).collect()}
    want = {w[0]: w for w in brute([(1, text)])}
    assert {w: tuple(r) for w, r in got.items()} == want
    assert got["aaaaaaa"].root == got["aaaabbb"].root


def test_edges(spark):
    rows = [(None, "WORDING wording"), (1, None), (2, ""), (3, "Étranger Étranger étranger étranger")]
    rows += [(4, "short " * 50 + "x" * 2_000 + " " + "x" * 2_000 + " y" * 500_000), (5, "ﬁrstly1 ﬁrstly ÿÿÿÿÿÿÿ×÷ ÿÿÿÿÿÿÿ×÷")]
    rows += [(6, "wording"), (6, "wording")]
    assert as_rows(spelling.variants(docs_frame(spark, rows))) == brute(rows)
    assert spelling.variants(docs_frame(spark, [])).count() == 0
    clash = docs_frame(spark, rows).selectExpr("*", "1 AS word", "2 AS n", "3 AS id", "4 AS run", "5 AS key")
    assert as_rows(spelling.variants(clash)) == brute(rows)
