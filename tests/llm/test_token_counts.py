"""Token counts against a plain search over whole pre-tokens."""

import math

import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

from cellmetry.llm import token_counts
from cellmetry.session import ship
from llm_fixtures import SF001, docs_frame

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = token_counts.read_ranks(RANKS)


def plain(text, scores, longest):
    """(pre-tokens, pieces) of a text, each pre-token by a dynamic program of its own."""
    words, total = regex.findall(public_tokenizers.PATTERN, text or ""), 0
    for word in (w.encode() for w in words):
        best = [(0.0, 0)]
        for d in range(1, len(word) + 1):
            options = [
                (best[s][0] + scores[word[s:d]], -s, best[s][1] + 1)
                for s in range(max(0, d - longest), d)
                if word[s:d] in scores
            ]
            top = max(options, key=lambda o: (o[0], o[1]))
            best.append((top[0], top[2]))
        total += best[-1][1]
    return len(words), total


def expected(rows):
    trie = token_counts.UnigramTrie(PIECES)
    return sorted((-1 if i is None else i, *plain(t, trie.scores, trie.longest)) for i, t in rows)


def got(docs):
    found = token_counts.count_tokens(docs, RANKS, public_tokenizers.PATTERN)
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_pretokens, r.n_tokens) for r in found.collect())


def test_documents(spark):
    ship(spark)
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    assert got(docs) == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_prefixes_are_scored_once():
    trie = token_counts.UnigramTrie(PIECES)
    words = sorted({b"undo", b"undone", b"under", b"und", b"over", b"overdone"})
    assert trie.counts(words) == [trie.counts([w])[0] for w in words]
    trie.nodes = 0
    trie.counts(words)
    assert trie.nodes == len({w[:d] for w in words for d in range(1, len(w) + 1)})
    assert math.isclose(math.fsum(map(math.exp, trie.scores.values())), 1)


@pytest.mark.parametrize(
    "text", ["", " ", "a  b", " a b ", "a \n b\tc", "it's we'll 'd", "x\u00a0y \u3000z", "a\x1c b", "\n\nab c\n", "ab \n"]
)
def test_cut_texts_count_like_whole_ones(text):
    counter = token_counts.Counter(RANKS, public_tokenizers.PATTERN)
    n = counter.texts([text, "other text", text])
    want = plain(text, counter.trie.scores, counter.trie.longest)
    assert (n[0] >> 32, n[0] & (2**32 - 1)) == want and n[0] == n[2]


def test_small_caches_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_SEEN", 3)
    counter = token_counts.Counter(RANKS, public_tokenizers.PATTERN)
    text = "internationalisation of everything everywhere and of everything else"
    assert counter.texts([text]) == counter.texts([text]) == counter.texts(["x y z", text])[1:]


def test_edges_of_the_input(spark):
    ship(spark)
    rows = [(1, None), (2, ""), (3, "x" * 5000 + " long " * 30000), (4, "same  text\n"), (4, "same  text\n"),
            (None, "é😀  ç\t\n"), (6, " lead and trail ")]
    docs = docs_frame(spark, rows).withColumn("n_tokens", F.lit("x"))
    assert got(docs) == expected(rows)
    assert got(docs.limit(0)) == []
