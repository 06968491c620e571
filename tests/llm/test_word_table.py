"""Ids and decoded texts against the tokenizers library itself."""

from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cellmetry.llm import word_table
from cellmetry.llm.queries import QUERIES
from cellmetry.session import ship
from llm_fixtures import SF01, docs_frame

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ODD = ["J̌", "İ", "Σίσυφος ΣΑΣ", "<|endoftext|>", "<|STARTOFTEXT|>", "a<|startoftext|>b,c", "'s", "it'S", "a\"'s",
       " x y", "\x1c", "́", "é", "(\"word\")", "K", "A.B;c:d!e?f", "퟿", "日本語です", "🙂🙂", "1234",
       "!!!'s", "a\x0bb\x0cc", "\u0085", "x≮y", "À,", "ﬁ", "'", "don't", "'ll", "\t\n\r "]


def whole(text):
    ids = TOKENIZER.encode(text or "", add_special_tokens=False).ids
    return ids, TOKENIZER.decode(ids, skip_special_tokens=False)


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=6), st.sampled_from(" ,.;:!?()\"'ab'sZ<|>")), max_size=12))
def test_words_give_the_ids_of_the_text(parts):
    text = "".join(parts)
    index = word_table.BlockWords()
    codes = np.frombuffer(index.code(text), np.uint32)
    words = list(index.words)
    ids = [i for c in codes for i in whole(words[c])[0]]
    assert ids == whole(text)[0]


def test_whole_table(spark):
    ship(spark)
    got = {r.doc_id: r for r in QUERIES["op11_word_table_bpe"](spark, SF01).collect()}
    docs = spark.read.parquet(f"{SF01}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids, text = whole(r.text)
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("block_words", [1, 50, 1_000_000])
def test_edges(spark, block_words):
    ship(spark)
    rows = [(None, "no id"), (1, None), (2, ""), (3, " \n "), (4, "\u0085 a \u0085"), (5, "same"), (5, "same")]
    rows += [(6, "word, " * 100_000), (7, "z" * 20_000)] + [(10 + i, t) for i, t in enumerate(ODD)]
    docs = docs_frame(spark, rows).selectExpr("*", "1 AS block", "'p' AS path", "2 AS at", "'w' AS word", "3 AS ids")
    encoded = word_table.encode_documents(docs, PATH, block_words=block_words)
    got = word_table.decode_ids(encoded, PATH).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    want = sorted(((i, *whole(t)) for i, t in rows), key=key)
    assert [tuple(r) for r in sorted(got, key=key)] == want


def test_empty_tables(spark):
    ship(spark)
    assert word_table.encode_documents(docs_frame(spark, []), PATH).count() == 0
    got = word_table.encode_documents(docs_frame(spark, [(1, ""), (2, None)]), PATH).collect()
    assert sorted(map(tuple, got)) == [(1, []), (2, [])]


def test_decode_of_given_ids(spark):
    rows = [(1, [49406, 320, 0, 49407]), (2, []), (3, None), (4, [320, 10**6])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in word_table.decode_ids(df, PATH).collect()}
    assert got == {i: TOKENIZER.decode(ids or [], skip_special_tokens=False) for i, ids in rows}
