"""Token files against encoding whole texts, and random access."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cellmetry.llm import token_file
from cellmetry.session import ship
from llm_fixtures import SF001, docs_frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(rows):
    tokenizer, start, want = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return want


def read(spark, docs, **how):
    manifest = token_file.write_tokens(docs, PATH, **how)
    return manifest, [tuple(r) for r in token_file.read_documents(manifest).collect()]


@pytest.mark.parametrize(
    "text",
    ["", " ", "a  b", " a b ", "a \n b\tc", "it's we'll 'd", "x  y 　z", "a\x1c b \x1f c",
     "12 34 5, 6!! ?", "<|endoftext|> a<|endoftext|>b", "né  \r\n\r\n  ça", "a​ b", "퟿ 1 a1 1a"],
)
def test_pieces_give_the_ids_of_the_whole_text(text):
    whole = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert token_file.CachedEncoder(PATH).encode([text])[0].tolist() == whole


def test_a_small_cache_changes_nothing():
    encoder, whole = token_file.CachedEncoder(PATH, 4), Tokenizer.from_file(PATH)
    for text in ("one two three", "two three four five", "two six", "three  two one", "two two seven"):
        ids = whole.encode(text, add_special_tokens=False).ids
        assert encoder.encode([text, "two"])[0].tolist() == ids


def test_files_hold_all_documents(spark):
    ship(spark)
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    manifest, got = read(spark, docs, docs_per_shard=30, sequence=64, batch=8)
    assert manifest.count() > 3
    assert sorted(got) == expected(rows)


def test_random_access(spark):
    ship(spark)
    docs = docs_frame(spark, [(i, f"text number {i} " * i) for i in range(40)])
    manifest, got = read(spark, docs, docs_per_shard=15, sequence=16, batch=4)
    shards = manifest.orderBy("shard").collect()
    files = [token_file.SequenceFile(s.tokens) for s in shards]
    for s, f in zip(shards, files):
        both = [f[i] for i in range(len(f))]
        assert all(x.shape == (16,) and not x.flags.owndata for pair in both for x in pair)
        assert all(m.dtype == np.uint8 for _, m in both)
        assert sum(int(m.sum()) for _, m in both) == s.n_tokens
    tokens, _ = token_file.sequence_at([s.tokens for s in shards], list(map(len, files)), len(files[0]))
    assert (tokens == files[1][0][0]).all()


@pytest.mark.parametrize("n", [1, 63, 64, 65, 2048, 2049, 4095])
def test_masks_take_a_byte_per_sequence(tmp_path, n):
    """Two bytes a token and little else, whether or not the shard ends in padding."""
    writer = token_file._ShardWriter(str(tmp_path), 0, np.uint16, 64, 8)
    for part in np.array_split(np.arange(n, dtype=np.uint16), 3):
        writer.add(part)
    path = writer.close()
    file = token_file.SequenceFile(path)
    assert len(file) == -(-n // 64)
    got = [file[i] for i in range(len(file))]
    assert np.concatenate([t[m == 1] for t, m in got]).tolist() == list(range(n))
    masks = np.concatenate([m for _, m in got])
    assert masks[:n].all() and not masks[n:].any()
    held = sum(b.nbytes for b in map(file.file.get_batch, range(file.file.num_record_batches)))
    held -= file.file.num_record_batches * 2 * 64  # the dictionary, counted with every batch
    assert held <= len(got) * (2 * 64 + 1)


def test_edges_of_the_input(spark):
    ship(spark)
    rows = [(5, None), (3, ""), (9, "long text " * 40000), (7, "twice"), (7, "twice"), (None, "no id")]
    docs = docs_frame(spark, rows).withColumn("start", F.lit("x")).withColumn("shard", F.lit("y"))
    order = [(None, "no id"), (3, ""), (5, None), (7, "twice"), (7, "twice"), (9, "long text " * 40000)]
    _, got = read(spark, docs)
    assert sorted(got, key=lambda r: r[1]) == expected(order)
    assert read(spark, docs.limit(0))[1] == []
