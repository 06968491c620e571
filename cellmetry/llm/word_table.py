"""BPE encoding through distinct words, decoding through a join of ids to pieces.

Texts are split where the tokenizer's own splitting always breaks: at ASCII white space and
between a Latin letter and most ASCII punctuation.  A block of documents keeps one number
per word of its texts in a file and lists its distinct words.  The lists of all blocks are
dealt and sorted by word, so that each distinct word is encoded once; its ids go back to the
blocks that have it, whose documents are put together by the position of their words.
So neither texts nor the rows of single words are shuffled: a word is shuffled once per
block that has it.  Ids are decoded through the table of the vocabulary's pieces, which is
broadcast: it has one row per id, whatever the size of the corpus.
"""

from __future__ import annotations

import os
import re
import uuid
from array import array
from collections.abc import Callable, Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmetry.llm.storage import Output, open_input
from cellmetry.session import shared_folder

#: Words of a block, with repeats; its documents meet its distinct words in one task.
BLOCK_WORDS = 4_000_000
#: Words and documents of one record batch of a block's file.
BATCH_WORDS, BATCH_DOCS = 500_000, 1_000
#: Distinct words in one row of a block's list.
LISTED = 20_000
_BLANKS = "\t\n\x0b\x0c\r"
#: Between a letter and these marks a match of the splitting pattern always ends, and
#: neither normalisation nor a special token reaches across.
_LETTER, _MARK = "[A-Za-zÀ-ÖØ-öø-ÿ]", r"""[!"#$%&()*+,\-./:;=?@[\\\]^_`{}~]"""
_CUT = re.compile(f"(?<={_LETTER})(?={_MARK})|(?<={_MARK})(?={_LETTER})")
_ENCODED = "doc_id long, ids array<int>"


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class BlockWords(dict):
    """From a piece of text between blanks to the numbers of its words in a block."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}

    def __missing__(self, piece: str) -> bytes:
        # Case is folded where that cannot change a composed letter or make a special token.
        low = piece.lower() if max(piece, default="") <= "\xff" and "<|" not in piece else piece
        words = self.words
        numbers = array("I", [words.setdefault(w, len(words)) for w in _CUT.split(low) if w])
        self[piece] = data = numbers.tobytes()
        return data

    def code(self, text: str | None) -> bytes:
        text = text or ""
        for blank in _BLANKS:
            if blank in text:
                text = text.replace(blank, " ")
        return b"".join(map(self.__getitem__, text.split(" ")))


class _Block:
    """Documents as numbers of words; the file is written when the block is closed."""

    def __init__(self, folder: str) -> None:
        self.folder, self.index = folder, BlockWords()
        self.ids, self.codes, self.total = [], [], 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        codes = self.index.code(text)
        self.ids.append(doc_id)
        self.codes.append(codes)
        self.total += len(codes) // 4

    def _parts(self) -> Iterator[tuple[int, int]]:
        """Ranges of documents of so many words and documents as a record batch may have."""
        start = held = 0
        for i, codes in enumerate(self.codes):
            held += len(codes) // 4
            if held >= BATCH_WORDS or i + 1 - start >= BATCH_DOCS:
                yield start, i + 1
                start, held = i + 1, 0
        if start < len(self.codes):
            yield start, len(self.codes)

    def close(self) -> Iterator[pa.RecordBatch]:
        """Write the file; list its words by falling frequency, in one row at least.

        So the numbers of frequent words are small; each byte of a number has a column of its own.
        """
        words = list(self.index.words)
        counts = np.zeros(len(words), np.int64)
        for codes in self.codes:
            counts += np.bincount(np.frombuffer(codes, np.uint32), minlength=len(words))
        order = np.argsort(-counts, kind="stable")
        number = np.empty(len(words), np.uint32)
        number[order] = np.arange(len(words))
        planes = range(max(1, (len(words).bit_length() + 7) // 8))
        schema = pa.schema(
            [("doc_id", pa.int64()), *((f"byte_{k}", pa.list_(pa.uint8())) for k in planes)]
        )
        block = uuid.uuid4().int >> 65
        out = Output(self.folder, f"block-{block:016x}", ".arrow")
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        with pa.ipc.new_file(out.stream, schema, options=options) as writer:
            for a, b in self._parts():
                codes = number[np.frombuffer(b"".join(self.codes[a:b]), np.uint32)]
                ends = pa.array(np.cumsum([0, *map(len, self.codes[a:b])]) // 4, pa.int32())
                bytes_ = [pa.array((codes >> np.uint32(8 * k)).astype(np.uint8)) for k in planes]
                columns = [pa.ListArray.from_arrays(ends, x) for x in bytes_]
                ids = pa.array(self.ids[a:b], pa.int64())
                writer.write_batch(pa.record_batch([ids, *columns], schema=schema))
        out.stream.close()
        words = [words[i] for i in order.tolist()]
        for first in range(0, max(1, len(words)), LISTED):
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([block], pa.int64()),
                    "path": pa.array([out.path]),
                    "first": pa.array([first], pa.int32()),
                    "words": pa.array([words[first : first + LISTED]], pa.list_(pa.string())),
                }
            )


def code_blocks(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(block, path, first, words): the files of the blocks and their distinct words."""
    folder = shared_folder(docs.sparkSession, "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                block = block or _Block(folder)
                block.add(doc_id, text.as_py())
                if block.total >= block_words:
                    yield from block.close()
                    block = None
        if block is not None:
            yield from block.close()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "block long, path string, first int, words array<string>"
    written = shared_folder(docs.sparkSession, "words")
    rows.mapInArrow(run, schema).write.option("compression", "zstd").parquet(written)
    return docs.sparkSession.read.schema(schema).parquet(written)


class Pieces:
    """The vocabulary's pieces by id, for joins with lists of ids."""

    def __init__(self, tokenizer: str) -> None:
        known = _tokenizer(tokenizer).get_vocab(with_added_tokens=True)
        self.by_id: list[str | None] = [None] * (max(known.values()) + 1)
        for piece, i in known.items():
            self.by_id[i] = piece

    def decode(self, lists: pa.ListArray) -> pa.Array:
        """Texts of lists of ids: pieces between single spaces, none for unknown ids."""
        ids = lists.values.to_numpy(zero_copy_only=False)
        known = (ids >= 0) & (ids < len(self.by_id))
        ends = lists.offsets.to_numpy()
        if not known.all():
            ends = np.concatenate([[0], np.cumsum(known)])[ends]
            ids = ids[known]
        found = pa.array(self.by_id, pa.large_string()).take(pa.array(ids))
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)
        return pc.binary_join(listed, pa.scalar(" ", pa.large_string())).cast(pa.string())


def _listed(column: pa.Array) -> pa.ListArray:
    """A column of lists as one whose values are its own, null lists empty."""
    column = pc.fill_null(column, [])
    return pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))]), pa.int32()),
        pc.list_flatten(column),
    )


def decode_ids(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids, decoded) for rows (doc_id, ids): the pieces of the ids, space between.

    Null or no ids give an empty text, unknown ids have no piece.
    """
    pieces = encoded.sparkSession.sparkContext.broadcast(Pieces(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_DOCS):
                part = batch.slice(start, BATCH_DOCS)
                texts = pieces.value.decode(_listed(part.column(1)))
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=["doc_id", "ids", "decoded"])

    rows = encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>"))
    return rows.mapInArrow(run, f"{_ENCODED}, decoded string")


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each span after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    """The batches joined to larger ones, so that a block's words in one are more."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def encode_lists(listed: DataFrame, tokenizer: str) -> DataFrame:
    """(block, path, at, sizes, ids) for rows (block, path, at, word) that are sorted by word.

    A word's ids are found once for all rows of it.  The words of one block in a batch
    are one row: their places, numbers of ids and ids as little-endian integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(tokenizer).encode_batch_fast
        last: tuple[str, list[int]] | None = None
        for batch in _gathered(batches):
            runs = pc.run_end_encode(batch.column(3))
            words, ends = runs.values.to_pylist(), runs.run_ends.to_numpy()
            known = last is not None and words[0] == last[0]
            made = encode([w or "" for w in words[known:]], add_special_tokens=False)
            found = ([last[1]] if known else []) + [e.ids for e in made]
            last = words[-1], found[-1]
            flat = np.array([i for ids in found for i in ids], "<u4")
            many = np.array([len(ids) for ids in found], np.int64)
            word = np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))
            blocks = batch.column(0).to_numpy()
            order = np.argsort(blocks, kind="stable")
            cuts = np.flatnonzero(np.diff(blocks[order], prepend=-1))
            at, path = batch.column(2).to_numpy()[order].astype("<i4"), batch.column(1)
            word = word[order]
            first = np.cumsum(many) - many
            out: list[tuple] = []
            for a, b in zip(cuts, [*cuts[1:], len(order)]):
                own = word[a:b]
                named = [p for p in path.take(pa.array(order[a:b])).drop_null().to_pylist()]
                ids = flat[_spans(first[own], many[own])]
                sizes = many[own].astype("<u4")
                out.append((int(blocks[order[a]]), named[0] if named else None, at[a:b].tobytes(), sizes.tobytes(), ids.tobytes()))
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary())
            columns = [pa.array(x, kind) for x, kind in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "path", "at", "sizes", "ids"])

    return listed.mapInArrow(run, "block long, path string, at binary, sizes binary, ids binary")


def _documents(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids) of a block's documents from the encoded words (path, at, sizes, ids)."""
    path = next(p[0] for p in parts if p[0] is not None)
    at, many, values = (
        np.frombuffer(b"".join(p[k] for p in parts), kind) for k, kind in ((1, "<i4"), (2, "<u4"), (3, "<u4"))
    )
    sizes, starts = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    sizes[at] = many
    starts[at] = np.cumsum(many) - many
    file = pa.ipc.open_file(open_input(path))
    for i in range(file.num_record_batches):
        part = file.get_batch(i)
        ends = part.column(1).offsets.to_numpy()
        numbers = np.zeros(ends[-1], np.int64)
        for k, column in enumerate(part.columns[1:]):
            numbers |= column.values.to_numpy().astype(np.int64) << 8 * k
        after = np.concatenate([[0], np.cumsum(sizes[numbers])])
        ids = values[_spans(starts[numbers], sizes[numbers])]
        lists = pa.ListArray.from_arrays(pa.array(after[ends], pa.int32()), pa.array(ids.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "ids"])


def encode_documents(
    docs: DataFrame,
    tokenizer: str,
    finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None,
    schema: str = _ENCODED,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per row of docs: doc_id and ids.

    Ids are those of the tokenizers library for the whole text without added special tokens.
    ``finish`` may turn these record batches into others of the given schema where they
    are made.  Null and empty texts have no ids.  Null ids of documents stay null and a
    repeated row is returned as often as it comes.  Other columns are ignored; an empty
    table gives an empty result.
    """
    blocks = code_blocks(docs, block_words)
    listed = blocks.select("block", "path", "first", F.posexplode_outer("words").alias("pos", "word"))
    at = F.col("first") + F.coalesce("pos", F.lit(0))
    # The first word of a block, or the row that stands for none, brings the file's name.
    path = F.when(at == 0, F.col("path")).alias("path")
    listed = listed.select("block", path, at.alias("at"), "word")
    encoded = encode_lists(listed.repartition("word").sortWithinPartitions("word"), tokenizer)
    dealt = encoded.repartition("block").sortWithinPartitions("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[0] != block:
                    yield from made(held)
                    held = []
                block = row[0]
                held.append(row[1:])
        if held:
            yield from made(held)

    def made(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        out = _documents(held)
        yield from out if finish is None else map(finish, out)

    return dealt.mapInArrow(run, schema)


#: Schema of the digests.
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def document_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Number of ids, and SHA-256 of the ids as little-endian 32-bit numbers and of their text."""
    pieces = docs.sparkSession.sparkContext.broadcast(Pieces(tokenizer))

    def digests(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(1)
        ids, ends = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
        each = [sha256(ids[a:b]).hexdigest() for a, b in zip(ends, ends[1:])]
        texts = [sha256(t.as_buffer()).hexdigest() for t in pieces.value.decode(lists)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(ends), pa.int64()), pa.array(each), pa.array(texts)],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return encode_documents(docs, tokenizer, digests, DIGESTS)
