"""Token ids in Arrow files of equal-length sequences, read without copying.

Documents are dealt by ranges of doc_id into shards.  A shard is one Arrow IPC file whose
record batches hold fixed-size lists: ``tokens`` (uint16 or uint32) and ``mask`` (uint8,
0 in the padding after a shard's last id).  All batches but the last have the same
number of sequences, so sequence i is at a computed place and a memory map yields it as a
view.  Masks are dictionary-encoded: a shard has the full one and, if it ends in padding, one
more, so they take a byte per sequence.  A second file per shard lists its documents (id,
first position in the shard, ids).
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellmetry.llm.storage import Output, open_input
from cellmetry.session import cut_lineage, shared_folder

SEQUENCE = 2048
BATCH = 256
#: Words whose ids a Python worker keeps, about 120 bytes each; it starts anew beyond them.
CACHE = 1_000_000
_BREAK = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r"^ | $|\s | \s")
_INDEX = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64())])
_MANIFEST = "shard long, tokens string, documents string, n_tokens long, n_docs long"


class CachedEncoder:
    """Encodes texts word by word with a byte-level tokenizer, keeping words it has seen.

    Its splitting pattern always breaks before a single space between two characters
    that are no white space, whatever stands around; so a text may be cut there and the
    ids of the pieces joined are the ids of the text.  New words are encoded many in one
    text, and told apart by the bytes that their ids stand for.
    """

    def __init__(self, path: str, cache: int = CACHE) -> None:
        self.cache = cache
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.uint32 if len(vocabulary) > 1 << 16 else np.uint16
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for piece, i in vocabulary.items():  # a byte-level piece has a character per byte
            self.width[i] = len(piece)
        self.seen: dict[str, bytes | None] = {}

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, self.dtype).tobytes()

    def _learn(self, words: set[str]) -> None:
        """Keep the ids of each word after a space, None where it cannot be cut off."""
        plain = []
        for w in words:
            if not w or w[0].isspace() or w[-1].isspace():
                self.seen[w] = None
            else:
                plain.append(w)
        step = 256
        texts = [" " + " ".join(plain[i : i + step]) for i in range(0, len(plain), step)]
        size = self.dtype().itemsize
        for i, found in enumerate(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            part = plain[i * step : (i + 1) * step]
            ids = np.array(found.ids, self.dtype)
            ends = np.cumsum([len(w.encode()) + 1 for w in part])
            cuts = np.searchsorted(np.cumsum(self.width[ids]), ends) + 1
            data, at = ids.tobytes(), 0
            for w, end in zip(part, (cuts * size).tolist()):
                self.seen[w] = data[at:end]
                at = end

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.seen) > self.cache:
            self.seen.clear()
        cut = [t.split(" ") for t in texts]
        self._learn(set().union(*cut).difference(self.seen))
        out = []
        for text, words in zip(texts, cut):
            try:
                data = b"".join(map(self.seen.__getitem__, words[1:]))
                first = words[0]
                if len(words) > 1 and (not first or first[-1].isspace()):
                    raise TypeError  # the text starts with a space or breaks before one
                data = (self._whole(first) if first else b"") + data
            except TypeError:
                pieces = _BREAK.split(text)
                data = b"".join([self._whole(p if not i else " " + p) for i, p in enumerate(pieces)])
            out.append(np.frombuffer(data, self.dtype))
        return out


@cache
def task_encoder(path: str, cache: int) -> CachedEncoder:
    """The encoder of this Python worker, shared by the tasks that it runs."""
    return CachedEncoder(path, cache)


class _ShardWriter:
    """Appends ids to a shard's file, one record batch of whole sequences at a time."""

    def __init__(self, folder: str, shard: int, dtype: type, length: int, batch: int) -> None:
        self.out = Output(folder, f"tokens-{shard:08d}", ".arrow")
        self.length, self.batch, self.total = length, batch, 0
        kind = pa.from_numpy_dtype(np.dtype(dtype))
        self.schema = pa.schema(
            [("tokens", pa.list_(kind, length)), ("mask", pa.dictionary(pa.int8(), pa.list_(pa.uint8(), length)))],
            {"sequence": str(length), "batch": str(batch)},
        )
        # The padded mask, known at the end only, is added to the full one by a delta.
        deltas = pa.ipc.IpcWriteOptions(emit_dictionary_deltas=True)
        self.writer = pa.ipc.new_file(self.out.stream, self.schema, options=deltas)
        self.rest, self.held = [], 0

    def add(self, ids: np.ndarray) -> None:
        self.rest.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        whole = self.length * self.batch
        if self.held >= whole:
            ready = np.concatenate(self.rest)
            cut = len(ready) // whole * whole
            for start in range(0, cut, whole):
                self._write(ready[start : start + whole], whole)
            self.rest, self.held = [ready[cut:]], len(ready) - cut

    def _write(self, ids: np.ndarray, size: int) -> None:
        pad = size - len(ids)
        padded = np.concatenate([ids, np.zeros(pad, ids.dtype)]) if pad else ids
        masks, which = np.ones(self.length, np.uint8), np.zeros(size // self.length, np.int8)
        if pad:
            masks, which[-1] = np.concatenate([masks, np.arange(self.length) < self.length - pad]), 1
        tokens, masks = (pa.FixedSizeListArray.from_arrays(pa.array(v), self.length) for v in (padded, masks))
        columns = [tokens, pa.DictionaryArray.from_arrays(pa.array(which), masks)]
        self.writer.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> str:
        if self.held:
            ready = np.concatenate(self.rest)
            self._write(ready, ceil(len(ready) / self.length) * self.length)
        self.writer.close()
        self.out.stream.close()
        return self.out.path


class SequenceFile:
    """Random access to the sequences of one shard; items are views of the mapped file.

    Item i is (ids, mask) of sequence i; the mask is 1 for ids and 0 for padding.
    """

    def __init__(self, path: str) -> None:
        self.file = pa.ipc.open_file(open_input(path))
        meta = self.file.schema.metadata
        self.length, self.batch = int(meta[b"sequence"]), int(meta[b"batch"])

    def __len__(self) -> int:
        n = self.file.num_record_batches
        return (n - 1) * self.batch + self.file.get_batch(n - 1).num_rows if n else 0

    def ids(self, batch: int) -> np.ndarray:
        return self.file.get_batch(batch).column(0).flatten().to_numpy(zero_copy_only=True)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        rows = self.file.get_batch(i // self.batch)
        both = rows.column(0)[i % self.batch], rows.column(1)[i % self.batch].value
        return tuple(v.values.to_numpy(zero_copy_only=True) for v in both)


def write_tokens(
    docs: DataFrame,
    tokenizer: str,
    folder: str | None = None,
    end_id: int = 2,
    sequence: int = SEQUENCE,
    batch: int = BATCH,
    docs_per_shard: int = 10_000,
    cache: int = CACHE,
) -> DataFrame:
    """Write the documents in ascending doc_id and return the manifest, a row per shard.

    Shards are in the order of the ids: (shard, tokens, documents, n_tokens, n_docs), the
    two names being files.  Null and empty texts are written as the end id alone.  Rows
    without an id come first; rows of equal id are in the order of their texts.  An
    empty table gives an empty manifest.  Other columns are ignored.  ``cache`` bounds the
    words kept per Python worker; it changes time and memory only.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "tokens")
    shards = max(1, ceil(docs.count() / docs_per_shard))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = ["doc_id", F.xxhash64("text"), "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for rows in batches:
            if not rows.num_rows:
                continue
            if writer is None:
                shard = rows.column(2)[0].as_py()
                encoder = task_encoder(tokenizer, cache)
                writer = _ShardWriter(folder, shard, encoder.dtype, sequence, batch)
                listed = Output(folder, f"documents-{shard:08d}", ".arrow")
                index, n_docs = pa.ipc.new_file(listed.stream, _INDEX), 0
            for start in range(0, rows.num_rows, 500):
                part = rows.slice(start, 500)
                first, sizes = [], []
                for ids in encoder.encode([t or "" for t in part.column(1).to_pylist()]):
                    first.append(writer.total)
                    sizes.append(len(ids) + 1)
                    writer.add(np.append(ids, ids.dtype.type(end_id)))
                n_docs += len(sizes)
                index.write_batch(
                    pa.record_batch([part.column(0), pa.array(first), pa.array(sizes)], schema=_INDEX)
                )
        if writer is not None:
            index.close()
            listed.stream.close()
            path = writer.close()
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "shard": shard,
                        "tokens": path,
                        "documents": listed.path,
                        "n_tokens": writer.total,
                        "n_docs": n_docs,
                    }
                ],
                pa.schema(
                    [("shard", pa.int64()), ("tokens", pa.string()), ("documents", pa.string())]
                    + [("n_tokens", pa.int64()), ("n_docs", pa.int64())]
                ),
            )

    dealt = (
        rows.repartitionByRange(shards, "doc_id", F.xxhash64("text"))
        .sortWithinPartitions(*order)
        .select("doc_id", "text", F.spark_partition_id().cast("long").alias("shard"))
    )
    return cut_lineage(dealt.mapInArrow(run, _MANIFEST))


def read_documents(manifest: DataFrame) -> DataFrame:
    """One row per written document, from the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it, ``ids_crc32`` is taken over its
    ids as little-endian unsigned 32-bit integers.
    """
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("offset")
    shards = manifest.select("shard", "tokens", "documents", offset)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for shard in rows.to_pylist():
                tokens = SequenceFile(shard["tokens"])
                width = tokens.length * tokens.batch
                listed = pa.ipc.open_file(open_input(shard["documents"]))
                held, ids = -1, None
                for i in range(listed.num_record_batches):
                    part = listed.get_batch(i)
                    first, sizes = part.column(1).to_numpy(), part.column(2).to_numpy()
                    crcs = []
                    for at, n in zip(first.tolist(), sizes.tolist()):
                        crc, end = 0, at + n
                        while at < end:
                            if at // width != held:
                                held = at // width
                                ids = tokens.ids(held)
                            upto = min(end, (held + 1) * width)
                            piece = ids[at - held * width : upto - held * width]
                            crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                            at = upto
                        crcs.append(crc)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(first + shard["offset"]), part.column(2), pa.array(crcs, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    # As many tasks as shards; by their few bytes Spark would put all in one.
    spread = shards.repartition(max(1, manifest.count()), "shard")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def sequence_at(paths: list[str], sizes: list[int], i: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence i of several shards, given their files and numbers of sequences."""
    ends = np.cumsum(sizes).tolist()
    shard = bisect.bisect_right(ends, i)
    return SequenceFile(paths[shard])[i - (ends[shard - 1] if shard else 0)]
