"""SimHash near-dedup with Golay-code fuzzy hashing.

A fingerprint has 64 bits, cut into segments of 23, 23 and 18 bits.  Every word of 23
bits lies within three bits of exactly one word of the perfect binary Golay code, whose
index (12 bits) is its fuzzy hash.  If two segments differ in at most one bit, the
code word of the one is within four bits of the other; so a fingerprint that looks
under all code words within four bits (one or six) finds any other filed under its
nearest one.

At most three differing bits over three segments leave either a segment without an
error and another with at most one, or one error in each.  The first case is found by
keys of a whole segment and a code word, the second by keys of a code word and error-free
halves of the two other segments.  All keys have 30 bits or more, no pair within three bits
is missed, and every candidate is verified on the whole fingerprints.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmetry.llm.common import (
    LOWER_ASCII,
    WORD,
    components,
    drop_texts,
    keep_texts,
    one_row_each,
    text_hash,
)
from cellmetry.session import cut_lineage

#: Segments as (lowest bit, bits).
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Fixed value: generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b101011100011
_WORDS = re.compile(WORD)


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code words, nearest code index of all 23-bit words, and what surrounds an error.

    The last two are the sorted error patterns of weight three and, for each, the five
    code words of weight seven that contain it.
    """
    message = np.arange(4096, dtype=np.int64)
    code = np.zeros(4096, np.int64)
    for bit in range(12):
        code ^= np.where(message >> bit & 1, GENERATOR << bit, 0)
    ones = 1 << np.arange(23, dtype=np.int64)
    pairs = np.array([a | b for i, a in enumerate(ones) for b in ones[:i]])
    triples = np.array(
        [a | b | c for i, a in enumerate(ones) for j, b in enumerate(ones[:i]) for c in ones[:j]]
    )
    nearest = np.empty(1 << 23, np.uint16)
    for error in np.concatenate([[0], ones, pairs, triples]):
        nearest[code ^ error] = message
    triples.sort()
    sevens = code[np.bitwise_count(code) == 7]
    holds = (sevens[None, :] & triples[:, None]) == triples[:, None]
    return code, nearest, triples, sevens[np.nonzero(holds)[1]].reshape(len(triples), 5)


def code_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code indices within four bits of each word: (n, 6) and which of them count.

    The first column is the nearest code word.
    """
    code, nearest, triples, around = golay()
    first = nearest[words].astype(np.int64)
    error = words ^ code[first]
    far = np.bitwise_count(error) == 3
    found = np.zeros((len(words), 6), np.int64)
    found[:, 0] = first
    others = code[first[far]][:, None] ^ around[np.searchsorted(triples, error[far])]
    found[far, 1:] = nearest[others]
    valid = np.repeat(far[:, None], 6, axis=1)
    valid[:, 0] = True
    return found, valid


def _keys(prints: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """(position, key) of the keys of fingerprints: all nearby code words, or the nearest."""
    whole = [(prints >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = []
    for words in whole:
        found, valid = code_indices(words)
        near.append((found, valid) if every else (found[:, :1], valid[:, :1]))
    exact = [  # (segment of the code word, what must be without an error)
        (j, (i << 23) | whole[i]) for i in range(3) for j in range(3) if i != j
    ]
    for low_b in (0, 1):
        for low_c in (0, 1):
            b = whole[1] >> 12 if low_b else whole[1] & 0xFFF
            c = whole[2] >> 9 if low_c else whole[2] & 0x1FF
            exact.append((0, (3 << 25) | (low_b << 24) | (low_c << 23) | b << 9 | c))
    at, keys = [], []
    for family, (j, rest) in enumerate(exact):
        found, valid = near[j]
        key = (np.int64(family) << 56) | (rest[:, None] << 12) | found
        row, _ = np.nonzero(valid)
        at.append(row)
        keys.append(key[valid])
    return np.concatenate(at), np.concatenate(keys)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Fingerprint of one text, as op10's contract defines it; null counts as empty."""
    words = _WORDS.findall((text or "").translate(LOWER_ASCII))
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [" ".join(words)]
    else:
        shingles = list(map(" ".join, zip(*(words[i:] for i in range(shingle)))))
    ones = np.zeros(64, np.int64)
    for start in range(0, len(shingles), 1 << 16):
        part = shingles[start : start + (1 << 16)]
        hashes = np.array([xxhash.xxh64_intdigest(s, 42) for s in part], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    packed = np.packbits(2 * ones > len(shingles), bitorder="little")
    return int.from_bytes(packed.tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, *keep: Column) -> DataFrame:
    """(doc_id, fp, *keep) for every row of docs; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array(
                [fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints.view(np.int64)), *batch.columns[2:]],
                names=["doc_id", "fp", *batch.schema.names[2:]],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *keep)
    kept = "".join(f", {name} {kind}" for name, kind in rows.dtypes[2:])
    return rows.mapInArrow(run, f"doc_id long, fp long{kept}")


def fingerprint_links(prints: DataFrame, most: int = 3) -> DataFrame:
    """Pairs (u, v) of different fingerprints in a column fp that differ in <= most bits.

    ``most`` is 0 to 3, the reach of the keys.
    """
    if not 0 <= most <= 3:
        raise ValueError("the keys reach three differing bits")

    def keyed(every: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = batch.column(0).to_numpy(zero_copy_only=False)
                for start in range(0, len(values), 4096):
                    part = values[start : start + 4096]
                    row, key = _keys(part.view(np.uint64), every)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), pa.array(part[row])], names=["key", "fp"]
                    )

        return run

    filed = prints.select("fp").mapInArrow(keyed(False), "key long, fp long")
    looks = prints.select("fp").mapInArrow(keyed(True), "key long, fp long")
    filed = filed.select("key", F.col("fp").alias("v"))
    looks = looks.select(F.col("key").alias("look"), F.col("fp").alias("u"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= most
    return (
        looks.join(filed, (F.col("look") == F.col("key")) & (F.col("u") != F.col("v")) & near)
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .distinct()
    )


def _placed(prints: DataFrame, most: int) -> DataFrame:
    """(fp, first_id, group) for the fingerprints of the rows (doc_id, fp)."""
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    named = components(fingerprint_links(nodes, most))
    return nodes.join(named, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("group")
    )


def simhash_groups(docs: DataFrame, most: int = 3, shingle: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    Rows of equal fingerprint are one node; linked nodes form a component, named by its
    smallest doc_id.  Null and empty texts have fingerprint zero and link like any other.
    A repeated row is returned as often as it comes.  A null doc_id is never the name
    of a component unless all its rows have none (then it is null).  Other columns of
    docs are ignored; an empty table gives an empty result.
    """
    rows = cut_lineage(fingerprints(docs, shingle))
    placed = _placed(rows, most)
    first = placed.groupBy("group").agg(F.min("first_id").alias("component_id"))
    groups = cut_lineage(placed.join(first, "group").select("fp", "component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.join(groups, "fp").select("doc_id", hexed, "component_id")


def near_duplicates_removed(docs: DataFrame, most: int = 3, shingle: int = 3) -> DataFrame:
    """The rows of docs without near-duplicates: one document stays of each component.

    It is the one of smallest (doc_id, hash of the text), and one row of it where it is
    repeated; an id that is repeated with another text is judged as a document of its own.
    Rows without an id cannot be named and all stay.
    """
    named = docs.where("doc_id IS NOT NULL")
    rows = cut_lineage(fingerprints(named, shingle, text_hash().alias("text_hash")))
    texts = rows.groupBy("fp", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    texts = cut_lineage(texts.join(_placed(rows, most).select("fp", "group"), "fp"))
    first = texts.groupBy("group").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    stays = (F.struct("doc_id", "text_hash") == F.col("first")).alias("stays")
    judged = cut_lineage(texts.join(first, "group").select("doc_id", "text_hash", "n", stays))
    once = drop_texts(docs, judged.where("NOT stays OR n > 1"))
    again = keep_texts(docs, judged.where("stays AND n > 1"))
    return once.unionByName(one_row_each(again))
