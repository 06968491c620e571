"""Near-copies by the Jaccard similarity of five-word shingles.

Texts of equal shingle sets are one node.  SimHash comes first: the fingerprint of a set is
filed and looked up under the Golay code words of its segments, as in ``simhash``, which finds
all fingerprints within three bits.  Each node is compared with one of those near it, and what
is verified forms the first components.  Sets of similarity 0.8 may lie further apart than
these keys reach, so MinHash bands complete them.  Their candidates share all five minima of one of 40
bands of MinHash values: a pair of similarity 0.8 shares none with probability
(1 - 0.8 ** 5) ** 40 = 1.2e-7, a closer pair with less.  Every candidate is verified on the
whole sets before it becomes a link, and linked nodes form components.

Pairs inside a component need no test.  Where a band's value is common, its nodes are first
compared with one pivot each, turn by turn, while that joins many of them: a large group of
near-copies costs comparisons in the number of its texts.  Texts that share a band without
being alike, such as those around one long common passage, are left over.  They are
told apart by prefixes: with the shingles of a set in rising order of how many of these
texts have them, two sets of similarity s share one of the first n - ceil(s n) + 1 of each.
Shingles of a common passage come last and leave the prefix, so texts that share no more
than it never meet.  Two that meet must also have enough shingles from the first shared one
on, and may not differ in more bits of the parities of their sets than in shingles; no pair is
left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellmetry.llm.common import (
    LOWER_ASCII,
    WORD,
    components,
    drop_texts,
    keep_texts,
    one_row_each,
    small_side,
    text_hash,
)
from cellmetry.llm.simhash import fingerprint_links
from cellmetry.session import cut_lineage, discard

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 40, 5
#: Longs of a set's parities; they tell sets of up to some 2,000 shingles apart.
PARITIES = 16
#: Pairs across components, per row of the buckets, from which on pivots are tried once more.
PAIRS_PER_ROW = 0.25
_WORDS = re.compile(WORD)


@cache
def _multipliers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odd numbers for the words of a shingle, for the MinHash values and for a band's."""
    rng = np.random.default_rng(20)
    draw = lambda *n: rng.integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1)
    return draw(SHINGLE), draw(BANDS * ROWS, 1), draw(BANDS, ROWS)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted different 64-bit hashes of the shingles; a shorter text is one shingle."""
    words = _WORDS.findall((text or "").translate(LOWER_ASCII))
    h = np.array([xxhash.xxh64_intdigest(w, 42) for w in words], np.uint64)
    width = min(SHINGLE, len(h))
    if not width:
        return h
    many = len(h) - width + 1
    found = np.full(many, width, np.uint64)
    for i, odd in enumerate(_multipliers()[0][:width]):
        found += h[i : i + many] * odd
    found ^= found >> np.uint64(32)
    found *= np.uint64(0x9E3779B97F4A7C15)
    found ^= found >> np.uint64(29)
    return np.unique(found)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One value per band of the MinHash values of a set."""
    _, each, band = _multipliers()
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for start in range(0, len(hashes), 1024):
        np.minimum(least, (each * hashes[None, start : start + 1024]).min(1), out=least)
    keys = ((least ^ least >> np.uint64(31)).reshape(BANDS, ROWS) * band).sum(1, dtype=np.uint64)
    return keys ^ keys >> np.uint64(30)


def parities(hashes: np.ndarray) -> np.ndarray:
    """Bits of whether a set has an odd number of hashes in each of 64 * PARITIES classes.

    A hash that only one of two sets has changes one bit, so sets differ in as many hashes at
    least as their parities in bits.
    """
    odd = np.bincount((hashes % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def set_fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set: the bits that over half of its hashes have, as a signed long."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def _cut(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The batches in smaller parts, as their texts become larger arrays."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, same, n, fp, keys): same names the shingle set of the text, of size n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches):
            same, sizes, prints, keys = [], [], [], []
            for text in batch.column(2):
                hashes = shingle_set(text.as_py())
                same.append(xxhash.xxh3_128_digest(hashes.tobytes(), 42))
                sizes.append(len(hashes))
                prints.append(set_fingerprint(hashes))
                keys.append(band_keys(hashes))
            flat = np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)
            ends = np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(same, pa.binary()),
                    pa.array(sizes, pa.int32()),
                    pa.array(prints, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                ],
                names=["doc_id", "text_hash", "same", "n", "fp", "keys"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long"), text_hash().alias("text_hash"), F.col("text").cast("string")
    )
    return rows.mapInArrow(run, "doc_id long, text_hash long, same binary, n int, fp long, keys array<long>")


def _sets(texts: DataFrame) -> DataFrame:
    """(node, n, hashes, bits) for rows of (node, text), bits being the set's parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches):
            found = [shingle_set(text.as_py()) for text in batch.column(1)]
            sizes = np.array([len(x) for x in found], np.int32)
            flat = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
            bits = np.concatenate([parities(x) for x in found]) if found else np.empty(0, np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(0, len(bits) + 1, PARITIES, dtype=np.int32)), pa.array(bits)
                    ),
                ],
                names=["node", "n", "hashes", "bits"],
            )

    return texts.mapInArrow(run, "node long, n int, hashes array<long>, bits array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose sets have a similarity of ``least`` at least."""
    side = lambda name: sets.select(
        F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("hashes").alias(f"h_{name}")
    )
    shared = F.size(F.array_intersect("h_u", "h_v"))
    enough = shared * (1 + least) >= least * (F.col("n_u") + F.col("n_v")) - 1e-9
    return pairs.join(side("u"), "u").join(side("v"), "v").where(enough).select("u", "v")


def _sizes(least: float) -> Column:
    """Whether the sizes n_u and n_v allow a similarity of ``least``."""
    return F.least("n_u", "n_v") >= least * F.greatest("n_u", "n_v") - 1e-9


def _near(least: float) -> Column:
    """Whether rows that meet at a shingle may be of similarity ``least``, it being their first.

    Sets of sizes n_u and n_v share s / (1 + s) of n_u + n_v.  All that they share stands from
    their first shared shingle on, and the rest is what their parities may differ in.
    """
    both = F.col("n_u") + F.col("n_v")
    share = F.ceil(least / (1 + least) * both - 1e-9)
    follow = F.least(F.col("n_u") - F.col("at_u"), F.col("n_v") - F.col("at_v")) + 1
    differ = sum(
        (F.bit_count(F.get("bits_u", i).bitwiseXOR(F.get("bits_v", i))) for i in range(1, PARITIES)),
        F.bit_count(F.get("bits_u", 0).bitwiseXOR(F.get("bits_v", 0))),
    )
    return (follow >= share) & (differ <= both - 2 * share)


def _named(u: str, v: str) -> list[Column]:
    return [F.least(u, v).alias("u"), F.greatest(u, v).alias("v")]


def _fuzzy_pairs(nodes: DataFrame, least: float) -> DataFrame:
    """Pairs (u, v) of the nodes (node, n, fp) whose fingerprints differ in three bits at most.

    A fingerprint is named by its first node.  Its other nodes are paired with that, and it with the
    smallest fingerprint near it: the pairs are no more than the nodes, however large a group is.
    """
    prints = cut_lineage(nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("first")).select("fp", "first.*"))
    near = fingerprint_links(prints).groupBy(F.col("v").alias("fp")).agg(F.min("u").alias("u"))
    side = lambda x: prints.select(F.col("fp").alias(x), F.col("node").alias(f"node_{x}"), F.col("n").alias(f"n_{x}"))
    apart = near.withColumnRenamed("fp", "v").join(side("u"), "u").join(side("v"), "v")
    first = prints.select(F.col("fp").alias("fp_v"), F.col("node").alias("node_v"), F.col("n").alias("n_v"))
    same = nodes.select("fp", F.col("node").alias("node_u"), F.col("n").alias("n_u"))
    same = same.join(first, (F.col("fp") == F.col("fp_v")) & (F.col("node_u") != F.col("node_v")))
    columns = ("node_u", "n_u", "node_v", "n_v")
    return apart.select(*columns).unionByName(same.select(*columns)).where(_sizes(least)).select(*_named("node_u", "node_v"))


def _prefixes(nodes: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(h, c, node, n, group, at): the first shingles of each node by the number c of nodes having them.

    A shingle that only one of the nodes has can meet nothing; it counts in the prefix only.
    """
    held = nodes.join(sets.select("node", "hashes"), "node").select("node", "n", "group", F.explode("hashes").alias("h"))
    many = held.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    shared = held.join(many, "h")
    per = Window.partitionBy("node")
    alone = F.col("n") - F.count("*").over(per)
    rank = F.row_number().over(per.orderBy("c", "h"))
    kept = F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1
    first = shared.select("h", "c", "node", "n", "group", (alone + rank).alias("at"), kept.alias("kept"))
    return first.where("at <= kept").drop("kept")


def _by_prefix(nodes: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (u, v) of nodes in different groups that share a shingle of their prefixes.

    One of the two is ``left``: it may belong together with others of its bucket.  Of the shingles
    that the same nodes have, as those of a run they share, the first stands for all: the first
    shingle that two nodes share is never left out.
    """
    every = cut_lineage(_prefixes(nodes, sets, least))
    having = every.groupBy("h").agg(
        F.count("*").alias("held"),
        F.min("c").alias("c"),
        F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"),
    )
    one = having.where("held > 1").groupBy("held", "x", "y").agg(F.min(F.struct("c", "h")).alias("one"))
    marked = nodes.select("node", "left").join(sets.select("node", "bits"), "node")
    first = cut_lineage(every.join(one.select("one.h"), "h").drop("c").join(marked, "node"))
    discard(every)
    names = ("node", "n", "group", "at", "bits")
    side = lambda df, x: df.select("h", *(F.col(c).alias(f"{c}_{x}") for c in names))
    met = side(first.where("left"), "u").join(side(first, "v"), "h")
    apart = (F.col("group_u") != F.col("group_v")) & _sizes(least) & _near(least)
    return met.where(apart).select(*_named("node_u", "node_v")).distinct()


def _components(nodes: DataFrame, sets: DataFrame, least: float, near: DataFrame) -> DataFrame:
    """(node, component) of the nodes that are linked, from the rows (node, n, keys).

    ``near`` are pairs (u, v) that are compared before those of the bands.
    """
    limit = PAIRS_PER_ROW * (nodes.agg(F.sum(F.size("keys"))).first()[0] or 0)
    before, turn = float("inf"), 0
    links = cut_lineage(_verified(near, sets, least))
    named = components(links)
    while True:
        sized = named.groupBy("component").agg(F.count("*").alias("mass"))
        known = named.join(sized, "component")
        # Groups are joined to the nodes, one row each; buckets are listed after that.
        placed = nodes.join(known, "node", "left").select(
            "node", "n", "keys", F.coalesce("component", "node").alias("group"),
            F.coalesce("mass", F.lit(0)).alias("mass"),
        )
        placed = cut_lineage(placed)
        listed = placed.select(F.explode("keys").alias("key"), "node", "n", "group", "mass")
        # A bucket's pivot is of its largest component, which need not be compared in itself.
        order = F.xxhash64("node", F.lit(turn))
        rank = F.struct(-F.col("mass"), "group", order, "node", "n") if turn else F.struct(order, "node", "n", "group")
        per = listed.groupBy("key").agg(
            F.count("*").alias("rows"),
            F.min(rank).alias("pivot"),
            (F.min("group") < F.max("group")).alias("open"),
        )
        # Two nodes that the first turn has compared need no other.
        per = per.where("open" if not turn else "open AND rows > 2")
        pivots = cut_lineage(
            per.select("key", "rows", F.col("pivot.node").alias("p"), F.col("pivot.n").alias("n_v"),
                       F.col("pivot.group").alias("main"))
        )
        rest = listed.join(pivots, "key").where("group <> main")
        work = rest.agg(F.sum("rows")).first()[0] or 0
        last = turn > 0 and (work <= limit or work > 0.5 * before)
        if last:
            open_keys = pivots.select("key", "main")
            in_open = listed.join(open_keys, "key").groupBy("node", "n", "group").agg(
                F.max(F.col("group") != F.col("main")).alias("left")
            )
            pairs = _by_prefix(cut_lineage(in_open), sets, least)
        else:
            sides = rest.withColumnRenamed("n", "n_u").where(_sizes(least))
            pairs = sides.select(*_named("node", "p")).distinct()
        pairs = cut_lineage(pairs)
        found = _verified(pairs, sets, least)
        old, links = links, cut_lineage(links.union(found))
        linked = components(links)
        discard(old, pairs, pivots, placed, named)
        if last:
            discard(links)
            return linked
        named, before, turn = linked, work, turn + 1


def near_copies_removed(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of docs without near-copies: one row stays of each component.

    Texts are linked whose sets of five-word shingles, in ASCII lower case, have a Jaccard
    similarity of ``least`` (0.8 or more) at least.  It is the row of smallest (doc_id, hash of
    the text); an id that is repeated with another text is judged as a document of its own.
    Texts without words are copies of each other.  Rows without an id cannot be named and
    all stay.
    """
    if not LEAST <= least <= 1:
        raise ValueError("the bands are laid out for similarities of 0.8 and more")
    judged = docs.where("doc_id IS NOT NULL")
    rows = cut_lineage(_sketches(judged))
    # Nodes are numbered once for all: the written numbers name the sets from here on.
    first = rows.groupBy("same").agg(F.min(F.struct("doc_id", "text_hash", "n", "fp", "keys")).alias("first"))
    nodes = cut_lineage(first.select("same", "first.*").withColumn("node", F.monotonically_increasing_id()))
    listed = nodes.select(F.explode("keys").alias("key"), "node")
    shared = listed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    met = listed.join(shared, "key").groupBy("node").agg(F.collect_list("key").alias("keys"))
    met = cut_lineage(met.join(nodes.drop("keys"), "node"))
    near = cut_lineage(_fuzzy_pairs(nodes, least))
    listed = met.select("node").union(near.select("u")).union(near.select("v")).distinct()
    wanted = cut_lineage(
        nodes.join(listed, "node").select(
            F.col("node").alias("__node"),
            F.col("doc_id").alias("__id"),
            F.col("text_hash").alias("__hash"),
        )
    )
    same = (judged["doc_id"] == F.col("__id")) & (
        F.xxhash64(judged["text"].cast("string")) == F.col("__hash")
    )
    texts = judged.join(small_side(wanted, wanted.count()), same).select(
        F.col("__node").alias("node"), judged["text"].cast("string").alias("text")
    )
    sets = cut_lineage(_sets(texts).dropDuplicates(["node"]))
    named = _components(met.select("node", "n", "keys"), sets, least, near)
    discard(sets, wanted, met, near)
    placed = nodes.drop("keys", "n", "fp").join(named, "node", "left")
    placed = cut_lineage(placed.withColumn("group", F.coalesce("component", "node")))
    kept = placed.groupBy("group").agg(F.min(F.struct("doc_id", "text_hash")).alias("kept"))
    kept = cut_lineage(placed.join(kept, "group").select("same", "kept"))
    copies = rows.groupBy("same", "doc_id", "text_hash").agg(F.count("*").alias("c"))
    is_kept = F.struct("doc_id", "text_hash") == F.col("kept")
    decided = cut_lineage(
        copies.join(kept, "same").select("doc_id", "text_hash", "c", is_kept.alias("stays"))
    )
    discard(rows, nodes, placed, kept, named)
    once = drop_texts(docs, decided.where("NOT stays OR c > 1"))
    again = keep_texts(docs, decided.where("stays AND c > 1"))
    return once.unionByName(one_row_each(again))
