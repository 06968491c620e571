"""Merkle manifest of documents, with proofs by pointer jumping.

A tree of eight-ary runs per language and one over the languages' roots.  Levels are built
by grouping, each an eighth of the one before.  Every node then holds the siblings on its way to
its parent as a segment.  In a round each node joins the row of the ancestor it has reached,
takes over that row's ancestor and appends its segment: the distance doubles, so
a tree of d levels needs about log2(d) self-joins until every leaf reaches the root.

Only DataFrame functions are used.  Texts are hashed where they are read and not moved.
Digests are lowercase hex text wherever they are hashed; segments hold them as bytes.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmetry.llm.common import small_side
from cellmetry.operators.ranking import sorted_row_number
from cellmetry.session import cut_lineage

FAN = 8
#: The tree over the languages' roots; languages are numbered from 0.
TOP = -1
#: Bytes of segments that are broadcast in a round; more are joined by a shuffle.
MAX_SEGMENT_BYTES = 16 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEGMENTS = "array<struct<left:binary,right:binary>>"


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _field(value: Column) -> Column:
    """``-`` for null, else the bytes of the value, a colon and the value."""
    text = value.cast("string")
    size = F.octet_length(text).cast("string")
    return F.coalesce(F.concat(size, F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    """Digest of a row of documents with the given text."""
    known = [_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    return _digest(F.concat(*known, _field(text)))


def _leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, tampered): null where the row is not tampered with."""
    text = F.col("text").cast("string")
    marked = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3 == 0
    changed = F.when(marked, leaf_digest(F.translate(text, _UPPER, _LOWER)))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        leaf_digest(text).alias("leaf"),
        changed.alias("tampered"),
    )


def _joined(kids: Column) -> Column:
    return F.array_join(F.transform(kids, lambda k: k["digest"]), "")


def _runs(nodes: DataFrame, *more: str) -> DataFrame:
    """Runs of eight nodes (tree, n, idx, digest): (tree, n, up, kids), kids in their order."""
    kid = F.struct("idx", "digest", *more)
    run = nodes.groupBy("tree", "n", F.floor(F.col("idx") / FAN).alias("up"))
    return run.agg(F.sort_array(F.collect_list(kid)).alias("kids"))


def _parents(runs: DataFrame) -> DataFrame:
    n = F.ceil(F.col("n") / FAN).alias("n")
    return runs.select("tree", n, F.col("up").alias("idx"), _digest(_joined(F.col("kids"))).alias("digest"))


def _steps(runs: DataFrame, level: int) -> DataFrame:
    """A row per kid of the runs of one level: kid.*, its parent and the one-step segment."""
    listed = runs.select("tree", "up", "kids", F.posexplode("kids").alias("at", "kid"))
    left = F.unhex(_joined(F.slice("kids", F.lit(1), F.col("at"))))
    right = F.unhex(_joined(F.slice("kids", F.col("at") + 2, F.lit(FAN))))
    segment = F.array(F.struct(left.alias("left"), right.alias("right")))
    return listed.select(
        "kid.*",
        F.col("tree").alias("up_tree"),
        F.lit(level + 1).alias("up_level"),
        F.col("up").alias("up_idx"),
        segment.cast(_SEGMENTS).alias("segments"),
    )


def _jumped(rows: DataFrame, inner: DataFrame, bound: int) -> DataFrame:
    """Rows that take over the ancestor and the segment of the node they have reached."""
    side = inner.select(
        F.col("tree").alias("__tree"),
        F.col("level").alias("__level"),
        F.col("idx").alias("__idx"),
        *(F.col(c).alias(f"__{c}") for c in ("up_tree", "up_level", "up_idx", "segments")),
    )
    side = F.broadcast(side) if bound <= MAX_SEGMENT_BYTES else side
    same = (
        (F.col("up_tree") == F.col("__tree"))
        & (F.col("up_level") == F.col("__level"))
        & (F.col("up_idx") == F.col("__idx"))
    )
    moved = {
        f"up_{k}": F.coalesce(F.col(f"__up_{k}"), F.col(f"up_{k}")) for k in ("tree", "level", "idx")
    }
    none = F.array().cast(_SEGMENTS)
    moved["segments"] = F.concat("segments", F.coalesce("__segments", none))
    return rows.join(side, same, "left").withColumns(moved).select(rows.columns)


def manifest(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, leaf, tampered, subroot, root, segments.

    ``segments`` leads from the leaf to the root, one (left, right) per level: the bytes of
    the siblings' digests on either side.  ``tampered`` is the digest of the row with its
    text in ASCII lower case where 3 divides the crc32 of the decimal id, else null.
    Leaves ascend by doc_id, null first, and by digest where ids are equal; a row without an
    id is never tampered with.  Null and empty values differ.  A repeated row is a leaf as
    often as it comes.  Other columns of docs are ignored; an empty table gives an
    empty result.
    """
    order = [F.asc_nulls_first("lang"), F.asc_nulls_first("doc_id"), F.col("leaf")]
    rows = cut_lineage(sorted_row_number(_leaves(docs), order, "place"))
    sizes = rows.groupBy("lang").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    langs = sorted_row_number(sizes, [F.asc_nulls_first("lang")], "tree")
    langs = cut_lineage(langs.select(F.col("lang").alias("__lang"), "first", "n", F.col("tree") - 1))
    langs = langs.toDF("__lang", "first", "n", "tree")
    trees, most = langs.agg(F.count("*"), F.max("n")).first()
    placed = rows.join(
        small_side(langs, trees), F.col("lang").eqNullSafe(F.col("__lang"))
    ).select("tree", "n", (F.col("place") - F.col("first")).alias("idx"), F.col("leaf").alias("digest"),
             "doc_id", "tampered")

    # Levels of the languages' trees; a node without siblings and without a level above is a subroot.
    runs = cut_lineage(_runs(placed.where("n > 1"), "doc_id", "tampered"))
    leaves = _steps(runs, 0).withColumn("tree", F.col("up_tree")).drop("idx")
    alone = placed.where("n = 1").select(
        "digest", "doc_id", "tampered", F.col("tree").alias("up_tree"), F.lit(0).alias("up_level"),
        F.lit(0).cast("long").alias("up_idx"), F.array().cast(_SEGMENTS).alias("segments"), "tree",
    )
    leaves = leaves.unionByName(alone)
    subroots = placed.where("n = 1").select("tree", "digest", F.lit(0).alias("level"))
    inner, level, left = [], 0, most or 0
    while left > 1:
        nodes, level, left = _parents(runs), level + 1, ceil(left / FAN)
        subroots = subroots.union(nodes.where("n = 1").select("tree", "digest", F.lit(level)))
        if left > 1:
            runs = cut_lineage(_runs(nodes.where("n > 1")))
            steps = _steps(runs, level).withColumn("tree", F.col("up_tree"))
            inner.append(steps.withColumn("level", F.lit(level)).withColumn("sub", F.lit(False)))
    depth = level

    # The tree over the languages; its leaves are the subroots.
    subroots = cut_lineage(subroots)
    nodes = subroots.select(
        F.lit(TOP).cast("long").alias("tree"), F.lit(trees).cast("long").alias("n"),
        F.col("tree").alias("idx"), "digest", "level",
    )
    level, left = 0, trees
    while left > 1:
        runs = cut_lineage(_runs(nodes, *([] if level else ["level"])))
        steps = _steps(runs, level)
        if level:
            steps = steps.withColumn("tree", F.col("up_tree")).withColumn("level", F.lit(level))
        else:
            steps = steps.withColumn("tree", F.col("idx")).withColumn("idx", F.lit(0).cast("long"))
        inner.append(steps.withColumn("sub", F.lit(level == 0)))
        nodes, level, left = _parents(runs), level + 1, ceil(left / FAN)
    top = nodes.select("digest").first()
    root = top["digest"] if top else None
    depth += level

    state = ["tree", "level", "idx", "sub", "up_tree", "up_level", "up_idx", "segments"]
    reached, step = None, 1
    for part in inner:
        part = part.select(state)
        reached = part if reached is None else reached.unionByName(part)
    while reached is not None and step < depth:
        # Nodes that lie ``step`` levels above a leaf; a lone leaf is its own subroot.
        reached = cut_lineage(reached)
        far = reached.where((F.col("level") >= step) | (F.col("tree") == TOP) | F.col("sub"))
        bound = far.count() * step * 2 * 32 * FAN
        leaves = _jumped(leaves, far, bound)
        reached = _jumped(reached, far, bound)
        step *= 2
    if reached is not None and most == 1:  # lone leaves only: they stand at their subroots
        far = cut_lineage(reached)
        leaves = _jumped(leaves, far, far.count() * depth * 2 * 32 * FAN)
    named = subroots.select("tree", F.col("digest").alias("subroot"))
    return leaves.join(small_side(named, trees), "tree").select(
        "doc_id", F.col("digest").alias("leaf"), "tampered", "subroot", F.lit(root).cast("string").alias("root"), "segments"
    )


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def folded(leaf: Column, segments: Column) -> Column:
    """The root that a leaf and the siblings on its way lead to."""
    step = lambda node, s: _digest(F.concat(_hex(s["left"]), node, _hex(s["right"])))
    return F.aggregate(segments, leaf, step)


def proof_digest(segments: Column) -> Column:
    """Digest of all siblings from the leaf to the root, left to right in each level."""
    siblings = F.transform(segments, lambda s: F.concat(_hex(s["left"]), _hex(s["right"])))
    return _digest(F.array_join(siblings, ""))


def verified(proofs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of a manifest."""
    rows = proofs.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof_digest(F.col("segments")).alias("proof_sha256"),
        folded(F.coalesce("tampered", "leaf"), F.col("segments")).alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
