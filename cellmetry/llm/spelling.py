"""Spelling variants: words one edit apart, found by asymmetric q-chunks.

Of two words one edit apart the shorter one (either, where lengths are equal) contributes two
disjoint chunks, its halves, and the other its positional grams.  One edit lies in
one half or between them, so the other half stands in the longer word as a gram, at its
place or shifted by the one code point more.  Of all grams only those are filed that stand
where a half of a word as long or one shorter can stand; the rest would meet nothing.

A half may be common ("the...", "...tion") and its group large.  The edit then lies in the
rest of the word, and one of the rest's two halves is preserved by the same argument: groups
are divided by it before they meet, which loses no pair.  Every candidate is verified.
"""

from __future__ import annotations

from math import ceil, log2, log10

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmetry.session import cut_lineage

# Fixed values of the word pattern and of the planted changes.
LETTERS = "A-Za-zÀ-ÿ"
CHANGED_IN = 31
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, least_length: int = 7, least_count: int = 2) -> DataFrame:
    """(word, n) of the distinct words of docs.

    Words are maximal runs of letters, ASCII in lower case.  Where 31 divides the crc32 of
    ``<doc_id>:<run>`` the run loses the code point at crc32 modulo its length.  Shorter
    and rarer words are left out.  A null id counts as the empty text.
    """
    # Shorter runs give shorter words only; a greedy match of this length takes the whole run.
    found = F.regexp_extract_all(
        F.col("text").cast("string"), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0)
    )
    # The outer form: for explode() Spark would test the array's size, matching twice.
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode_outer(found).alias("run"),
    ).where("run IS NOT NULL")
    runs = runs.select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(h % CHANGED_IN == 0, cut).otherwise(F.col("run")).alias("word"))
    counts = words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least_count)


def _keys(word: Column, short: Column, gap: int) -> list[Column]:
    """Keys of a word of ``short + gap`` code points under which it meets words of ``short``.

    With a gap of 0 they are the chunks of the word itself, each with a half of the rest.
    """
    part = lambda at, n: F.substring(word, at + 1, n)
    half = F.floor(short / 2).cast("int")
    zero, keys = F.lit(0), []
    first = (part(zero, half), half, short - half)
    last = (part(half + gap, short - half), zero, half)
    for slot, (chunk, at, n) in enumerate((first, last)):
        k = F.floor(n / 2).cast("int")
        for side, rest in enumerate((part(at, k), part(at + k + gap, n - k))):
            keys.append(F.xxhash64(F.lit(2 * slot + side), short, chunk, rest))
    return keys


def near_words(counts: DataFrame) -> DataFrame:
    """(u, n_u, v, n_v) of the words one inserted, deleted or replaced code point apart.

    u is the shorter word, of equal length the smaller; a pair is returned once.
    """
    size = F.length("word")
    chunks = counts.select(
        F.explode(F.array(_keys(F.col("word"), size, 0))).alias("key"),
        F.col("word").alias("u"),
        F.col("n").alias("n_u"),
    )
    grams = counts.select(
        F.explode(F.array(_keys(F.col("word"), size, 0) + _keys(F.col("word"), size - 1, 1))).alias("look"),
        F.col("word").alias("v"),
        F.col("n").alias("n_v"),
    )
    longer = F.length("v") - F.length("u")
    ordered = (longer == 1) | ((longer == 0) & (F.col("u") < F.col("v")))
    near = F.levenshtein("u", "v", 1) == 1
    joined = chunks.join(grams, (F.col("key") == F.col("look")) & ordered & near)
    return joined.select("u", "n_u", "v", "n_v").distinct()


def variants(docs: DataFrame, ratio: int = 10) -> DataFrame:
    """One row per word of docs: word, n, n_near, form, form_n, root.

    ``form`` is the near word of largest n, ties by code point, if that n is at least
    ``ratio`` times the word's, else null.  ``root`` is the last word that forms lead to.
    Null and empty texts have no words, rows count as often as they come, other columns are
    ignored; an empty table gives an empty result.
    """
    counts = cut_lineage(word_counts(docs))
    pairs = cut_lineage(near_words(counts))
    sides = pairs.toDF("word", "n", "other", "other_n").unionByName(
        pairs.toDF("other", "other_n", "word", "n")
    )
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form")))
    near = sides.groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    usual = -F.col("best.minus") >= ratio * F.col("n")
    near = cut_lineage(
        near.select(
            "word",
            "n_near",
            F.when(usual, F.col("best.form")).alias("form"),
            F.when(usual, -F.col("best.minus")).alias("form_n"),
        )
    )
    # A chain's counts rise by ``ratio`` each step, so it is short; every round doubles the reach.
    roots = near.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = counts.agg(F.max("n")).first()[0] or 1
    steps = log10(most) / log10(ratio) + 1
    for _ in range(ceil(log2(max(steps, 1)))):
        roots = cut_lineage(roots)
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        roots = roots.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"))
    return (
        counts.join(near, "word", "left")
        .join(roots, "word", "left")
        .select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            "form",
            "form_n",
            F.coalesce("root", "word").alias("root"),
        )
    )
