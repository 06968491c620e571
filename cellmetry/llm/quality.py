"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are cut into bins at training quantiles.  Boosting goes round the
features; each visit fits one shallow tree on that feature's bins to the residuals and adds
its leaf values to the feature's lookup table.  Then the pairs of features with the
strongest rest are boosted the same way on two-dimensional tables.  A score is the sum of one
table entry per feature and pair, so scoring is indexing and addition.

Labels are learnt from a bounded sample of the labelled rows outside the held-out fold.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmetry.llm.common import WORD, crc_remainder, drop_texts, text_hash
from cellmetry.session import cut_lineage

#: Labelled rows the model is fitted on, at most: those of smallest hash of the id.
TRAIN_ROWS = 20_000
BINS = 32
ROUNDS = 120
PAIRS = 6
PAIR_ROUNDS = 40
RATE = 0.15

FEATURES = (
    "log_words", "word_length", "upper", "punctuation", "digits", "symbols", "spaces", "lines",
    "distinct_words", "most_frequent_word", "repeated_next", "distinct_lines", "sentences",
    "capital_words", "compressed", "marked_words",
)
_WORDS = re.compile(WORD)


def text_features(text: str) -> list[float]:
    """Features of one whole text; all are defined for the empty text."""
    words = _WORDS.findall(text)
    n, chars = len(words), max(1, len(text))
    counts = Counter(words)
    lines = [line for line in text.split("\n") if line]
    raw = text.encode("utf-8", "surrogatepass")
    histogram = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper = int(histogram[65:91].sum())
    digits = int(histogram[48:58].sum())
    space = int(histogram[32] + histogram[9:14].sum())
    common = int(histogram[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum())
    symbols = int(histogram[33:127].sum()) - common - upper - digits - int(histogram[97:123].sum())
    same = sum(a == b for a, b in zip(words, words[1:]))
    ends = int(histogram[[33, 46, 63]].sum())
    packed = len(zlib.compress(raw, 1))
    marked = sum(k for w, k in counts.items() if not w[-1].isalnum())
    capital = sum(k for w, k in counts.items() if w[0].isupper())
    few = max(1, n)
    return [
        np.log1p(n), len(text) / few, upper / chars, common / chars, digits / chars,
        symbols / chars, space / chars, np.log1p(len(lines)), len(counts) / few,
        max(counts.values(), default=0) / few, same / few, len(set(lines)) / max(1, len(lines)),
        ends / few, capital / few, packed / max(1, len(raw)), marked / few,
    ]


@dataclass
class AdditiveModel:
    """Bin edges per feature, a table per feature, and a table per chosen pair."""

    edges: list[np.ndarray]
    bias: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    grids: list[np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(self.edges)], axis=1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        at = self.bins(x)
        total = np.full(len(x), self.bias)
        for j, table in enumerate(self.tables):
            total += table[at[:, j]]
        for (i, j), grid in zip(self.pairs, self.grids):
            total += grid[at[:, i], at[:, j]]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _leaves(grad: np.ndarray, hess: np.ndarray, depth: int, least: float = 2.0) -> np.ndarray:
    """Newton leaf values of a shallow tree over ordered bins, as a value per bin."""
    values = np.zeros(len(grad))
    todo = [(0, len(grad), depth)]
    while todo:
        a, b, deep = todo.pop()
        g, h = np.cumsum(grad[a:b]), np.cumsum(hess[a:b])
        whole = g[-1] ** 2 / (h[-1] + 1)
        best, at = 1e-6, -1
        if deep and b - a > 1:
            left_g, left_h = g[:-1], h[:-1]
            gain = left_g**2 / (left_h + 1) + (g[-1] - left_g) ** 2 / (h[-1] - left_h + 1) - whole
            gain[(left_h < least * 0.05) | (h[-1] - left_h < least * 0.05)] = 0
            at = int(np.argmax(gain))
            best = gain[at]
        if at >= 0 and best > 1e-6:
            todo += [(a, a + at + 1, deep - 1), (a + at + 1, b, deep - 1)]
        else:
            values[a:b] = g[-1] / (h[-1] + 1)
    return values


def fit_additive(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Fit on rows of features and labels 0 or 1; without rows the score is one half.

    A sample with one label only gives that label everywhere, softened.
    """
    n = len(y)
    if not n:
        return AdditiveModel([np.zeros(0)] * len(FEATURES), 0.0, [np.zeros(1)] * len(FEATURES), [], [])
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, j], quantiles)) for j in range(x.shape[1])]
    share = (y.sum() + 0.5) / (n + 1)
    model = AdditiveModel(edges, float(np.log(share / (1 - share))), [], [], [])
    at = model.bins(x)
    model.tables = [np.zeros(len(e) + 1) for e in edges]
    logit = np.full(n, model.bias)

    def step(place: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return (
            np.bincount(place, y - p, minlength=size),
            np.bincount(place, p * (1 - p), minlength=size),
        )

    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            add = RATE * _leaves(*step(at[:, j], len(table)), depth=2)
            table += add
            logit += add[at[:, j]]

    coarse = [np.minimum(7, np.arange(len(t)) * 8 // max(1, len(t))) for t in model.tables]
    strength = []
    for i in range(x.shape[1]):
        for j in range(i):
            place = coarse[i][at[:, i]] * 8 + coarse[j][at[:, j]]
            g, h = step(place, 64)
            strength.append((float((g**2 / (h + 1)).sum()), i, j))
    for _, i, j in sorted(strength, reverse=True)[:PAIRS]:
        model.pairs.append((i, j))
        model.grids.append(np.zeros((len(model.tables[i]), len(model.tables[j]))))
    for _ in range(PAIR_ROUNDS):
        for (i, j), grid in zip(model.pairs, model.grids):
            # The tree's first cut is on one feature, its second on the other within each side.
            p = 1 / (1 + np.exp(-logit))
            place = at[:, i] * grid.shape[1] + at[:, j]
            g = np.bincount(place, y - p, minlength=grid.size).reshape(grid.shape)
            h = np.bincount(place, p * (1 - p), minlength=grid.size).reshape(grid.shape)
            side = _leaves(g.sum(1), h.sum(1), depth=1)
            add = np.zeros_like(grid)
            for value in np.unique(side):
                rows = side == value
                add[rows] = _leaves(g[rows].sum(0), h[rows].sum(0), depth=1)
            add *= RATE
            grid += add
            logit += add[at[:, i], at[:, j]]
    return model


def _featured(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and an array of features of the whole text."""
    rows = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_features(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            column = pa.array(found, pa.list_(pa.float64()))
            names = [*batch.schema.names[:-1], "features"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], names=names)

    return rows.mapInArrow(run, f"{kinds}, features array<double>")


def train_quality(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> AdditiveModel:
    """Fit on labelled rows outside the held-out fold (crc32 of the id modulo 3 is not 1).

    At most ``most`` rows, those of smallest hash of the id.  Null ids and labels other
    than 0 and 1 are left out.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select("doc_id", "quality")
    known = known.where(crc_remainder("doc_id", 3) != 1)
    sample = known.orderBy(F.xxhash64("doc_id", "quality"), "doc_id", "quality").limit(most)
    sample = cut_lineage(sample.select(F.col("doc_id").alias("l_id"), F.col("quality").alias("y")))
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("l_id"))
    rows = _featured(texts, "doc_id", "y").limit(2 * most).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["y"], r["features"]))
    x = np.array([r["features"] for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit_additive(x, np.array([r["y"] for r in rows], float))


def quality_scores(docs: DataFrame, model: AdditiveModel, *keep: Column) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 if score >= 0.5), *keep.

    Null texts count as empty; empty texts have a score like any other.  Null ids are kept
    and count as the empty text in the fold.  Repeated rows get equal scores.  Other columns
    are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(
        "doc_id",
        (crc_remainder("doc_id", 3) == 1).alias("held_out"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *keep,
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_features(t.as_py()) for t in batch.column(2)]
            x = np.array(found, float).reshape(len(found), len(FEATURES))
            score = shared.value.scores(x)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(score), pa.array((score >= 0.5).astype(np.int32)), *batch.columns[3:]],
                names=["doc_id", "held_out", "score", "predicted", *batch.schema.names[3:]],
            )

    kind = dict(rows.dtypes)["doc_id"]
    kept = "".join(f", {name} {type_}" for name, type_ in rows.dtypes[3:])
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int{kept}")


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier does not reject; all columns stay.

    The model is fitted on docs and labels.  Without any usable label nothing is rejected.
    Rows without an id cannot be named and stay; of a repeated id the rejected texts go.
    """
    scores = quality_scores(docs, train_quality(docs, labels), text_hash().alias("text_hash"))
    return drop_texts(docs, scores.where("doc_id IS NOT NULL AND predicted = 0"))


def held_out_accuracy(scores: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Rows, accuracy and mean score by true label over the held-out fold."""
    known = labels.select(F.col("doc_id").alias("l_id"), F.col(label).alias("truth"))
    held = scores.where("held_out").join(known, F.col("doc_id") == F.col("l_id"))
    return held.groupBy("truth").agg(
        F.count("*").alias("n"),
        F.avg((F.col("predicted") == F.col("truth")).cast("double")).alias("accuracy"),
        F.avg("score").alias("mean_score"),
    )
