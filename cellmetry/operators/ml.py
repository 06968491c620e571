"""Clustering, projection, trees and silhouettes on feature tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product
from math import exp, factorial, isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmetry.operators import evaluate, trees
from cellmetry.operators.splits import holdout_split, kfold_expand, stratified_kfold
from cellmetry.operators.stats import minmax_scale, standard_scale
from cellmetry.operators.tiles import by_task
from cellmetry.session import cut_lineage, one_task_each

BLOCK = 512  # fewest points per block in the exact silhouette
PIECE = 128  # points on either side of one array operation, whose arrays stay in the cache
LARGEST_BLOCK = 1 << 14  # most points per block, which bounds the time and memory of a task
TASK_PAIRS = 1 << 30  # most pairs of points that a task compares in every two features
ROWS, COLUMNS = 32, 256  # the same as PIECE where all features are worked on at once


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="vector").transform(df)


def _cached_points(df: DataFrame, features: list[str]) -> DataFrame:
    """(h, v): a hash of the whole row and its features, kept for the rounds of all models."""
    missing = lambda c: F.raise_error(F.lit(f"no value in {c}")).cast("double")
    vector = F.array(*[F.coalesce(F.col(c).cast("double"), missing(c)) for c in features])
    points = df.select(F.xxhash64(*sorted(df.columns)).alias("h"), vector.alias("v"))
    return points.persist(StorageLevel.MEMORY_AND_DISK)


def race_draws(h: np.ndarray, draw: int) -> np.ndarray:
    """Exponential numbers, one per row hash, by a 64-bit mix of the hash and the number of the draw."""
    z = h.astype(np.uint64) + np.uint64((draw + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return -np.log(((z >> np.uint64(11)).astype(float) + 1) / 2.0**53)


def _squares(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres, centre by centre."""
    return np.stack([((v - c) ** 2).sum(1) for c in centres], axis=1)


def seeds_plus_plus(points: DataFrame, k: int, restarts: int, seed: int) -> list[np.ndarray]:
    """k-means++ centres per restart, drawn by their squared distance from those before.

    A row's race time is an exponential number over its weight and the lowest one wins, so a
    draw is one minimum for all restarts, and reruns agree.  The first j centres are the
    seeds of j clusters.  With fewer different rows than k there are fewer centres.
    """
    centres: list[list[list[float]]] = [[] for _ in range(restarts)]
    for step in range(k):
        chosen = [np.array(c) for c in centres]

        def race(batches, step=step, chosen=chosen):
            for pdf in batches:
                if len(pdf):
                    v, h = np.stack(pdf["v"].to_numpy()), pdf["h"].to_numpy()
                    for r in range(restarts):
                        weight = _squares(v, chosen[r]).min(1) if step else np.ones(len(v))
                        draws = race_draws(h, seed + r * 1009 + step)
                        with np.errstate(divide="ignore"):
                            times = np.where(weight > 0, draws / weight, np.inf)
                        best = np.lexsort((h, times))[0]
                        if np.isfinite(times[best]):
                            yield pd.DataFrame({"r": [r], "time": times[best], "h": h[best], "v": [v[best]]})

        won = points.mapInPandas(race, "r int, time double, h bigint, v array<double>")
        for row in won.groupBy("r").agg(F.min(F.struct("time", "h", "v")).alias("m")).collect():
            centres[row["r"]].append(row["m"]["v"])
    return [np.array(c) for c in centres]


def _lloyd(
    points: DataFrame, models: list[np.ndarray], tolerance: float, rounds: int = 300
) -> list[tuple[float, np.ndarray]]:
    """(inertia, centres) of each model; a round of all models is one job over the rows.

    Tasks return sums per model and cluster.  A cluster without rows keeps its centre.
    """
    models, costs = [m.copy() for m in models], [float("nan")] * len(models)
    active = list(range(len(models)))
    for _ in range(rounds):
        if not active:
            break
        current = [(i, models[i]) for i in active]

        def sums(batches, current=current):
            for pdf in batches:
                if not len(pdf):
                    continue
                v, out = np.stack(pdf["v"].to_numpy()), []
                for i, centres in current:
                    squares = _squares(v, centres)
                    own = squares.argmin(1)
                    for c in np.unique(own):
                        mine = own == c
                        out.append((i, int(c), int(mine.sum()), float(squares[mine, c].sum()), v[mine].sum(0)))
                yield pd.DataFrame(out, columns=["model", "c", "n", "cost", "total"])

        parts = points.mapInPandas(sums, "model int, c int, n bigint, cost double, total array<double>")
        width = models[active[0]].shape[1]
        rows = parts.groupBy("model", "c").agg(
            F.sum("n").alias("n"),
            F.sum("cost").alias("cost"),
            F.array(*[F.sum(F.col("total")[j]) for j in range(width)]).alias("total"),
        )
        moved = {i: models[i].copy() for i in active}
        found = dict.fromkeys(active, 0.0)
        for row in rows.collect():
            moved[row["model"]][row["c"]] = np.array(row["total"]) / row["n"]
            found[row["model"]] += row["cost"]
        still = []
        for i in active:
            costs[i] = found[i]
            if ((moved[i] - models[i]) ** 2).sum() > tolerance:
                models[i] = moved[i]
                still.append(i)
        active = still
    return list(zip(costs, models))


def _variations(df: DataFrame, features: list[str]) -> tuple[float, float]:
    """(mean variance, total variation) of the features."""
    row = df.agg(F.count("*").alias("n"), *[F.var_pop(c).alias(c) for c in features]).first()
    total = sum(row[c] for c in features)
    return total / len(features), total * row["n"]


def kmeans(
    df: DataFrame, features: list[str], k: int = 5, restarts: int = 10, seed: int = 42
) -> DataFrame:
    """Cluster of each row on min-max scaled features, best of several k-means++ starts.

    An empty table gives an empty result.  Ties go to the first centre.
    """
    scaled = minmax_scale(df, features)
    points = _cached_points(scaled, features)
    kept = [c for c in df.columns if c not in features]
    starts = [s for s in seeds_plus_plus(points, k, restarts, seed) if len(s)]
    if not starts:
        return df.select(*kept, F.lit(None).cast("bigint").alias("cluster")).limit(0)
    variance, _total = _variations(scaled, features)
    _cost, centres = min(_lloyd(points, starts, 1e-4 * variance), key=lambda fit: fit[0])
    points.unpersist()
    far = F.array(
        *[
            sum(((F.col(c) - F.lit(float(x))) * (F.col(c) - F.lit(float(x))) for c, x in zip(features, centre)), F.lit(0.0))
            for centre in centres
        ]
    )
    return scaled.select(
        *kept, (F.array_position(far, F.array_min(far)) - 1).cast("bigint").alias("cluster")
    )


def kmeans_elbow(
    df: DataFrame, features: list[str], largest: int = 10, restarts: int = 10, seed: int = 42
) -> DataFrame:
    """Inertia for 1..largest clusters; one cluster is the total variation.

    An empty table gives an empty result.
    """
    scaled = minmax_scale(df, features)
    points = _cached_points(scaled, features)
    starts = [s for s in seeds_plus_plus(points, largest, restarts, seed) if len(s)]
    if not starts:
        return df.sparkSession.createDataFrame([], "k bigint, inertia double")
    variance, total = _variations(scaled, features)
    tasks = [(k, s[:k]) for k in range(2, largest + 1) for s in starts]
    fits = _lloyd(points, [s for _k, s in tasks], 1e-4 * variance)
    lowest: dict[int, float] = {1: float(total)}
    for (k, _start), (cost, _centres) in zip(tasks, fits):
        lowest[k] = min(cost, lowest.get(k, cost))
    points.unpersist()
    return df.sparkSession.createDataFrame(sorted(lowest.items()), "k bigint, inertia double")


def _fit_pca(df: DataFrame, features: list[str], components: int):
    vectors = assemble(standard_scale(df, features), features)
    return PCA(k=components, inputCol="vector", outputCol="_scores").fit(vectors), vectors


def pca_scores(df: DataFrame, features: list[str], components: int = 3) -> DataFrame:
    """Scores pc1.. of z-scored features; each loading's largest entry is positive."""
    model, vectors = _fit_pca(df, features, components)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(0), np.arange(components)])
    scores = vector_to_array(F.col("_scores"))
    return model.transform(vectors).select(
        *[c for c in df.columns if c not in features],
        *[(scores[k] * float(signs[k])).alias(f"pc{k + 1}") for k in range(components)],
    )


def pca(df: DataFrame, features: list[str], components: int = 3) -> DataFrame:
    """Explained variance ratio of each component."""
    model, _ = _fit_pca(df, features, components)
    ratios = [(k + 1, float(v)) for k, v in enumerate(model.explainedVariance)]
    return df.sparkSession.createDataFrame(ratios, "component bigint, ratio double")


def _distance_sums(
    df: DataFrame, key: str, label: str, features: list[str], subsets: list[tuple[int, ...]], block: int
) -> DataFrame:
    """Sum of distances from each point to each class, per feature subset.

    Points are cut into g blocks whose pairs fill the cores; a task compares two blocks once,
    piece by piece, and returns sums for both, so no row per pair exists and a point is copied
    g times.
    """
    n, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, min(-(-n // block), isqrt(2 * cores) + 1), -(-n // LARGEST_BLOCK))
    points = df.select(
        F.col(key).alias("_key"),
        F.col(label).cast("bigint").alias("_label"),
        F.array(*[F.col(c).cast("double") for c in features]).alias("_v"),
        F.pmod(F.xxhash64(key), F.lit(blocks)).alias("_block"),
    )
    others = F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))
    placed = (
        points.withColumn("_other", F.explode(others))
        .withColumn("_low", F.least("_block", "_other"))
        .withColumn("_high", F.greatest("_block", "_other"))
        .drop("_other")
    )

    def by_label(pdf: pd.DataFrame) -> tuple:
        """Rows in order of their labels, the labels and where those begin and end."""
        pdf = pdf.sort_values("_label", kind="stable")
        labels, starts = np.unique(pdf["_label"].to_numpy(), return_index=True)
        return pdf, np.stack(pdf["_v"].to_list()), labels, list(zip(starts, [*starts[1:], len(pdf)]))

    def sums(rows: pd.DataFrame, others: np.ndarray, totals: np.ndarray) -> list[pd.DataFrame]:
        return [
            pd.DataFrame(
                {
                    "subset": number,
                    "key": np.repeat(rows["_key"].to_numpy(), len(others)),
                    "label": np.repeat(rows["_label"].to_numpy(), len(others)),
                    "other": np.tile(others, len(rows)),
                    "total": total.ravel(),
                }
            )
            for number, total in enumerate(totals)
        ]

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = pdf["_low"].iat[0], pdf["_high"].iat[0]
        first, second = pdf[pdf["_block"] == low], pdf[pdf["_block"] == high]
        if first.empty or second.empty:
            return pd.DataFrame(columns=["subset", "key", "label", "other", "total"])
        (rows, a, labels_a, spans_a), (cols, b, labels_b, spans_b) = by_label(first), by_label(second)
        to_b, to_a = np.zeros((len(subsets), len(a), len(labels_b))), np.zeros((len(subsets), len(b), len(labels_a)))
        # A distance is worked out once and counts for both of its points.
        for (i, (begin, end)), (j, (left, right)) in product(enumerate(spans_a), enumerate(spans_b)):
            for s, t in product(range(begin, end, PIECE), range(left, right, PIECE)):
                piece, other = a[s : min(end, s + PIECE)], b[t : min(right, t + PIECE)]
                squares = [(piece[:, None, f] - other[None, :, f]) ** 2 for f in range(len(features))]
                for number, subset in enumerate(subsets):
                    far = squares[subset[0]].copy()
                    for f in subset[1:]:
                        far += squares[f]
                    np.sqrt(far, out=far)
                    to_b[number, s : s + len(piece), j] += far.sum(axis=1)
                    if low != high:
                        to_a[number, t : t + len(other), i] += far.sum(axis=0)
        parts = sums(rows, labels_b, to_b)
        if low != high:
            parts += sums(cols, labels_a, to_a)
        return pd.concat(parts, ignore_index=True)

    kind = df.schema[key].dataType.simpleString()
    return (
        by_task(placed, "_low", "_high")
        .groupBy("_low", "_high")
        .applyInPandas(
            compare, f"subset int, key {kind}, label bigint, other bigint, total double"
        )
        .groupBy("subset", "key", "label", "other")
        .agg(F.sum("total").alias("total"))
    )


def _silhouettes(df: DataFrame, key: str, label: str, sums: DataFrame) -> DataFrame:
    """(subset, silhouette): mean over points; a class of one point counts 0."""
    sizes = df.groupBy(F.col(label).cast("bigint").alias("other")).agg(F.count("*").alias("_n"))
    joined = sums.join(F.broadcast(sizes), "other")  # one row per class
    own = F.col("other") == F.col("label")
    points = joined.groupBy("subset", "key").agg(
        F.max(F.when(own, F.col("_n"))).alias("_own_n"),
        F.max(F.when(own & (F.col("_n") > 1), F.col("total") / (F.col("_n") - 1))).alias("_a"),
        F.min(F.when(~own, F.col("total") / F.col("_n"))).alias("_b"),
    )
    a, b = F.col("_a"), F.col("_b")
    score = F.when(F.col("_own_n") == 1, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0))
    )
    return points.groupBy("subset").agg(F.avg(score).alias("silhouette"))


def silhouette(
    df: DataFrame, key: str, label: str, features: list[str], block: int = BLOCK
) -> DataFrame:
    """Exact mean Euclidean silhouette of given labels."""
    everything = [tuple(range(len(features)))]
    sums = _distance_sums(df, key, label, features, everything, block)
    return _silhouettes(df, key, label, sums).select("silhouette")


class _PairScores:
    """Silhouettes of some points in every two features, from columns that come class by class.

    What is kept are the totals to the class that is coming and the means to the nearest class
    so far, per point and subset.  Rows of one key are one point, as in ``_silhouettes``.  A mean
    is missing (NaN) where a feature is; a point without a mean to its own class or another scores 0.
    """

    def __init__(self, keys: np.ndarray, labels: np.ndarray, known: np.ndarray, points: np.ndarray) -> None:
        """Keys are numbers; a point without a known label belongs to no class."""
        order = np.lexsort((labels, ~known, keys))
        keys, labels, known = keys[order], labels[order], known[order]
        self.points = np.ascontiguousarray(points[order].T)
        new_key = np.append(True, keys[1:] != keys[:-1])
        new = new_key | np.append(True, (labels[1:] != labels[:-1]) | (known[1:] != known[:-1]))
        self.starts = np.flatnonzero(new)
        self.labels, self.known = labels[new], known[new]
        self.key_starts = np.flatnonzero(new_key[new])
        features = len(self.points)
        shape = (features * (features - 1) // 2, len(self.starts))
        self.total = np.zeros((shape[0], len(keys)))
        self.own, self.nearest = np.full(shape, np.nan), np.full(shape, np.nan)
        self.label, self.n = None, 0

    def add(self, label: int, points: np.ndarray) -> None:
        """Columns of one class, which comes after all columns of smaller ones."""
        if label != self.label:
            self._close()
            self.label, self.n = label, 0
        self.n += len(points)
        mine, theirs = self.points, np.ascontiguousarray(points.T)
        features, size = mine.shape
        squares, far, ones = np.empty((features, ROWS, COLUMNS)), np.empty((features, ROWS, COLUMNS)), np.ones(COLUMNS)
        for s in range(0, size, ROWS):
            for c in range(0, len(points), COLUMNS):
                piece, other = mine[:, s : s + ROWS, None], theirs[:, None, c : c + COLUMNS]
                rows, columns = piece.shape[1], other.shape[2]
                square = squares[:, :rows, :columns]
                np.subtract(piece, other, out=square)
                np.multiply(square, square, out=square)
                subset = 0
                for f in range(features - 1):
                    more = features - 1 - f
                    distance = far[:more, :rows, :columns]
                    np.add(square[f], square[f + 1 :], out=distance)
                    np.sqrt(distance, out=distance)
                    self.total[subset : subset + more, s : s + rows] += distance @ ones[:columns]
                    subset += more

    def _close(self) -> None:
        if self.label is None:
            return
        missing = np.isnan(self.total)
        total = np.add.reduceat(np.where(missing, 0, self.total), self.starts, axis=1)
        total[np.logical_and.reduceat(missing, self.starts, axis=1)] = np.nan
        own = self.known & (self.labels == self.label)
        other = self.known & ~own
        if self.n > 1:
            self.own[:, own] = total[:, own] / (self.n - 1)
        self.nearest[:, other] = np.fmin(self.nearest[:, other], total[:, other] / self.n)
        self.total[:] = 0

    def scores(self) -> tuple[np.ndarray, int]:
        """Sum of the silhouettes per subset, and the number of points."""
        self._close()
        if self.label is None:
            return np.zeros(len(self.total)), 0
        a = np.fmax.reduceat(self.own, self.key_starts, axis=1)
        b = np.fmin.reduceat(self.nearest, self.key_starts, axis=1)
        most = np.maximum(a, b)
        with np.errstate(invalid="ignore", divide="ignore"):
            score = (b - a) / most
        score[np.isnan(a) | np.isnan(b) | (most == 0)] = 0
        return score.sum(axis=1), len(self.key_starts)


def silhouette_feature_pairs(
    df: DataFrame, key: str, label: str, features: list[str], block: int = BLOCK
) -> DataFrame:
    """The same for every two features, all in one pass over the points.

    A task holds a block of points and takes all points as a stream in the order of their
    classes, so its memory is bounded and it returns one sum per subset.  A point is copied
    once for every block.
    """
    subsets = list(combinations(range(len(features)), 2))
    n, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, min(-(-n // block), 3 * cores), -(-n // LARGEST_BLOCK), -(-n * n // TASK_PAIRS))
    points = df.select(
        F.col(key).alias("_key"),
        F.col(label).cast("bigint").alias("_label"),
        F.array(*[F.col(c).cast("double") for c in features]).alias("_v"),
        F.pmod(F.xxhash64(key), F.lit(blocks)).alias("_block"),
    )
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    columns = points.where("_label IS NOT NULL").select(
        F.lit(None).cast(df.schema[key].dataType).alias("_key"), "_label", "_v", every.alias("_block"), F.lit(True).alias("_column")
    )
    placed = one_task_each(points.withColumn("_column", F.lit(False)).unionByName(columns), "_block", blocks)
    placed = placed.sortWithinPartitions("_block", "_column", "_label")

    def numbers(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(features))

    def started(rows: list[pa.RecordBatch]) -> _PairScores:
        rows = pa.Table.from_batches(rows).combine_chunks()
        keys = rows["_key"].combine_chunks().dictionary_encode(null_encoding="encode").indices
        labels = rows["_label"].combine_chunks()
        points = np.concatenate([numbers(b) for b in rows.to_batches()])
        known = labels.is_valid().to_numpy(zero_copy_only=False)
        return _PairScores(keys.to_numpy(), labels.fill_null(0).to_numpy(), known, points)

    def result(scores: _PairScores | None) -> Iterator[pa.RecordBatch]:
        total, count = scores.scores() if scores is not None else (0, 0)
        if count:
            parts = [np.arange(len(subsets), dtype=np.int32), total, np.full(len(subsets), count)]
            yield pa.RecordBatch.from_arrays([pa.array(p) for p in parts], names=["subset", "total", "points"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, scores = None, [], None
        for batch in batches:
            of, column = batch.column("_block").to_numpy(), batch.column("_column").to_numpy(zero_copy_only=False)
            labels = batch.column("_label").fill_null(0).to_numpy()
            change = (np.diff(of) != 0) | np.diff(column) | (column[1:] & (np.diff(labels) != 0))
            edges = [0, *(np.flatnonzero(change) + 1), batch.num_rows]
            for begin, end in zip(edges, edges[1:]):
                if begin == end:
                    continue
                if of[begin] != at:
                    yield from result(scores)
                    at, rows, scores = of[begin], [], None
                part = batch.slice(begin, end - begin)
                if not column[begin]:
                    rows.append(part)
                elif rows or scores is not None:
                    if scores is None:
                        scores, rows = started(rows), []
                    scores.add(int(labels[begin]), numbers(part))
        yield from result(scores)

    sums = placed.mapInArrow(compare, "subset int, total double, points bigint")
    sums = sums.groupBy("subset").agg((F.sum("total") / F.sum("points")).alias("silhouette"))
    names = F.array(
        *[
            F.struct(F.lit(features[a]).alias("a"), F.lit(features[b]).alias("b"))
            for a, b in subsets
        ]
    )
    return sums.select(
        names[F.col("subset")]["a"].alias("feature_a"),
        names[F.col("subset")]["b"].alias("feature_b"),
        "silhouette",
    )


def silhouette_squared(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """Silhouette with squared distances: another number, but linear in the rows."""
    value = ClusteringEvaluator(
        featuresCol="vector", predictionCol=label, distanceMeasure="squaredEuclidean"
    ).evaluate(assemble(df, features).withColumn(label, F.col(label).cast("int")))
    return df.sparkSession.createDataFrame([(float(value),)], "silhouette double")


#: How the trees of the registered models grow, and how far they are pruned.
TREE, TREE_ALPHA = trees.Growth("entropy", depth=7, leaf_rows=10, tried=4), 0.019
FOREST, FOREST_ALPHA, FOREST_TREES = trees.Growth("entropy", depth=10, tried=4), 0.01, 10
FOLD_CLASSES = trees.Growth("gini", leaf_share=0.1)
FOLD_VALUES = trees.Growth("variance", leaf_share=0.1, balanced=False)
#: Shares of rows that are drawn at most 0, 1, ... times when as many are drawn as there are.
DRAWN = [sum(exp(-1) / factorial(j) for j in range(k + 1)) for k in range(10)]


def draws(key: Column, tree: Column) -> Column:
    """How often a tree's sample has a row: a hash in place of a draw with replacement."""
    digits = F.substring(F.md5(F.concat(key.cast("string"), F.lit("|"), tree.cast("string"))), 1, 8)
    at = F.conv(digits, 16, 10).cast("double") / float(1 << 32)
    return sum((F.when(at >= share, 1).otherwise(0) for share in DRAWN), F.lit(0)).cast("bigint")


def _report(predicted: DataFrame, n_classes: int, part: str) -> DataFrame:
    confusion = evaluate.confusion_matrix(predicted, n_classes, "label", "prediction")
    return evaluate.classification_report(confusion).withColumn("part", F.lit(part))


def _train_and_score(df, features, key, n_classes, growth, alpha, number, test):
    """Grow and prune on the train part; reports on both parts and the trees."""
    parts = holdout_split(df, key, test=test)
    rows = cut_lineage(trees.table(parts, features, F.col(key).alias("_key"), "part"))
    numbers = F.explode(F.sequence(F.lit(0), F.lit(number - 1)))
    placed = rows.withColumn("tree", numbers)
    copies = draws(F.col("_key"), F.col("tree")) if number > 1 else F.lit(1).cast("bigint")
    train = placed.where("part = 'train'").withColumn("copies", copies)
    grown = trees.grow(train, features, n_classes, growth)
    model = trees.pruned(grown, alpha)
    named = trees.predict(placed, model, n_classes, ["_key", "part", "label"])
    scored = cut_lineage(named.select("part", F.col("label").cast("bigint"), "prediction"))
    report = _report(scored.filter("part = 'train'"), n_classes, "train").unionByName(
        _report(scored.filter("part = 'test'"), n_classes, "test")
    )
    return model, report


def decision_tree(
    df: DataFrame,
    features: list[str],
    key: str,
    n_classes: int = 4,
    test: float = 0.3,
    alpha: float = TREE_ALPHA,
) -> tuple[trees.Trees, DataFrame]:
    """Entropy tree of depth 7, leaf 10, four features tried per split, balanced, pruned."""
    return _train_and_score(df, features, key, n_classes, TREE, alpha, 1, test)


def random_forest(
    df: DataFrame,
    features: list[str],
    key: str,
    n_classes: int = 4,
    test: float = 0.3,
    alpha: float = FOREST_ALPHA,
) -> tuple[trees.Trees, DataFrame]:
    """Ten entropy trees of depth 10 with balanced class weights, pruned."""
    return _train_and_score(df, features, key, n_classes, FOREST, alpha, FOREST_TREES, test)


def feature_importance(df: DataFrame, model: trees.Trees, features: list[str]) -> DataFrame:
    """Features by falling importance."""
    rows = [(f, float(v)) for f, v in trees.importances(model) if f in features]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def fold_models(
    df: DataFrame,
    features: list[str],
    key: str,
    k: int = 5,
    n_classes: int = 4,
    task: str = "classification",
) -> tuple[DataFrame, trees.Trees]:
    """One tree per fold with leaves of at least a tenth of the rows.

    Returns the (tree, part, label, values) table of all folds and the trees, numbered
    by fold.
    """
    rounds = kfold_expand(stratified_kfold(df, key, k=k), k)
    rows = trees.table(rounds, features, F.col(key).alias("_key"), F.col("round").cast("int").alias("tree"), "part")
    rows = cut_lineage(rows)
    train = rows.where("part = 'train'").withColumn("copies", F.lit(1).cast("bigint"))
    growth = FOLD_CLASSES if task == "classification" else FOLD_VALUES
    return rows, trees.grow(train, features, n_classes, growth)


def cv_tree(
    df: DataFrame, features: list[str], key: str, k: int = 5, n_classes: int = 4
) -> DataFrame:
    """Per fold and part: accuracy and macro F1 of a classifier, MSE of a regressor.

    The folds are scored as one table and reduced to counts before any metric.
    """
    fold, by = ["tree", "part"], ["tree", "part", "_key", "label"]
    rows, model = fold_models(df, features, key, k, n_classes)
    scored = trees.predict(rows, model, n_classes, by)
    counts = scored.groupBy(*fold, "label", F.col("prediction").alias("predicted")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = counts.select(
        *fold,
        F.explode(
            F.array(
                F.struct(F.col("label").cast("bigint").alias("c"), F.col("n").alias("s"), F.lit(0).alias("p"), hit.alias("t")),
                F.struct(F.col("predicted").alias("c"), F.lit(0).alias("s"), F.col("n").alias("p"), F.lit(0).alias("t")),
            )
        ).alias("e"),
    )
    per_class = sides.groupBy(*fold, "e.c").agg(
        F.sum("e.s").alias("s"), F.sum("e.p").alias("p"), F.sum("e.t").alias("t")
    )
    classified = per_class.groupBy(*fold).agg(
        (F.sum("t") / F.sum("s")).alias("accuracy"),
        F.avg(2.0 * F.col("t") / (F.col("s") + F.col("p"))).alias("macro_f1"),
    )
    rows, model = fold_models(df, features, key, k, n_classes, "regression")
    gap = F.col("label") - F.col("estimate")
    regressed = trees.predict(rows, model, n_classes, by).groupBy(*fold).agg(F.avg(gap * gap).alias("mse"))
    return classified.join(regressed, fold).withColumn("tree", F.col("tree").cast("bigint")).withColumnRenamed("tree", "fold")


def tree_rules(
    df: DataFrame, features: list[str], key: str, k: int = 5, n_classes: int = 4
) -> DataFrame:
    """Nodes of each fold's tree: the test of an inner node, rows and class of every node.

    Node n leads to 2 n where the feature is at most the threshold, else to 2 n + 1.
    ``trees.rules`` writes a tree as indented text.
    """
    _rows, model = fold_models(df, features, key, k, n_classes)
    kinds = "fold bigint, node bigint, feature string, threshold double, n bigint, predicted bigint"
    return df.sparkSession.createDataFrame(trees.node_rows(model, n_classes), kinds)


def fold_feature_frequency(
    df: DataFrame, features: list[str], key: str, k: int = 5, n_classes: int = 4
) -> DataFrame:
    """How many folds' trees use each feature, and which."""
    used = tree_rules(df, features, key, k, n_classes).where("feature IS NOT NULL")
    return used.groupBy("feature").agg(
        F.countDistinct("fold").alias("n_folds"), F.sort_array(F.collect_set("fold")).alias("folds")
    )
