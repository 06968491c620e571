"""Classification and regression trees with exact thresholds, grown level by level.

All trees of a forest, or of all folds, grow at the same time.  A level counts the rows of
each (tree, node, feature, value) by class, accumulates the counts in the order of the values and
takes the best cut between two values per node.  What the driver holds is the trees: at most
2 ** (depth + 1) nodes each.  Rows stay in Spark; a level sends them one step down by a join
with the splits of the level.

Nodes are numbered from 1, the children of n are 2 n (values up to the threshold) and
2 n + 1.  Gains are compared to nine digits, ties go to the first feature and smallest
threshold, and all choices are hashes of names, so reruns give the same trees.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from hashlib import md5
from math import ceil, log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cellmetry.session import cut_lineage, discard

#: Rows up to which the values of a node's feature are ordered in one window.
WINDOW_ROWS = 1_000_000


@dataclass(frozen=True)
class Growth:
    """How trees grow: impurity is gini, entropy or variance (of labels 0..K-1)."""

    impurity: str = "gini"
    depth: int = 30
    leaf_rows: int = 1
    leaf_share: float = 0.0
    balanced: bool = True
    tried: int | None = None

    def least(self, n: int) -> int:
        return max(self.leaf_rows, ceil(self.leaf_share * n - 1e-9))


@dataclass(frozen=True)
class Node:
    """Rows by class; a leaf has no feature."""

    counts: tuple[int, ...]
    feature: int | None = None
    threshold: float | None = None


@dataclass(frozen=True)
class Trees:
    """Nodes by (tree, number), class weights by tree."""

    growth: Growth
    features: tuple[str, ...]
    weights: dict[int, tuple[float, ...]]
    nodes: dict[tuple[int, int], Node]

    def impurity(self, tree: int, counts: tuple[int, ...]) -> float:
        return _impurity(self.growth.impurity, counts, self.weights[tree])

    def weight(self, tree: int, counts: tuple[int, ...]) -> float:
        return sum(c * w for c, w in zip(counts, self.weights[tree]))

    def leaves(self, tree: int) -> list[int]:
        return [n for (t, n), x in self.nodes.items() if t == tree and x.feature is None]


def _impurity(kind: str, counts: tuple[int, ...], weights: tuple[float, ...]) -> float:
    parts = [c * w for c, w in zip(counts, weights)]
    total = sum(parts)
    if not total:
        return 0.0
    if kind == "variance":
        mean = sum(k * p for k, p in enumerate(parts)) / total
        return sum(k * k * p for k, p in enumerate(parts)) / total - mean * mean
    shares = [p / total for p in parts if p]
    return 1 - sum(s * s for s in shares) if kind == "gini" else -sum(s * log2(s) for s in shares)


def _impurity_column(kind: str, parts: list[Column]) -> Column:
    total = sum(parts[1:], parts[0])
    if kind == "variance":
        first = sum((k * p for k, p in enumerate(parts)), F.lit(0.0))
        second = sum((k * k * p for k, p in enumerate(parts)), F.lit(0.0))
        return second / total - (first / total) * (first / total)
    if kind == "gini":
        return 1 - sum(((p / total) * (p / total) for p in parts), F.lit(0.0))
    term = lambda p: F.when(p > 0, (p / total) * F.log2(p / total)).otherwise(0.0)
    return -sum((term(p) for p in parts), F.lit(0.0))


def _local(spark: SparkSession, rows: list[tuple], kinds: str) -> DataFrame:
    """A small table that Spark plans with, so that no job has to fetch it."""
    schema = to_arrow_schema(StructType.fromDDL(kinds))
    columns = list(zip(*rows)) or [[] for _ in schema]
    arrays = [pa.array(column, field.type) for column, field in zip(columns, schema)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=schema))


def feature_order(tree: int, node: int, features: int) -> list[int]:
    """Ranks of the features in the random order in which a node tries them."""
    order = sorted(range(features), key=lambda f: (md5(f"{tree}|{node}|{f}".encode()).hexdigest(), f))
    ranks = [0] * features
    for rank, f in enumerate(order):
        ranks[f] = rank
    return ranks


def _cumulative(values: DataFrame, classes: int, rows: int) -> DataFrame:
    """Add l0.. (rows up to the value, by class) and the next value of the node's feature."""
    group = ["tree", "node", "feature"]
    sums = lambda w: [F.sum(f"c{k}").over(w).alias(f"l{k}") for k in range(classes)]
    if rows <= WINDOW_ROWS:
        order = Window.partitionBy(*group).orderBy("value")
        upto = order.rowsBetween(Window.unboundedPreceding, 0)
        return values.select(*group, "value", *sums(upto), F.lead("value").over(order).alias("next"))
    # Range partitions are the pieces of long orders; a table of their sums joins them.
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = values.repartitionByRange(parts, *group, "value")
    dealt = cut_lineage(dealt.withColumn("part", F.spark_partition_id()))
    order = Window.partitionBy(*group, "part").orderBy("value")
    inside = dealt.select(
        *group, "part", "value", *sums(order.rowsBetween(Window.unboundedPreceding, 0)),
        F.lead("value").over(order).alias("next"),
    )
    pieces = dealt.groupBy(*group, "part").agg(
        F.min("value").alias("first"), *[F.sum(f"c{k}").alias(f"c{k}") for k in range(classes)]
    )
    over = Window.partitionBy(*group).orderBy("part")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        *group, "part", F.lead("first").over(over).alias("after"),
        *[F.coalesce(F.sum(f"c{k}").over(before), F.lit(0)).alias(f"b{k}") for k in range(classes)],
    )
    joined = inside.join(offsets, [*group, "part"])
    return joined.select(
        *group, "value", *[(F.col(f"l{k}") + F.col(f"b{k}")).alias(f"l{k}") for k in range(classes)],
        F.coalesce("next", "after").alias("next"),
    )


def _best_splits(base: DataFrame, trees: Trees, open_nodes: list, classes: int, rows: int) -> dict:
    """(tree, node) -> (feature, threshold, left counts) of the best cut of each open node.

    Nodes that cannot be cut by any of the features they try first look at the others.
    """
    growth = trees.growth
    first, others = [], {}
    for tree, node, least in open_nodes:
        ranks = feature_order(tree, node, len(trees.features))
        late = [max(0, r + 1 - (growth.tried or len(ranks))) for r in ranks]
        counts = [int(c) for c in trees.nodes[tree, node].counts]
        row = (tree, node, least, late, counts, list(trees.weights[tree]))
        first.append((*row, [f for f, x in enumerate(late) if not x]))
        others[tree, node] = (*row, [f for f, x in enumerate(late) if x])
    found = _best_cuts(base, growth, first, classes, rows)
    rest = [row for key, row in others.items() if key not in found and row[-1]]
    if rest:
        found |= _best_cuts(base, growth, rest, classes, rows)
    return {key: cut for key, (loss, *cut) in found.items() if loss <= 0}


def _best_cuts(base: DataFrame, growth: Growth, listed: list, classes: int, rows: int) -> dict:
    """(tree, node) -> (loss, feature, threshold, left counts) among the features listed per node."""
    spark = base.sparkSession
    kinds = (
        "tree int, node bigint, least bigint, late array<int>, total array<bigint>, "
        "weight array<double>, tries array<int>"
    )
    nodes = F.broadcast(_local(spark, listed, kinds))  # the open nodes of a level
    counts = [F.sum(F.when(F.col("label") == k, F.col("copies")).otherwise(0)).alias(f"c{k}") for k in range(classes)]
    tried = (
        base.where("copies > 0")
        .join(nodes.select("tree", "node", "tries"), ["tree", "node"])
        .select("tree", "node", "label", "copies", "values", F.explode("tries").alias("feature"))
        .withColumn("value", F.col("values")[F.col("feature")])
        .drop("values")
    )
    if rows <= WINDOW_ROWS:  # the window needs them together anyway
        tried = tried.repartition("tree", "node", "feature")
    values = tried.groupBy("tree", "node", "feature", "value").agg(*counts)
    cuts = _cumulative(values, classes, rows).where("next IS NOT NULL").join(nodes, ["tree", "node"])
    left = [F.col(f"l{k}") for k in range(classes)]
    right = [F.col("total")[k] - F.col(f"l{k}") for k in range(classes)]
    weighed = lambda side: [x * F.col("weight")[k] for k, x in enumerate(side)]
    weight = lambda side: sum(weighed(side)[1:], weighed(side)[0])
    whole = [F.col("total")[k] for k in range(classes)]
    worth = _impurity_column(growth.impurity, weighed(whole)) - (
        weight(left) * _impurity_column(growth.impurity, weighed(left))
        + weight(right) * _impurity_column(growth.impurity, weighed(right))
    ) / weight(whole)
    allowed = (sum(left[1:], left[0]) >= F.col("least")) & (sum(right[1:], right[0]) >= F.col("least"))
    # Written as the smaller value and half the gap, which cannot pass the larger one.
    threshold = F.col("value") + (F.col("next") - F.col("value")) / 2
    rank = F.struct(
        F.col("late")[F.col("feature")].alias("late"), (-F.round(worth, 9)).alias("loss"), "feature",
        threshold.alias("threshold"), *[x.alias(f"l{k}") for k, x in enumerate(left)],
    )
    best = cuts.where(allowed).groupBy("tree", "node").agg(F.min(rank).alias("best"))
    found = {}
    for row in best.collect():  # a row per open node at most
        b = row["best"]
        left_counts = tuple(b[f"l{k}"] for k in range(classes))
        found[row["tree"], row["node"]] = (b["loss"], b["feature"], b["threshold"], left_counts)
    return found


def _step(rows: DataFrame, splits: list[tuple]) -> DataFrame:
    """Rows one level down; a row whose node has no split stays and gets a null node below."""
    kinds = "tree int, node bigint, feature int, threshold double"
    listed = F.broadcast(_local(rows.sparkSession, splits, kinds))  # the splits of a level
    below = 2 * F.col("node") + F.when(F.col("values")[F.col("feature")] <= F.col("threshold"), 0).otherwise(1)
    return rows.join(listed, ["tree", "node"], "left").withColumn(
        "below", F.when(F.col("feature").isNotNull(), below)
    ).drop("feature", "threshold")


def table(df: DataFrame, features: list[str], *keep: str | Column) -> DataFrame:
    """Rows with their features as ``values``, the form in which trees take them."""
    values = F.array(*[F.col(f).cast("double") for f in features]).alias("values")
    return df.select(*keep, F.col("label").cast("int").alias("label"), values)


def grow(rows: DataFrame, features: list[str], classes: int, growth: Growth) -> Trees:
    """Trees for rows (tree, label, copies, values); rows of no copies are not learned from.

    ``copies`` counts a row several times.  Class weights are n / (K n_c) of the rows, copies
    not regarded.  Null and NaN values, and labels outside 0..K-1, are an error.
    """
    bad = F.exists("values", lambda v: v.isNull() | F.isnan(v)) | F.col("label").isNull()
    bad = bad | (F.col("label") < 0) | (F.col("label") >= classes)
    checked = rows.withColumn("node", F.when(~bad, F.lit(1).cast("bigint")).otherwise(
        F.raise_error(F.lit("trees need finite values and labels of known classes")).cast("bigint")))
    base = cut_lineage(checked.select(F.col("tree").cast("int"), "label", "copies", "values", "node"))
    plain: dict[int, list[int]] = {}
    copied: dict[int, list[int]] = {}
    for r in base.groupBy("tree", "label").agg(F.count("*").alias("n"), F.sum("copies").alias("m")).collect():
        plain.setdefault(r["tree"], [0] * classes)[r["label"]] = r["n"]
        copied.setdefault(r["tree"], [0] * classes)[r["label"]] = r["m"]
    weights = {
        t: tuple((sum(n) / (classes * c) if c else 0.0) if growth.balanced else 1.0 for c in n)
        for t, n in plain.items()
    }
    trees = Trees(growth, tuple(features), weights, {(t, 1): Node(tuple(m)) for t, m in copied.items()})
    least = {t: growth.least(sum(m)) for t, m in copied.items()}
    largest = max((sum(n) for n in plain.values()), default=0)
    level = list(trees.nodes)
    for _ in range(growth.depth):
        open_nodes = [
            (t, n, least[t])
            for t, n in level
            if sum(trees.nodes[t, n].counts) >= max(2, 2 * least[t])
            and trees.impurity(t, trees.nodes[t, n].counts) > 1e-9
        ]
        found = _best_splits(base, trees, open_nodes, classes, largest) if open_nodes else {}
        if not found:
            break
        level = []
        for (t, n), (feature, threshold, left) in found.items():
            whole = trees.nodes[t, n].counts
            trees.nodes[t, n] = Node(whole, feature, threshold)
            trees.nodes[t, 2 * n] = Node(left)
            trees.nodes[t, 2 * n + 1] = Node(tuple(a - b for a, b in zip(whole, left)))
            level += [(t, 2 * n), (t, 2 * n + 1)]
        splits = [(t, n, f, cut) for (t, n), (f, cut, _) in found.items()]
        moved = _step(base, splits).where("below IS NOT NULL").withColumn("node", F.col("below")).drop("below")
        before, base = base, cut_lineage(moved.select("tree", "label", "copies", "values", "node"))
        discard(before)
    discard(base)
    return trees


def route(rows: DataFrame, trees: Trees) -> DataFrame:
    """Rows (tree, values, ...) with ``node``, the leaf that they reach."""
    rows = rows.withColumn("node", F.lit(1).cast("bigint"))
    by_level: dict[int, list[tuple]] = {}
    for (t, n), x in trees.nodes.items():
        if x.feature is not None:
            by_level.setdefault(n.bit_length(), []).append((t, n, x.feature, x.threshold))
    for _, splits in sorted(by_level.items()):
        rows = _step(rows, splits).withColumn("node", F.coalesce("below", "node")).drop("below")
    return rows


def _values(trees: Trees, classes: int) -> list[tuple]:
    """(tree, node, shares of the classes, mean label) of the leaves."""
    out = []
    for (t, n), x in sorted(trees.nodes.items()):
        if x.feature is None:
            parts = [c * w for c, w in zip(x.counts, trees.weights[t])]
            total = sum(parts) or 1.0
            shares = [p / total for p in parts]
            out.append((t, n, shares, sum(k * s for k, s in enumerate(shares))))
    return out


def predict(rows: DataFrame, trees: Trees, classes: int, by: list[str]) -> DataFrame:
    """(by, prediction, estimate) per ``by``: the class of largest mean share over the trees.

    Shares are compared to nine digits and ties go to the smaller class; the estimate is the
    mean label.  Rows are (tree, values) and the columns of ``by``.
    """
    kinds = "tree int, node bigint, shares array<double>, mean double"
    leaves = F.broadcast(_local(rows.sparkSession, _values(trees, classes), kinds))
    named = route(rows, trees).join(leaves, ["tree", "node"])
    means = named.groupBy(*by).agg(
        *[F.avg(F.col("shares")[k]).alias(f"p{k}") for k in range(classes)], F.avg("mean").alias("estimate")
    )
    best = F.array_max(F.array(*[F.struct(F.round(f"p{k}", 9).alias("p"), F.lit(-k).alias("k")) for k in range(classes)]))
    return means.select(*by, (-best["k"]).cast("bigint").alias("prediction"), "estimate")


def _risks(trees: Trees, tree: int) -> dict[int, float]:
    """Weighted impurity of each node as a share of its tree's weight."""
    total = trees.weight(tree, trees.nodes[tree, 1].counts) or 1.0
    return {
        n: trees.impurity(tree, x.counts) * trees.weight(tree, x.counts) / total
        for (t, n), x in trees.nodes.items()
        if t == tree
    }


def _cut_back(trees: Trees, tree: int, below: set[int]) -> Trees:
    """The trees without what hangs below the given nodes of one tree."""
    nodes = {}
    for (t, n), x in trees.nodes.items():
        above = {n >> k for k in range(1, n.bit_length())}
        if t != tree or not above & below:
            nodes[t, n] = Node(x.counts) if t == tree and n in below else x
    return replace(trees, nodes=nodes)


def _weakest_links(trees: Trees, tree: int) -> list[tuple[float, int]]:
    """(alpha, node) of the nodes that become leaves, in the order of weakest-link pruning.

    A node's link is what its subtree gains in risk per leaf more.  The node of the weakest link becomes
    a leaf, step by step; alpha is the strength of the links cut so far.
    """
    risks, alpha = _risks(trees, tree), 0.0
    inner = {n for (t, n), x in trees.nodes.items() if t == tree and x.feature is not None}
    below: dict[int, list] = {n: [1, risks[n]] for n in risks}  # leaves and their risk
    for n in sorted(inner, reverse=True):
        below[n] = [a + b for a, b in zip(below[2 * n], below[2 * n + 1])]
    cuts: list[tuple[float, int]] = []
    while inner:
        links = {n: (risks[n] - below[n][1]) / (below[n][0] - 1) for n in inner}
        weakest = min(links, key=lambda n: (round(links[n], 12), n))
        alpha = max(alpha, links[weakest])
        cuts.append((alpha, weakest))
        gone = [m for m in inner if m > weakest and m >> (m.bit_length() - weakest.bit_length()) == weakest]
        inner -= {weakest, *gone}
        less = [below[weakest][0] - 1, below[weakest][1] - risks[weakest]]
        n = weakest
        while n:
            below[n] = [below[n][0] - less[0], below[n][1] - less[1]]
            n //= 2
    return cuts


def pruning_path(trees: Trees, tree: int) -> list[tuple[float, Trees]]:
    """(alpha, trees) of weakest-link pruning of one tree, from the whole tree to its root."""
    path = [(0.0, trees)]
    for alpha, node in _weakest_links(trees, tree):
        path.append((alpha, _cut_back(path[-1][1], tree, {node})))
    return path


def pruned(trees: Trees, alpha: float) -> Trees:
    """Each tree cut back to its smallest subtree of least risk plus alpha per leaf.

    An alpha of 0 leaves the trees as they are.
    """
    if alpha <= 0:
        return trees
    for tree in sorted({t for t, _ in trees.nodes}):
        cut = {n for strength, n in _weakest_links(trees, tree) if strength <= alpha + 1e-12}
        trees = _cut_back(trees, tree, cut)
    return trees


def importances(trees: Trees) -> list[tuple[str, float]]:
    """(feature, importance): risk that its splits take away, shares of 1 in each tree, the mean over trees."""
    total = [0.0] * len(trees.features)
    numbers = sorted({t for t, _ in trees.nodes})
    for tree in numbers:
        risks, own = _risks(trees, tree), [0.0] * len(total)
        for (t, n), x in trees.nodes.items():
            if t == tree and x.feature is not None:
                own[x.feature] += risks[n] - risks[2 * n] - risks[2 * n + 1]
        if sum(own) > 0:
            total = [a + b / sum(own) for a, b in zip(total, own)]
    whole = sum(total)
    return [(f, v / whole if whole else 0.0) for f, v in zip(trees.features, total)]


def node_rows(trees: Trees, classes: int) -> list[tuple]:
    """(tree, node, feature, threshold, rows, class) of all nodes; a leaf has no feature."""
    out = []
    for (t, n), x in sorted(trees.nodes.items()):
        parts = [round(c * w, 9) for c, w in zip(x.counts, trees.weights[t])]
        name = None if x.feature is None else trees.features[x.feature]
        out.append((t, n, name, x.threshold, sum(x.counts), parts.index(max(parts))))
    return out


def rules(trees: Trees, tree: int, classes: int) -> list[str]:
    """The tree as indented lines, left branches first."""
    predicted = {n: c for t, n, *_, c in node_rows(trees, classes) if t == tree}

    def lines(n: int, indent: str) -> list[str]:
        x = trees.nodes[tree, n]
        if x.feature is None:
            return [f"{indent}class: {predicted[n]}"]
        name, cut = trees.features[x.feature], f"{x.threshold:.2f}"
        return [
            f"{indent}{name} <= {cut}", *lines(2 * n, indent + "|   "),
            f"{indent}{name} >  {cut}", *lines(2 * n + 1, indent + "|   "),
        ]

    return lines(1, "")
