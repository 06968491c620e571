"""Exact trees, pruning and importances against plain searches."""

import random
from itertools import combinations
from math import isclose

import pytest

from cellmetry.operators import trees as tr

FEATURES = ["a", "b", "c"]


def sample(n, seed, levels=6, noise=0.8):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        v = [float(rng.randrange(levels)), float(rng.randrange(levels)) / 2, rng.random()]
        rows.append((0, min(2, int(v[0] // 3 + (v[1] > 1.2) + rng.random() * noise)), rng.choice((0, 1, 1, 2)), v))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "tree int, label int, copies bigint, values array<double>")


def plain_tree(rows, growth, classes, tree=0):
    """Nodes of a tree by trying every cut of every feature at every node."""
    n_c = [sum(r[1] == k for r in rows) for k in range(classes)]
    weights = tuple((len(rows) / (classes * c) if c else 0.0) if growth.balanced else 1.0 for c in n_c)
    least, nodes = growth.least(sum(r[2] for r in rows)), {}

    def counts(part):
        return tuple(sum(r[2] for r in part if r[1] == k) for k in range(classes))

    def risk(part):
        c = counts(part)
        return tr._impurity(growth.impurity, c, weights), sum(x * w for x, w in zip(c, weights))

    def walk(node, part, depth):
        nodes[tree, node] = tr.Node(counts(part))
        imp, weight = risk(part)
        if depth == growth.depth or imp <= 1e-9 or sum(counts(part)) < max(2, 2 * least):
            return
        ranks, best = tr.feature_order(tree, node, len(FEATURES)), None
        for f in range(len(FEATURES)):
            seen = sorted({r[3][f] for r in part if r[2]})
            for lo, hi in zip(seen, seen[1:]):
                cut = lo + (hi - lo) / 2
                sides = [[r for r in part if (r[3][f] <= cut) == side] for side in (True, False)]
                if min(sum(counts(s)) for s in sides) < least:
                    continue
                worth = imp - sum(i * w for i, w in map(risk, sides)) / weight
                late = max(0, ranks[f] + 1 - (growth.tried or len(FEATURES)))
                key = (late, -round(worth, 9), f, cut)
                if best is None or key < best[0]:
                    best = key, sides
        if best and best[0][1] <= 0:
            nodes[tree, node] = tr.Node(counts(part), best[0][2], best[0][3])
            walk(2 * node, best[1][0], depth + 1)
            walk(2 * node + 1, best[1][1], depth + 1)

    walk(1, rows, 0)
    return nodes, {tree: weights}


GROWTHS = [
    tr.Growth(leaf_share=0.1),
    tr.Growth("entropy", depth=4, leaf_rows=3, tried=1),
    tr.Growth("variance", depth=3, leaf_rows=2, balanced=False),
]


@pytest.mark.parametrize("growth", GROWTHS)
@pytest.mark.parametrize("window", [0, 10**6])
def test_grown_trees_are_those_of_a_full_search(spark, monkeypatch, growth, window):
    monkeypatch.setattr(tr, "WINDOW_ROWS", window)
    rows = sample(90, 1)
    got = tr.grow(frame(spark, rows), FEATURES, 3, growth)
    nodes, weights = plain_tree(rows, growth, 3)
    assert got.weights == weights and got.nodes.keys() == nodes.keys() and len(nodes) > 4
    for key, node in nodes.items():
        assert (got.nodes[key].counts, got.nodes[key].feature) == (node.counts, node.feature)
        assert node.threshold is None or isclose(got.nodes[key].threshold, node.threshold)


def test_several_trees_and_predictions(spark):
    rows = [(t, *r[1:]) for t in range(3) for r in sample(60, t)]
    growth = tr.Growth("gini", depth=5, leaf_rows=4, tried=2)
    got = tr.grow(frame(spark, rows), FEATURES, 3, growth)
    for t in range(3):
        nodes, _ = plain_tree([r for r in rows if r[0] == t], growth, 3, t)
        assert {k: v.counts for k, v in got.nodes.items() if k[0] == t} == {k: v.counts for k, v in nodes.items()}
    asked = [(i, t, [float(i % 6), i % 5 / 2, i / 40]) for i in range(40) for t in range(3)]
    out = tr.predict(spark.createDataFrame(asked, "id int, tree int, values array<double>"), got, 3, ["id"])
    for r in out.collect():
        shares = [0.0] * 3
        for i, t, v in asked:
            if i == r.id:
                n = 1
                while got.nodes[t, n].feature is not None:
                    x = got.nodes[t, n]
                    n = 2 * n + (v[x.feature] > x.threshold)
                parts = [c * w for c, w in zip(got.nodes[t, n].counts, got.weights[t])]
                shares = [s + p / sum(parts) / 3 for s, p in zip(shares, parts)]
        rounded = [round(s, 9) for s in shares]
        assert r.prediction == rounded.index(max(rounded))
        assert isclose(r.estimate, sum(k * s for k, s in enumerate(shares)))


def subtrees(trees, node=1):
    """Leaf sets of all subtrees with the same root."""
    if trees.nodes[0, node].feature is None:
        return [{node}]
    both = [a | b for a in subtrees(trees, 2 * node) for b in subtrees(trees, 2 * node + 1)]
    return [{node}, *both]


def test_pruning_against_all_subtrees(spark):
    growth = tr.Growth("entropy", depth=4, leaf_rows=2)
    grown = tr.grow(frame(spark, sample(120, 7, noise=2.5)), FEATURES, 3, growth)
    risks, every = tr._risks(grown, 0), subtrees(grown)
    assert len(every) > 20 and tr.pruned(grown, 0.0) is grown
    path = tr.pruning_path(grown, 0)
    alphas = [a for a, _ in path]
    assert alphas == sorted(alphas) and path[-1][1].leaves(0) == [1]
    for (_, larger), (_, smaller) in zip(path, path[1:]):
        assert smaller.nodes.keys() < larger.nodes.keys()
    between = [(a + b) / 2 for a, b in zip(alphas, alphas[1:]) if b > a + 1e-9]
    for alpha in [*between, alphas[-1] + 1]:
        cost = min((round(sum(risks[n] for n in s) + alpha * len(s), 12), len(s), sorted(s)) for s in every)
        assert sorted(tr.pruned(grown, alpha).leaves(0)) == cost[2]
    assert all(a.nodes.keys() >= b.nodes.keys() for a, b in combinations([t for _, t in path], 2))


def test_importances_rules_and_edges(spark):
    rows = sample(80, 3)
    grown = tr.grow(frame(spark, rows), FEATURES, 3, tr.Growth(leaf_share=0.1))
    found = dict(tr.importances(grown))
    assert isclose(sum(found.values()), 1.0) and max(found, key=found.get) in ("a", "b")
    lines = tr.rules(grown, 0, 3)
    assert sum("class:" in x for x in lines) == len(grown.leaves(0)) and "<=" in lines[0]
    one = tr.grow(frame(spark, [(0, 1, 1, [1.0, 1.0, 1.0])] * 5), FEATURES, 3, tr.Growth())
    assert list(one.nodes) == [(0, 1)] and one.leaves(0) == [1] and tr.pruned(one, 0.5).nodes == one.nodes
    assert tr.grow(frame(spark, []), FEATURES, 3, tr.Growth()).nodes == {}
    flat = [(0, k % 2, 1, [1.0, 2.0, 3.0]) for k in range(10)]  # no value to cut between
    assert list(tr.grow(frame(spark, flat), FEATURES, 2, tr.Growth()).nodes) == [(0, 1)]
    with pytest.raises(Exception, match="finite values"):
        tr.grow(frame(spark, [(0, 1, 1, [float("nan"), 1.0, 1.0])]), FEATURES, 3, tr.Growth())
