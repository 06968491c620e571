"""Check SQL of the tree models: the same search, written out level by level."""

from __future__ import annotations

from cellmetry.operators.trees import Growth
from cellmetry.plans.registry import check, sq


def _impurity(kind: str, parts: list[str]) -> str:
    total = "(" + " + ".join(parts) + ")"
    if kind == "variance":
        first = " + ".join(f"{k} * {p}" for k, p in enumerate(parts))
        second = " + ".join(f"{k * k} * {p}" for k, p in enumerate(parts))
        return f"(({second}) / {total} - (({first}) / {total}) * (({first}) / {total}))"
    if kind == "gini":
        return "(1 - (" + " + ".join(f"({p} / {total}) * ({p} / {total})" for p in parts) + "))"
    terms = [f"CASE WHEN {p} > 0 THEN ({p} / {total}) * log2({p} / {total}) ELSE 0 END" for p in parts]
    return "(-(" + " + ".join(terms) + "))"


def levels(growth: Growth, classes: int, features: int, depth: int, name: str = "") -> list[tuple[str, str]]:
    """Named parts from rows_in (id, part, tree, label, copies, vals) to nodes and rows_out.

    nodes has (tree, node, t0.., feature, threshold, risk) and rows_out the leaf of every row.
    """
    ks = range(classes)
    balance = ", ".join(
        f"""CASE WHEN {'true' if growth.balanced else 'false'} THEN CASE WHEN count(*) FILTER (label = {k}) > 0
        THEN count(*) / CAST({classes} * count(*) FILTER (label = {k}) AS DOUBLE) ELSE 0.0 END ELSE 1.0 END AS w{k}"""
        for k in ks
    )
    parts = [
        (
            f"{name}wt",
            f"""SELECT tree, {balance}, greatest({growth.leaf_rows},
            ceil({growth.leaf_share} * sum(copies) - 1e-9)) AS least FROM {name}rows_in WHERE part = 'train' GROUP BY tree""",
        ),
        (f"{name}rows_0", f"SELECT *, CAST(1 AS BIGINT) AS node FROM {name}rows_in"),
    ]
    side = lambda prefix: [f"{prefix}{k} * w{k}" for k in ks]
    size = lambda prefix: " + ".join(f"{prefix}{k}" for k in ks)
    weight = lambda prefix: "(" + " + ".join(side(prefix)) + ")"
    tried = growth.tried or features
    for d in range(depth + 1):
        count = ", ".join(f"CAST(sum(CASE WHEN label = {k} THEN copies ELSE 0 END) AS BIGINT) AS {{}}{k}" for k in ks)
        counted = count.replace("{}", "t"), count.replace("{}", "c")
        parts.append(
            (
                f"{name}tot_{d}",
                f"""SELECT s.*, w.* EXCLUDE (tree), CASE WHEN {size('t')} > 0 THEN {_impurity(growth.impurity, side('t'))}
                ELSE 0 END AS imp FROM (SELECT tree, node, {counted[0]} FROM {name}rows_{d}
                WHERE part = 'train' AND node >= {1 << d} GROUP BY tree, node) s JOIN {name}wt w ON s.tree = w.tree""",
            )
        )
        if d == depth:
            parts.append((f"{name}best_{d}", f"SELECT tree, node, 0 AS feature, 0.0 AS threshold FROM {name}tot_{d} WHERE false"))
            break
        parts.append(
            (
                f"{name}val_{d}",
                f"""SELECT tree, node, f - 1 AS feature, vals[f] AS v, {counted[1]} FROM {name}rows_{d},
                (SELECT unnest(range(1, {features + 1})) AS f) WHERE part = 'train' AND copies > 0 AND node >= {1 << d}
                GROUP BY tree, node, f, vals[f]""",
            )
        )
        upto = ", ".join(
            f"CAST(sum(c{k}) OVER (PARTITION BY tree, node, feature ORDER BY v ROWS UNBOUNDED PRECEDING) AS BIGINT) AS l{k}"
            for k in ks
        )
        right = ", ".join(f"t{k} - l{k} AS r{k}" for k in ks)
        gain = f"""round(imp - ({weight('l')} * {_impurity(growth.impurity, side('l'))}
            + {weight('r')} * {_impurity(growth.impurity, side('r'))}) / {weight('t')}, 9)"""
        parts += [
            (
                f"{name}cut_{d}",
                f"""SELECT *, v + (nxt - v) / 2 AS threshold, {right} FROM (SELECT tree, node, feature, v, {upto},
                lead(v) OVER (PARTITION BY tree, node, feature ORDER BY v) AS nxt FROM {name}val_{d}) q
                JOIN {name}tot_{d} USING (tree, node) WHERE nxt IS NOT NULL AND imp > 1e-9
                AND {size('t')} >= greatest(2, 2 * least)""",
            ),
            (
                f"{name}late_{d}",
                f"""SELECT tree, node, f AS feature, greatest(0, row_number() OVER (PARTITION BY tree, node
                ORDER BY md5(concat(tree, '|', node, '|', f)), f) - {tried}) AS late
                FROM {name}tot_{d}, (SELECT unnest(range({features})) AS f)""",
            ),
            (
                f"{name}best_{d}",
                f"""SELECT tree, node, feature, threshold FROM (SELECT *, row_number() OVER (PARTITION BY tree, node
                ORDER BY late, gain DESC, feature, threshold) AS i FROM (SELECT c.*, late, {gain} AS gain
                FROM {name}cut_{d} c JOIN {name}late_{d} USING (tree, node, feature)
                WHERE {size('l')} >= least AND {size('r')} >= least)) WHERE i = 1 AND gain >= 0""",
            ),
            (
                f"{name}rows_{d + 1}",
                f"""SELECT r.* EXCLUDE (node), CASE WHEN b.feature IS NULL THEN r.node
                WHEN r.vals[b.feature + 1] <= b.threshold THEN 2 * r.node ELSE 2 * r.node + 1 END AS node
                FROM {name}rows_{d} r LEFT JOIN {name}best_{d} b ON r.tree = b.tree AND r.node = b.node""",
            ),
        ]
    parts.append(
        (
            f"{name}nodes",
            " UNION ALL ".join(
                f"""SELECT t.*, b.feature, b.threshold FROM {name}tot_{d} t LEFT JOIN {name}best_{d} b
                ON t.tree = b.tree AND t.node = b.node"""
                for d in range(depth + 1)
            ),
        )
    )
    whole = f"(SELECT tree AS in_tree, {weight('t')} AS whole FROM {name}nodes WHERE node = 1)"
    parts.append(
        (
            f"{name}risky",
            f"SELECT n.*, imp * {weight('t')} / whole AS risk FROM {name}nodes n JOIN {whole} ON n.tree = in_tree",
        )
    )
    return parts


def pruned(alpha: float, depth: int, name: str = "") -> list[tuple[str, str]]:
    """keep (tree, node, ..., inner) of the subtrees of least risk plus alpha per leaf."""
    parts = []
    for d in range(depth, -1, -1):
        below = (
            f"(SELECT tree, node // 2 AS up, sum(cost) AS cost FROM {name}cost_{d + 1} GROUP BY tree, node // 2)"
            if d < depth
            else "(SELECT 0 AS tree, 0 AS up, 0.0 AS cost WHERE false)"
        )
        parts.append(
            (
                f"{name}cost_{d}",
                f"""SELECT r.tree, r.node, least(risk + {alpha}, coalesce(k.cost, risk + {alpha})) AS cost,
                coalesce(k.cost < risk + {alpha} - 1e-12, false) AS inner FROM {name}risky r
                LEFT JOIN {below} k ON r.tree = k.tree AND r.node = k.up
                WHERE r.node >= {1 << d} AND r.node < {2 << d}""",
            )
        )
    every = " UNION ALL ".join(f"SELECT * FROM {name}cost_{d}" for d in range(depth + 1))
    parts.append((f"{name}cost", every))
    parts.append(
        (
            f"{name}keep",
            f"""SELECT r.*, c.inner FROM {name}risky r JOIN {name}cost c ON r.tree = c.tree AND r.node = c.node
            WHERE NOT EXISTS (SELECT 1 FROM {name}cost a, (SELECT unnest(range(1, {depth + 1})) AS up)
            WHERE a.tree = r.tree AND a.node = r.node >> up AND NOT a.inner)""",
        )
    )
    return parts


def whole_trees(name: str = "") -> list[tuple[str, str]]:
    """keep of trees that are not pruned."""
    return [(f"{name}keep", f"SELECT *, feature IS NOT NULL AS inner FROM {name}risky")]


def scored(classes: int, depth: int, by: str, name: str = "") -> list[tuple[str, str]]:
    """scored (by, prediction, estimate): mean shares of the leaves that a row reaches."""
    ks = range(classes)
    total = "(" + " + ".join(f"t{k} * w{k}" for k in ks) + ")"
    means = ", ".join(f"avg(t{k} * w{k} / {total}) AS p{k}" for k in ks)
    mean = " + ".join(f"{k} * (t{k} * w{k} / {total})" for k in ks)
    listed = "[" + ", ".join(f"round(p{k}, 9)" for k in ks) + "]"
    up = "CAST(floor(log2(r.node)) - floor(log2(k.node)) AS BIGINT)"
    return [
        (
            f"{name}scored",
            f"""SELECT {by}, CAST(list_position({listed}, list_max({listed})) - 1 AS BIGINT) AS prediction, estimate
            FROM (SELECT {by}, {means}, avg({mean}) AS estimate FROM (SELECT r.id, r.part, r.label, k.*
            FROM {name}rows_{depth} r JOIN {name}keep k ON r.tree = k.tree AND NOT k.inner AND r.node >= k.node
            AND r.node >> {up} = k.node) GROUP BY {by})""",
        )
    ]


CLASSES = 4
#: A leaf of a fold's tree has a tenth of the rows at least, so no path has more than nine cuts.
FOLD_DEPTH = 9


def _values(features: list[str], circularities: dict[str, str]) -> str:
    return "[" + ", ".join(circularities.get(f, f) for f in features) + "]"


def _class_scores(keys: str) -> str:
    """Per key and class: tp, support, claimed and the scores made of them."""
    return f"""SELECT *, CASE WHEN rec + prec > 0 THEN 2 * rec * prec / (rec + prec) ELSE 0.0 END AS f1 FROM (
    SELECT *, CASE WHEN support > 0 THEN tp / CAST(support AS DOUBLE) ELSE 0.0 END AS rec,
    CASE WHEN claimed > 0 THEN tp / CAST(claimed AS DOUBLE) ELSE 0.0 END AS prec FROM (
    SELECT {keys}, c, count(*) FILTER (label = c AND prediction = c) AS tp, count(*) FILTER (label = c) AS support,
    count(*) FILTER (prediction = c) AS claimed FROM scored, (SELECT unnest(range({CLASSES})) AS c)
    GROUP BY {keys}, c))"""


def held_out(growth: Growth, alpha: float, number: int, drawn: list[float], features, circularities, numbered: str):
    """Named parts of trees on the train part of a holdout split, up to keep and scored."""
    at = "CAST(('0x' || substr(md5(concat(id, '|', tree)), 1, 8)) AS BIGINT) / 4294967296.0"
    copies = " + ".join(f"CASE WHEN {at} >= {share!r} THEN 1 ELSE 0 END" for share in drawn) if number > 1 else "1"
    rows = f"""SELECT id, part, tree, label, vals, {copies} AS copies FROM (SELECT f.vec_id AS id, f.label,
    CASE WHEN i <= floor(n * CAST(0.3 AS DOUBLE) + 0.5) THEN 'test' ELSE 'train' END AS part,
    {_values(features, circularities)} AS vals FROM feat f JOIN ({numbered}) o ON f.vec_id = o.vec_id),
    (SELECT unnest(range({number})) AS tree)"""
    parts = [("rows_in", rows), *levels(growth, CLASSES, len(features), growth.depth)]
    return [*parts, *pruned(alpha, growth.depth), *scored(CLASSES, growth.depth, "id, part, label")]


def report_check(parts: list[tuple[str, str]]) -> str:
    micro = "CAST(sum(tp) AS DOUBLE) / sum(support)"
    columns = {
        "accuracy": micro,
        "bal_accuracy": "avg(CASE WHEN support > 0 THEN rec END)",
        "global_precision": micro,
        "weighted_precision": "sum(prec * support) / sum(support)",
        "global_recall": micro,
        "weighted_recall": "sum(rec * support) / sum(support)",
        "global_f1_score": micro,
        "weighted_f1_score": "sum(f1 * support) / sum(support)",
    }
    named = ", ".join(f"{sq(v)} AS {k}" for k, v in columns.items())
    body = f"SELECT {named}, part FROM ({_class_scores('part')}) GROUP BY part"
    return check(["feat"], body, *parts)


def importance_check(parts: list[tuple[str, str]], features: list[str]) -> str:
    """Risk taken away by each feature, shares of 1 in each tree, the mean over the trees."""
    own = """SELECT k.tree, k.feature, k.risk - sum(c.risk) AS gain FROM keep k JOIN keep c
    ON k.tree = c.tree AND c.node // 2 = k.node WHERE k.inner GROUP BY k.tree, k.node, k.feature, k.risk"""
    share = f"""SELECT tree, feature, sum(gain) / sum(sum(gain)) OVER (PARTITION BY tree) AS s
    FROM ({own}) GROUP BY tree, feature"""
    names = "[" + ", ".join(f"'{f}'" for f in features) + "]"
    body = f"""SELECT {names}[f + 1] AS feature, {sq('coalesce(s, 0) / sum(coalesce(s, 0)) OVER ()')} AS importance
    FROM (SELECT unnest(range({len(features)})) AS f) LEFT JOIN
    (SELECT feature, sum(s) AS s FROM ({share}) GROUP BY feature) g ON g.feature = f"""
    return check(["feat"], body, *parts)


def folds(growth: Growth, features, circularities, numbered: str, name: str = "") -> list[tuple[str, str]]:
    """Named parts of one tree per fold, up to keep."""
    rows = f"""SELECT f.vec_id AS id, CASE WHEN (i - 1) % 5 = tree THEN 'val' ELSE 'train' END AS part, tree, f.label,
    1 AS copies, {_values(features, circularities)} AS vals FROM feat f JOIN ({numbered}) o ON f.vec_id = o.vec_id,
    (SELECT unnest(range(5)) AS tree)"""
    return [
        (f"{name}rows_in", rows),
        *levels(growth, CLASSES, len(features), FOLD_DEPTH, name),
        *whole_trees(name),
    ]


def cv_check(classes: list[tuple[str, str]], values: list[tuple[str, str]]) -> str:
    by = "id, part, label, tree"
    parts = [*classes, *scored(CLASSES, FOLD_DEPTH, by), *values, *scored(CLASSES, FOLD_DEPTH, by, "reg_")]
    body = f"""SELECT tree AS fold, part, {sq('accuracy')} AS accuracy, {sq('macro_f1')} AS macro_f1, {sq('mse')} AS mse
    FROM (SELECT tree, part, CAST(sum(tp) AS DOUBLE) / sum(support) AS accuracy,
    avg(CASE WHEN support + claimed > 0 THEN 2.0 * tp / (support + claimed) END) AS macro_f1
    FROM ({_class_scores('tree, part')}) GROUP BY tree, part) JOIN
    (SELECT tree, part, avg((label - estimate) * (label - estimate)) AS mse FROM reg_scored GROUP BY tree, part)
    USING (tree, part)"""
    return check(["feat"], body, *parts)


def rules_check(parts: list[tuple[str, str]], features: list[str]) -> str:
    ks = range(CLASSES)
    listed = "[" + ", ".join(f"round(t{k} * w{k}, 9)" for k in ks) + "]"
    names = "[" + ", ".join(f"'{f}'" for f in features) + "]"
    body = f"""SELECT CAST(tree AS BIGINT) AS fold, node, {names}[feature + 1] AS feature, {sq('threshold')} AS threshold,
    {' + '.join(f't{k}' for k in ks)} AS n, CAST(list_position({listed}, list_max({listed})) - 1 AS BIGINT) AS predicted
    FROM keep"""
    return check(["feat"], body, *parts)


def frequency_check(parts: list[tuple[str, str]], features: list[str]) -> str:
    names = "[" + ", ".join(f"'{f}'" for f in features) + "]"
    body = f"""SELECT {names}[feature + 1] AS feature, count(DISTINCT tree) AS n_folds,
    string_agg(DISTINCT CAST(tree AS VARCHAR), ',' ORDER BY CAST(tree AS VARCHAR)) AS folds
    FROM keep WHERE feature IS NOT NULL GROUP BY feature"""
    return check(["feat"], body, *parts)
