"""Queries for segmentation scores, splits, statistics and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellmetry.functions.names import BASE_FEATURES, CIRCULARITY_FEATURES, CYTO_FEATURES
from cellmetry.operators import evaluate, ml, relational, splits, stats
from cellmetry.plans import tree_checks
from cellmetry.plans.registry import check, query, r6, rounded, sq
from cellmetry.sources import derived

# ---------------------------------------------------------------- segmentation


def _overlap(spark, sf):
    return evaluate.instance_overlap(derived.pixels(spark, sf), derived.predicted_mask(spark, sf))


@query("instance_overlap", check(["overlap"], "SELECT * FROM overlap"))
def _(spark, sf):
    return _overlap(spark, sf)


@query(
    "scored_pairs",
    check(["scored"], 'SELECT image_id, obj, pred, inter, area_gt, area_pred, uni AS "union" FROM scored'),
)
def _(spark, sf):
    return evaluate.scored_pairs(_overlap(spark, sf))


@query(
    "greedy_match",
    check(["matched"], f"SELECT image_id, obj, pred, {sq('iou')} AS iou FROM matched"),
)
def _(spark, sf):
    matched = evaluate.greedy_match(_overlap(spark, sf))
    return rounded(matched.select("image_id", "obj", "pred", "iou"), "iou")


@query("greedy_match_low_threshold")
def _(spark, sf):
    """Threshold 0.2 on masks with several partners; compared with the plain greedy loop in the tests."""
    truth, pred = derived.crowded_masks(spark, sf)
    matched = evaluate.greedy_match(evaluate.instance_overlap(truth, pred), 1, 5)
    return rounded(matched.select("image_id", "obj", "pred", "iou"), "iou")




def _segm_columns(f: str) -> str:
    f1 = "CASE WHEN prec + rec > 0 THEN 2.0 * prec * rec / (prec + rec) ELSE 0.0 END"
    values = {"iou": "iou", "dice": "dice", "precision": "prec", "recall": "rec", "f1": f1, "mae": "mae"}
    return ", ".join(f'{sq(f.format(v))} AS "{k}"' for k, v in values.items())


@query(
    "segmentation_metrics",
    check(["segm"], f"SELECT image_id, {_segm_columns('{}')} FROM segm"),
)
def _(spark, sf):
    overlap = _overlap(spark, sf)
    metrics = evaluate.segmentation_metrics(overlap, evaluate.greedy_match(overlap))
    return rounded(metrics, "iou", "dice", "precision", "recall", "f1", "mae")


@query(
    "segmentation_summary",
    check(["segm"], f"SELECT {_segm_columns('avg({})')} FROM segm"),
)
def _(spark, sf):
    overlap = _overlap(spark, sf)
    metrics = evaluate.segmentation_metrics(overlap, evaluate.greedy_match(overlap))
    return rounded(
        evaluate.segmentation_summary(metrics), "iou", "dice", "precision", "recall", "f1", "mae"
    )


# ---------------------------------------------------------------- classes

_COUNTS = """SELECT label, count(vec_id) AS n FROM (SELECT unnest(range(5)) AS label)
    LEFT JOIN feat USING (label) GROUP BY label"""


@query("class_counts", check(["feat"], _COUNTS))
def _(spark, sf):
    return evaluate.class_counts(derived.features(spark, sf), 5)


@query(
    "class_weights",
    check(
        ["feat"],
        f"""SELECT label, {sq('CASE WHEN n > 0 THEN CAST(sum(n) OVER () AS DOUBLE) / (5.0 * n) ELSE 0.0 END')}
        AS weight FROM ({_COUNTS})""",
    ),
)
def _(spark, sf):
    return rounded(evaluate.class_weights(derived.features(spark, sf), 5), "weight")


@query(
    "confusion_matrix",
    check(
        ["confusion"],
        f"""SELECT label, predicted, n, {sq('''CASE WHEN sum(n) OVER (PARTITION BY label) > 0
        THEN n / CAST(sum(n) OVER (PARTITION BY label) AS DOUBLE) ELSE 0.0 END''')} AS share FROM confusion""",
    ),
)
def _(spark, sf):
    return rounded(evaluate.confusion_matrix(derived.features(spark, sf), 5), "share")


@query(
    "balanced_metrics",
    check(
        ["classscore"],
        f"""SELECT {sq('avg(rec)')} AS balanced_accuracy, {sq('avg(prec)')} AS balanced_precision,
        {sq('avg(f1)')} AS balanced_f1 FROM classscore""",
    ),
)
def _(spark, sf):
    confusion = evaluate.confusion_matrix(derived.features(spark, sf), 5)
    scores = evaluate.balanced_metrics(confusion)
    return rounded(scores, *scores.columns)


@query(
    "classification_report",
    check(
        ["classscore"],
        ("SELECT "
        + ", ".join(
            f"{sq(v)} AS {k}"
            for k, v in {
                "accuracy": "CAST(sum(tp) AS DOUBLE) / sum(support)",
                "bal_accuracy": "avg(CASE WHEN support > 0 THEN rec END)",
                "global_precision": "CAST(sum(tp) AS DOUBLE) / sum(claimed)",
                "weighted_precision": "sum(prec * support) / sum(support)",
                "global_recall": "CAST(sum(tp) AS DOUBLE) / sum(support)",
                "weighted_recall": "sum(rec * support) / sum(support)",
                "global_f1_score": "CAST(sum(tp) AS DOUBLE) / sum(support)",
                "weighted_f1_score": "sum(f1 * support) / sum(support)",
            }.items()
        )
        + " FROM classscore"),
    ),
)
def _(spark, sf):
    confusion = evaluate.confusion_matrix(derived.features(spark, sf), 5)
    report = evaluate.classification_report(confusion)
    return rounded(report, *report.columns)


@query(
    "macro_f1",
    check(
        ["classscore"],
        f"SELECT {sq('avg(CASE WHEN support > 0 OR claimed > 0 THEN f1 END)')} AS macro_f1 FROM classscore",
    ),
)
def _(spark, sf):
    confusion = evaluate.confusion_matrix(derived.features(spark, sf), 5)
    return rounded(evaluate.macro_f1(confusion), "macro_f1")


@query(
    "mse",
    check(
        ["feat"],
        f"""SELECT {sq('''avg((CAST(label AS DOUBLE) - CAST(predicted AS DOUBLE))
        * (CAST(label AS DOUBLE) - CAST(predicted AS DOUBLE)))''')} AS mse FROM feat""",
    ),
)
def _(spark, sf):
    return rounded(evaluate.mean_squared_error(derived.features(spark, sf), "label", "predicted"), "mse")


# ---------------------------------------------------------------- splits


def _order(group: str = "") -> str:
    part = f"PARTITION BY {group} " if group else ""
    return f"({part}ORDER BY md5(concat(vec_id, '|42')), vec_id)"


def _numbered(group: str = "") -> str:
    part = f"PARTITION BY {group}" if group else ""
    return f"""SELECT vec_id, label, row_number() OVER {_order(group)} AS i,
    count(*) OVER ({part}) AS n FROM feat"""


_PART = """CASE WHEN i <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN i <= floor(n * CAST(0.7 AS DOUBLE))
    + floor(n * CAST(0.15 AS DOUBLE)) THEN 'val' ELSE 'test' END AS part"""


def _samples(spark, sf):
    return derived.features(spark, sf).select("vec_id", "label")


@query("random_split", check(["feat"], f"SELECT vec_id, label, {_PART} FROM ({_numbered()})"))
def _(spark, sf):
    return splits.random_split(_samples(spark, sf), "vec_id")


@query("stratified_split", check(["feat"], f"SELECT vec_id, label, {_PART} FROM ({_numbered('label')})"))
def _(spark, sf):
    return splits.stratified_split(_samples(spark, sf), "vec_id")


@query(
    "stratified_kfold",
    check(["feat"], f"SELECT vec_id, label, (i - 1) % 5 AS fold FROM ({_numbered('label')})"),
)
def _(spark, sf):
    return splits.stratified_kfold(_samples(spark, sf), "vec_id")


@query(
    "kfold_expand",
    check(
        ["feat"],
        f"""SELECT vec_id, label, fold, round, CASE WHEN fold = round THEN 'val' ELSE 'train' END AS part
        FROM (SELECT vec_id, label, (i - 1) % 5 AS fold FROM ({_numbered('label')})),
        (SELECT unnest(range(5)) AS round)""",
    ),
)
def _(spark, sf):
    return splits.kfold_expand(splits.stratified_kfold(_samples(spark, sf), "vec_id"))


@query(
    "holdout_split",
    check(
        ["feat"],
        f"""SELECT vec_id, label, CASE WHEN i <= floor(n * CAST(0.3 AS DOUBLE) + 0.5) THEN 'test'
        ELSE 'train' END AS part FROM ({_numbered('label')})""",
    ),
)
def _(spark, sf):
    return splits.holdout_split(_samples(spark, sf), "vec_id")


@query(
    "batch_index",
    check(["feat"], f"SELECT vec_id, label, (i - 1) // 32 AS batch FROM ({_numbered()})"),
)
def _(spark, sf):
    return splits.batch_index(_samples(spark, sf), "vec_id")


# ---------------------------------------------------------------- scaling, ranks


def _scaled(expression: str) -> str:
    return "SELECT vec_id, " + ", ".join(
        f"{sq(expression.format(c=c))} AS {c}" for c in BASE_FEATURES
    ) + " FROM feat, (SELECT " + ", ".join(
        f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s, min({c}) AS {c}_lo, max({c}) AS {c}_hi"
        for c in BASE_FEATURES
    ) + " FROM feat)"


@query("standard_scale", check(["feat"], _scaled("({c} - {c}_m) / {c}_s")))
def _(spark, sf):
    scaled = stats.standard_scale(derived.features(spark, sf), BASE_FEATURES)
    return rounded(scaled.select("vec_id", *BASE_FEATURES), *BASE_FEATURES)


@query("minmax_scale", check(["feat"], _scaled("({c} - {c}_lo) / ({c}_hi - {c}_lo)")))
def _(spark, sf):
    scaled = stats.minmax_scale(derived.features(spark, sf), BASE_FEATURES)
    return rounded(scaled.select("vec_id", *BASE_FEATURES), *BASE_FEATURES)


_TIED = "SELECT vec_id, label, tx, feature, floor(value * 20) AS value FROM featrow"
_RANKED = """SELECT *, rank() OVER (PARTITION BY feature ORDER BY value)
    + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE AS rank FROM tied"""


def _tied(spark, sf):
    """Features cut to whole steps, so that ties are common."""
    return derived.features(spark, sf).withColumns(
        {c: F.floor(F.col(c) * 20).cast("double") for c in BASE_FEATURES}
    )


@query(
    "tied_ranks",
    check(
        ["featrow"],
        "SELECT vec_id, feature, value, rank FROM ranked",
        ("tied", _TIED),
        ("ranked", _RANKED),
    ),
)
def _(spark, sf):
    return stats.tied_ranks(_tied(spark, sf), BASE_FEATURES, "vec_id")


_TERMS = [
    ("tied", _TIED),
    ("ranked", _RANKED),
    (
        "tieterm",
        """SELECT feature, CAST(sum(t) AS DOUBLE) AS n, sum(CAST(t AS DOUBLE) * t * t - t) AS ties FROM (
        SELECT feature, value, count(*) AS t FROM tied GROUP BY feature, value) GROUP BY feature""",
    ),
    (
        "classrank",
        """SELECT feature, label, CAST(count(*) AS DOUBLE) AS m, sum(rank) AS r FROM ranked
        GROUP BY feature, label""",
    ),
    (
        "kruskal",
        """SELECT feature, (12.0::DOUBLE / (n * (n + 1)) * s - 3.0 * (n + 1)) / (1.0 - ties / (n * n * n - n)) AS h
        FROM (SELECT feature, sum(r * r / m) AS s FROM classrank GROUP BY feature) JOIN tieterm USING (feature)""",
    ),
]


def _erfc(x: str) -> str:
    """1 - erf by its series of positive terms (the check needs no more than |x| < 6)."""
    return f"""(1.0 - CASE WHEN {x} = 0 THEN 0.0 ELSE 2 / sqrt(pi()) * exp(-({x}) * ({x})) * list_sum(
    list_transform(range(160), lambda k: exp(2 * k * ln(2.0::DOUBLE) + (2 * k + 1) * ln({x})
    + lgamma(k + 1) - lgamma(2 * k + 2)))) END)"""


_P3 = _erfc("sqrt(h / 2)") + " + sqrt(2 * h / pi()) * exp(-h / 2)"


@query(
    "kruskal_wallis",
    check(
        ["featrow"],
        f"SELECT feature, {sq('h')} AS statistic, {sq(_P3)} AS p_value FROM kruskal",
        *_TERMS,
    ),
)
def _(spark, sf):
    return rounded(stats.kruskal_wallis(_tied(spark, sf), BASE_FEATURES), "statistic", "p_value")


@query(
    "dunn_posthoc",
    check(
        ["featrow"],
        f"""SELECT feature, class_a, class_b, {sq('z')} AS z,
        {sq(f"least(6 * {_erfc('abs(z) / sqrt(2)')}, 1.0)")} AS p_adjusted FROM (
        SELECT a.feature, a.label AS class_a, b.label AS class_b, (a.r / a.m - b.r / b.m)
        / sqrt((n * (n + 1) / 12.0 - ties / (12.0 * (n - 1))) * (1 / a.m + 1 / b.m)) AS z
        FROM classrank a JOIN classrank b ON a.feature = b.feature AND a.label < b.label
        JOIN tieterm t ON t.feature = a.feature JOIN kruskal k ON k.feature = a.feature WHERE {_P3} < 0.4)""",
        *_TERMS,
    ),
)
def _(spark, sf):
    tested = stats.dunn_posthoc(_tied(spark, sf), BASE_FEATURES, level=0.4)
    return rounded(tested, "z", "p_adjusted")


@query(
    "feature_quantiles",
    check(
        ["featrow"],
        "SELECT tx, label, feature, count(*) AS n, "
        + ", ".join(
            f"{sq(f'quantile_cont(value, {q})')} AS q{int(q * 100)}" for q in (0.0, 0.25, 0.5, 0.75, 1.0)
        )
        + " FROM featrow GROUP BY tx, label, feature",
    ),
)
def _(spark, sf):
    quantiles = stats.feature_quantiles(derived.features(spark, sf), BASE_FEATURES, ["tx", "label"])
    return rounded(quantiles, "q0", "q25", "q50", "q75", "q100")


# ---------------------------------------------------------------- silhouettes


_SQUARED = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in BASE_FEATURES)


def _silhouette(pairs: str, distance: str) -> str:
    """Mean silhouette per group g of the joined pairs (a, b)."""
    return f"""SELECT g, avg(CASE WHEN own_n = 1 THEN 0.0 WHEN greatest(a, b) = 0 THEN 0.0
    ELSE (b - a) / greatest(a, b) END) AS s FROM (SELECT g, id,
    max(CASE WHEN own THEN n END) AS own_n, max(CASE WHEN own THEN total / (n - 1) END) AS a,
    min(CASE WHEN NOT own THEN total / n END) AS b FROM (SELECT g, id, own, other, count(*) AS n,
    sum({distance}) AS total FROM ({pairs}) GROUP BY g, id, own, other) GROUP BY g, id) GROUP BY g"""


@query(
    "silhouette",
    check(
        ["feat"],
        f"SELECT {sq('s')} AS silhouette FROM ("
        + _silhouette(
            """SELECT 1 AS g, a.vec_id AS id, a.label = b.label AS own, b.label AS other, """
            + _SQUARED
            + """ AS d FROM feat a, feat b""",
            "sqrt(d)",
        )
        + ")",
    ),
)
def _(spark, sf):
    return rounded(
        ml.silhouette(derived.features(spark, sf), "vec_id", "label", BASE_FEATURES), "silhouette"
    )


@query(
    "silhouette_feature_pairs",
    check(
        ["featrow"],
        f"SELECT split_part(g, '|', 1) AS feature_a, split_part(g, '|', 2) AS feature_b, {sq('s')} AS silhouette FROM ("
        + _silhouette(
            """SELECT concat(a.fa, '|', a.fb) AS g, a.vec_id AS id, a.label = b.label AS own, b.label AS other,
            a.va - b.va AS d1, a.vb - b.vb AS d2 FROM two a JOIN two b ON a.fa = b.fa AND a.fb = b.fb""",
            "sqrt(d1 * d1 + d2 * d2)",
        )
        + ")",
        (
            "two",
            "SELECT p.vec_id, p.label, p.feature AS fa, q.feature AS fb, p.value AS va, q.value AS vb"
            " FROM featrow p JOIN featrow q ON p.vec_id = q.vec_id JOIN (VALUES "
            + ", ".join(
                f"('{a}', '{b}')" for i, a in enumerate(BASE_FEATURES) for b in BASE_FEATURES[i + 1 :]
            )
            + ") n(a, b) ON n.a = p.feature AND n.b = q.feature",
        ),
    ),
)
def _(spark, sf):
    return rounded(
        ml.silhouette_feature_pairs(derived.features(spark, sf), "vec_id", "label", BASE_FEATURES),
        "silhouette",
    )


@query(
    "silhouette_squared",
    check(
        ["feat"],
        f"SELECT {sq('s')} AS silhouette FROM ("
        + _silhouette(
            """SELECT 1 AS g, a.vec_id AS id, a.label = b.label AS own, b.label AS other, """
            + _SQUARED
            + """ AS d FROM feat a, feat b""",
            "d",
        )
        + ")",
    ),
)
def _(spark, sf):
    return rounded(
        ml.silhouette_squared(derived.features(spark, sf), "label", BASE_FEATURES), "silhouette"
    )


# ---------------------------------------------------------------- models


@query("kmeans")
def _(spark, sf):
    clustered = ml.kmeans(derived.features(spark, sf), CYTO_FEATURES)
    return clustered.select("vec_id", "label", "cluster")


@query("kmeans_elbow")
def _(spark, sf):
    return ml.kmeans_elbow(derived.features(spark, sf), CYTO_FEATURES)


def _leading(k: int) -> list[tuple[str, str]]:
    """Check SQL of component k: repeated squaring leaves the projector on it, then it is taken out."""
    before = "cov" if k == 1 else f"left{k - 1}"
    return [
        (
            f"proj{k}",
            f"""WITH RECURSIVE s(i, m) AS (SELECT 0, m FROM {before} UNION ALL SELECT i + 1,
            [[list_dot_product(r, c) / list_sum([list_dot_product(d, d) for d in m]) for c in m] for r in m] FROM s WHERE i < 40)
            SELECT m AS p FROM s WHERE i = 40""",
        ),
        (
            f"axis{k}",
            f"""SELECT p, [w / sqrt(p[i][i]) for w in p[i]] AS v FROM (SELECT p,
            (SELECT arg_max(j, p[j][j]) FROM (SELECT unnest(range(1, 15)) AS j)) AS i FROM proj{k})""",
        ),
        (
            f"share{k}",
            f"""SELECT p, v, list_dot_product(v, [list_dot_product(r, v) for r in m]) AS lam
            FROM axis{k}, {before}""",
        ),
        (
            f"left{k}",
            f"""SELECT [[m[i][j] - lam * p[i][j] for j in range(1, 15)] for i in range(1, 15)] AS m FROM share{k}, {before}""",
        ),
    ]


_COMPONENTS = [
    (
        "scaled",
        "SELECT vec_id, label, [" + ", ".join(f"({c} - {c}_m) / {c}_s" for c in BASE_FEATURES) + "] AS z FROM feat, (SELECT "
        + ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in BASE_FEATURES) + " FROM feat)",
    ),
    (
        "cov",
        "SELECT [" + ", ".join(
            "[" + ", ".join(f"sum(z[{i}] * z[{j}]) / count(*)" for j in range(1, 15)) + "]" for i in range(1, 15)
        ) + "] AS m FROM scaled",
    ),
    *[part for k in (1, 2, 3) for part in _leading(k)],
    (
        "scores",
        "SELECT vec_id, label, " + ", ".join(f"list_dot_product(z, share{k}.v) AS pc{k}" for k in (1, 2, 3))
        + " FROM scaled, share1, share2, share3",
    ),
]


@query(
    "pca",
    check(
        ["feat"],
        " UNION ALL ".join(
            f"SELECT CAST({k} AS BIGINT) AS component, {sq(f'lam / {len(BASE_FEATURES)}')} AS ratio FROM share{k}"
            for k in (1, 2, 3)
        ),
        *_COMPONENTS,
    ),
)
def _(spark, sf):
    return rounded(ml.pca(derived.features(spark, sf), BASE_FEATURES), "ratio")


@query(
    "pca_scores",
    check(
        ["feat"],
        "SELECT vec_id, " + ", ".join(f"{sq(f'pc{k}')} AS pc{k}" for k in (1, 2, 3)) + " FROM scores",
        *_COMPONENTS,
    ),
)
def _(spark, sf):
    return rounded(
        ml.pca_scores(derived.features(spark, sf), BASE_FEATURES).select("vec_id", "pc1", "pc2", "pc3"),
        "pc1",
        "pc2",
        "pc3",
    )


@query(
    "silhouette_components",
    check(
        ["feat"],
        f"SELECT {sq('s')} AS silhouette FROM ("
        + _silhouette(
            """SELECT 1 AS g, a.vec_id AS id, a.label = b.label AS own, b.label AS other,
            (a.pc1 - b.pc1) * (a.pc1 - b.pc1) + (a.pc2 - b.pc2) * (a.pc2 - b.pc2)
            + (a.pc3 - b.pc3) * (a.pc3 - b.pc3) AS d FROM scores a, scores b""",
            "sqrt(d)",
        )
        + ")",
        *_COMPONENTS,
    ),
)
def _(spark, sf):
    """Silhouette of the given labels on the three principal components."""
    scores = ml.pca_scores(derived.features(spark, sf), BASE_FEATURES)
    return rounded(ml.silhouette(scores, "vec_id", "label", ["pc1", "pc2", "pc3"]), "silhouette")


TREE_FEATURES = BASE_FEATURES + CIRCULARITY_FEATURES


def _tree_table(spark, sf):
    """The fourteen shape features and both circularities."""
    return relational.add_circularity(derived.features(spark, sf))


# The registered circularity of the tree models guards zero; the SQL repeats it.
_CIRCULAR = {
    c: f"CASE WHEN {r} = 0 THEN NULL ELSE 1.0 / {r} END"
    for c, r in zip(CIRCULARITY_FEATURES, ("cyto_roundness", "nuc_roundness"))
}
_HELD = {
    number: tree_checks.held_out(
        growth, alpha, number, ml.DRAWN, TREE_FEATURES, _CIRCULAR, _numbered("label")
    )
    for growth, alpha, number in (
        (ml.TREE, ml.TREE_ALPHA, 1),
        (ml.FOREST, ml.FOREST_ALPHA, ml.FOREST_TREES),
    )
}
_FOLDS = tree_checks.folds(ml.FOLD_CLASSES, TREE_FEATURES, _CIRCULAR, _numbered("label"))
_FOLD_VALUES = tree_checks.folds(ml.FOLD_VALUES, TREE_FEATURES, _CIRCULAR, _numbered("label"), "reg_")


def _round_numbers(df):
    return rounded(df, *[c for c, kind in df.dtypes if kind == "double"])


@query("decision_tree", tree_checks.report_check(_HELD[1]))
def _(spark, sf):
    return _round_numbers(ml.decision_tree(_tree_table(spark, sf), TREE_FEATURES, "vec_id")[1])


@query("random_forest", tree_checks.report_check(_HELD[ml.FOREST_TREES]))
def _(spark, sf):
    return _round_numbers(ml.random_forest(_tree_table(spark, sf), TREE_FEATURES, "vec_id")[1])


@query("feature_importance", tree_checks.importance_check(_HELD[ml.FOREST_TREES], TREE_FEATURES))
def _(spark, sf):
    df = _tree_table(spark, sf)
    model, _report = ml.random_forest(df, TREE_FEATURES, "vec_id")
    return _round_numbers(ml.feature_importance(df, model, TREE_FEATURES))


@query("cv_tree", tree_checks.cv_check(_FOLDS, _FOLD_VALUES))
def _(spark, sf):
    return _round_numbers(ml.cv_tree(_tree_table(spark, sf), TREE_FEATURES, "vec_id"))


@query("tree_rules", tree_checks.rules_check(_FOLDS, TREE_FEATURES))
def _(spark, sf):
    return _round_numbers(ml.tree_rules(_tree_table(spark, sf), TREE_FEATURES, "vec_id"))


@query("fold_feature_frequency", tree_checks.frequency_check(_FOLDS, TREE_FEATURES))
def _(spark, sf):
    return ml.fold_feature_frequency(_tree_table(spark, sf), TREE_FEATURES, "vec_id").withColumn(
        "folds", F.array_join(F.transform("folds", lambda f: f.cast("string")), ",")
    )
