"""Queries over manifests, names, labels and plain joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellmetry.functions import contour as ring
from cellmetry.functions import names
from cellmetry.operators import geometry, relational as rel
from cellmetry.plans.registry import check, query, r6, rounded, sq
from cellmetry.session import shared_folder
from cellmetry.sources import derived, manifests, tables

# ---------------------------------------------------------------- files


@query("file_manifest", check(["file_a"], "SELECT class_name, file_name FROM file_a WHERE file_name LIKE '%.tif'"))
def _(spark, sf):
    files, _other = derived.files(spark, sf)
    return manifests.file_manifest(files, ".tif").select("class_name", "file_name")


@query(
    "class_manifest",
    check(
        ["file_a", "file_b"],
        """SELECT b.class_name, b.file_name, c.label FROM file_b b JOIN (
        SELECT class_name, row_number() OVER (ORDER BY class_name) - 1 AS label
        FROM (SELECT DISTINCT class_name FROM file_a)) c USING (class_name)
        WHERE lower(b.file_name) LIKE '%.tif'""",
    ),
)
def _(spark, sf):
    every, files = derived.files(spark, sf)
    return manifests.class_manifest(files, ".tif", classes=every).select(
        "class_name", "file_name", "label"
    )


@query(
    "paired_manifest",
    check(
        ["file_a", "file_b"],
        """SELECT a.class_name, a.file_name AS file_a, b.file_name AS file_b, c.label
        FROM file_a a JOIN file_b b ON a.class_name = b.class_name
        AND lower(a.file_name) = lower(b.file_name) JOIN (
        SELECT class_name, row_number() OVER (ORDER BY class_name) - 1 AS label FROM (
        SELECT class_name FROM file_a INTERSECT SELECT class_name FROM file_b)) c
        ON c.class_name = a.class_name""",
    ),
)
def _(spark, sf):
    return manifests.paired_manifest(*derived.files(spark, sf)).select(
        "class_name", "file_a", "file_b", "label"
    )


_MISMATCH = """SELECT 'only_in_a' AS kind, class_name, CAST(NULL AS VARCHAR) AS file_name FROM (
    SELECT class_name FROM file_a EXCEPT SELECT class_name FROM file_b)
    UNION ALL SELECT 'only_in_b', class_name, NULL FROM (
    SELECT class_name FROM file_b EXCEPT SELECT class_name FROM file_a)
    UNION ALL SELECT 'missing_in_b', class_name, file_name FROM (
    SELECT class_name, lower(file_name) AS file_name FROM file_a
    WHERE class_name IN (SELECT class_name FROM file_b)
    EXCEPT SELECT class_name, lower(file_name) FROM file_b)
    UNION ALL SELECT 'missing_in_a', class_name, file_name FROM (
    SELECT class_name, lower(file_name) AS file_name FROM file_b
    WHERE class_name IN (SELECT class_name FROM file_a)
    EXCEPT SELECT class_name, lower(file_name) FROM file_a)"""


@query("pair_consistency", check(["file_a", "file_b"], _MISMATCH))
def _(spark, sf):
    return manifests.pair_consistency(*derived.files(spark, sf))


@query(
    "missing_sample",
    check(
        ["file_a", "file_b"],
        """SELECT kind, class_name, string_agg(file_name, ',' ORDER BY file_name) AS names FROM (
        SELECT *, row_number() OVER (PARTITION BY kind, class_name ORDER BY file_name) AS r,
        dense_rank() OVER (PARTITION BY kind ORDER BY class_name) AS c
        FROM mismatch WHERE file_name IS NOT NULL) WHERE r <= 5 AND c <= 3
        GROUP BY kind, class_name""",
        ("mismatch", _MISMATCH),
    ),
)
def _(spark, sf):
    found = manifests.pair_consistency(*derived.files(spark, sf))
    return manifests.missing_sample(found).withColumn("names", F.array_join("names", ","))


@query(
    "positional_pairing",
    check(
        ["file_a", "file_b"],
        """SELECT position, mask, gray, phase FROM (SELECT file_name AS mask,
        row_number() OVER (ORDER BY file_name) AS position FROM file_a) JOIN (
        SELECT file_name AS gray, row_number() OVER (ORDER BY file_name) AS position FROM file_b)
        USING (position) JOIN (SELECT concat('phase_', doc_id, '.tif') AS phase,
        row_number() OVER (ORDER BY concat('phase_', doc_id, '.tif')) AS position FROM file_a)
        USING (position)""",
    ),
)
def _(spark, sf):
    a, b = derived.files(spark, sf)
    phase = a.select(F.concat(F.lit("phase_"), "doc_id", F.lit(".tif")).alias("file_name"))
    return manifests.positional_pairing(a, b, phase)


@query(
    "mask_pair_check",
    check(
        ["img"],
        """SELECT image_id, CASE WHEN image_id % 7 = 3 THEN 'missing prediction'
        ELSE 'shape mismatch' END AS problem FROM img WHERE image_id % 7 = 3 OR image_id % 5 = 2""",
    ),
)
def _(spark, sf):
    truth = derived.pixels(spark, sf)
    faulty = derived.predicted_mask(spark, sf).filter(
        "image_id % 7 <> 3 and (image_id % 5 <> 2 or x < 60)"
    )
    return manifests.mask_pair_check(truth, faulty).select("image_id", "problem")


@query(
    "class_intersection",
    check(["file_a", "file_b"], "SELECT class_name FROM file_a INTERSECT SELECT class_name FROM file_b"),
)
def _(spark, sf):
    return manifests.class_intersection(*derived.files(spark, sf))


@query(
    "class_difference",
    check(["file_a", "file_b"], "SELECT class_name FROM file_a EXCEPT SELECT class_name FROM file_b"),
)
def _(spark, sf):
    return manifests.class_difference(*derived.files(spark, sf))


_REJECTED = "SELECT image_name, object_id AS cyto_id FROM emb WHERE vec_id % 10 = 3"


@query("blacklist_explode", check(["emb"], _REJECTED))
def _(spark, sf):
    return rel.blacklist_explode(derived.blacklist(spark, sf))


# ---------------------------------------------------------------- sinks


@query(
    "class_partition_sink",
    check(
        ["emb"],
        """SELECT label_name, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids FROM (
        SELECT vec_id, CASE label WHEN 0 THEN 'normal' WHEN 1 THEN 'quiescent'
        WHEN 2 THEN 'fully_senescent' ELSE 'senescent_like' END AS label_name FROM emb)
        GROUP BY label_name""",
    ),
)
def _(spark, sf):
    path = shared_folder(spark, "crops")
    crops = derived.embeddings(spark, sf).select(
        "vec_id",
        names.crop_name(F.col("image_name"), F.col("object_id")).alias("crop_name"),
        names.decode_label(F.col("label"), names.LABEL_FOLDERS).alias("label_name"),
    )
    tables.class_partition_sink(crops, path)
    return (
        spark.read.parquet(path)
        .groupBy(F.col("label_name").cast("string").alias("label_name"))
        .agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"))
    )


@query(
    "read_labels",
    check(
        ["vote"],
        "SELECT image_name AS cyto_image, cyto_id AS cyto_index, cons_xgal, cons_morph_status FROM vote",
    ),
)
def _(spark, sf):
    path = shared_folder(spark, "labels")
    labels = derived.votes(spark, sf).selectExpr(
        "image_name as cyto_image", "cyto_id as cyto_index", "cons_xgal", "cons_morph_status"
    )
    labels.write.csv(path, header=True)
    return tables.read_labels(spark, path)


@query(
    "write_objects",
    check(["emb"], "SELECT image_name, object_id, label FROM emb"),
)
def _(spark, sf):
    path = shared_folder(spark, "objects")
    tables.write_objects(
        derived.embeddings(spark, sf).select("image_name", "object_id", "label"), path
    )
    return tables.read_objects(spark, path)


@query(
    "write_metrics",
    check(["feat"], "SELECT label, count(*) AS n FROM feat GROUP BY label"),
)
def _(spark, sf):
    path = shared_folder(spark, "metrics")
    tables.write_metrics(
        derived.features(spark, sf).groupBy("label").agg(F.count("*").alias("n")), path
    )
    return spark.read.schema("label bigint, n bigint").csv(path, header=True)


# ---------------------------------------------------------------- names, rules


@query(
    "normalize_image_name",
    check(
        ["emb"],
        """SELECT vec_id, raw_name, replace(replace(replace(raw_name, 'green', ''), 'red', ''), 'phase', '')
        AS image_name FROM (SELECT vec_id, concat('img', image_id,
        CASE slot % 3 WHEN 0 THEN 'green' WHEN 1 THEN 'red' ELSE 'phase' END, '.tif') AS raw_name FROM emb)""",
    ),
)
def _(spark, sf):
    word = F.expr("case slot % 3 when 0 then 'green' when 1 then 'red' else 'phase' end")
    raw = derived.embeddings(spark, sf).select(
        "vec_id", F.concat(F.lit("img"), "image_id", word, F.lit(".tif")).alias("raw_name")
    )
    return raw.withColumn("image_name", names.normalize_image_name(F.col("raw_name")))


@query(
    "derive_channel_name",
    check(
        ["emb"],
        """SELECT vec_id, concat('img', image_id, 'green.tif') AS green_name,
        concat('img', image_id, 'joined.tif') AS joined_name FROM emb""",
    ),
)
def _(spark, sf):
    red = F.concat(F.lit("img"), "image_id", F.lit("red.tif"))
    return derived.embeddings(spark, sf).select(
        "vec_id",
        names.derive_channel_name(red, "green").alias("green_name"),
        names.derive_channel_name(red, "joined").alias("joined_name"),
    )


@query(
    "prefix_columns",
    check(
        ["emb"],
        "SELECT image_name AS cyto_image_name, object_id AS cyto_object_id, label AS cyto_label FROM emb",
    ),
)
def _(spark, sf):
    objects = derived.embeddings(spark, sf).select("image_name", "object_id", "label")
    return rel.prefix_columns(objects, "cyto_")


@query(
    "rename_columns",
    check(
        ["emb"],
        "SELECT image_name AS cyto_image_name, object_id AS cyto_index, label FROM emb",
    ),
)
def _(spark, sf):
    drifted = derived.embeddings(spark, sf).selectExpr(
        "image_name as cyto_image", "object_id as cyto_id", "label"
    )
    return rel.rename_columns(drifted)


@query(
    "select_features",
    check(["feat"], "SELECT vec_id, " + ", ".join(f"{sq(c)} AS {c}" for c in names.CYTO_FEATURES) + " FROM feat"),
)
def _(spark, sf):
    picked = rel.select_features(derived.features(spark, sf), names.CYTO_FEATURES, "vec_id")
    return rounded(picked, *names.CYTO_FEATURES)


@query(
    "circularity",
    check(
        ["feat"],
        f"""SELECT vec_id, {sq('1.0 / (1 + abs(cyto_roundness))')} AS cyto_circularity,
        {sq('1.0 / (1 + abs(nuc_roundness))')} AS nuc_circularity FROM feat""",
    ),
)
def _(spark, sf):
    positive = derived.features(spark, sf).withColumns(
        {c: 1 + F.abs(F.col(c)) for c in ("cyto_roundness", "nuc_roundness")}
    )
    return rounded(
        rel.add_circularity(positive).select("vec_id", *names.CIRCULARITY_FEATURES),
        *names.CIRCULARITY_FEATURES,
    )


_PHENOTYPE = "CASE WHEN {a} + {b} = 1 AND {b} = 1 THEN 3 ELSE {a} + {b} END"


@query(
    "phenotype_label",
    check(
        ["vote"],
        f"""SELECT vec_id, CAST({_PHENOTYPE.format(a='xgal_1', b='s_status_2')} AS BIGINT) AS label FROM vote""",
    ),
)
def _(spark, sf):
    return derived.votes(spark, sf).select(
        "vec_id", names.phenotype_label(F.col("xgal_1"), F.col("s_status_2")).alias("label")
    )


@query(
    "majority_vote",
    check(
        ["majority"],
        """SELECT vec_id, CAST(maj_xgal AS BIGINT) AS cons_xgal,
        CAST(maj_sstatus AS BIGINT) AS cons_sstatus FROM majority""",
    ),
)
def _(spark, sf):
    return derived.votes(spark, sf).select(
        "vec_id",
        names.majority_vote(*[F.col(f"xgal_{k}") for k in (1, 2, 3)]).alias("cons_xgal"),
        names.majority_vote(*[F.col(f"s_status_{k}") for k in (1, 2, 3)]).alias("cons_sstatus"),
    )


@query(
    "decode_label",
    check(
        ["emb"],
        """SELECT vec_id, CASE label WHEN 0 THEN 'Normal' WHEN 1 THEN 'Quiescent'
        WHEN 2 THEN 'Fully Senescent' ELSE 'Senescent-like' END AS title,
        CASE label WHEN 0 THEN 'normal' WHEN 1 THEN 'quiescent'
        WHEN 2 THEN 'fully_senescent' ELSE 'senescent_like' END AS folder FROM emb""",
    ),
)
def _(spark, sf):
    return derived.embeddings(spark, sf).select(
        "vec_id",
        names.decode_label(F.col("label")).alias("title"),
        names.decode_label(F.col("label"), names.LABEL_FOLDERS).alias("folder"),
    )


@query("treatment_filter", check(["feat"], "SELECT vec_id, tx, label FROM feat WHERE tx = 'tmz'"))
def _(spark, sf):
    return rel.treatment_filter(derived.features(spark, sf), "tmz").select("vec_id", "tx", "label")


@query(
    "min_area_filter",
    check(["cyto_p"], "SELECT vec_id, area FROM cyto_p WHERE area > 7500"),
)
def _(spark, sf):
    measured = geometry.polygon_features(derived.cytoplasms(spark, sf)).select("vec_id", "area")
    return rel.min_area_filter(measured, "area", 7500.0)


@query(
    "drop_columns",
    check(["feat"], "SELECT vec_id, " + ", ".join(f"{sq(c)} AS {c}" for c in names.BASE_FEATURES) + " FROM feat"),
)
def _(spark, sf):
    kept = derived.features(spark, sf).drop("label", "predicted", "tx", "image_name", "object_id")
    return rounded(kept, *names.BASE_FEATURES)


@query(
    "crop_name_build",
    check(["emb"], "SELECT vec_id, concat('img_img', image_id, '_crop_', object_id, '.tif') AS crop_name FROM emb"),
)
def _(spark, sf):
    return derived.embeddings(spark, sf).select(
        "vec_id", names.crop_name(F.col("image_name"), F.col("object_id")).alias("crop_name")
    )


@query(
    "crop_name_parse",
    check(
        ["file_a"],
        """SELECT file_name, concat('A', doc_id // 10, '.tif') AS image_name, doc_id AS object_id,
        concat('A', doc_id // 10, '.tif') AS robust_image, doc_id AS robust_id FROM file_a""",
    ),
)
def _(spark, sf):
    files, _other = derived.files(spark, sf)
    by_part = names.parse_crop_name(F.col("file_name"))
    by_pattern = names.parse_crop_name_robust(F.col("file_name"))
    return files.select(
        "file_name",
        by_part["image_name"].alias("image_name"),
        by_part["object_id"].alias("object_id"),
        by_pattern["image_name"].alias("robust_image"),
        by_pattern["object_id"].alias("robust_id"),
    )


@query(
    "feature_vector",
    check(
        ["feat"],
        "SELECT vec_id, 14 AS n, "
        + sq("cyto_area")
        + " AS first_value, "
        + sq("nuc_ii")
        + " AS last_value, "
        + sq(" + ".join(names.BASE_FEATURES))
        + " AS total FROM feat",
    ),
)
def _(spark, sf):
    packed = rel.feature_vector(derived.features(spark, sf), names.BASE_FEATURES)
    return packed.select(
        "vec_id",
        F.size("features").alias("n"),
        r6(F.col("features")[0]).alias("first_value"),
        r6(F.element_at("features", -1)).alias("last_value"),
        r6(F.aggregate("features", F.lit(0.0), lambda a, v: a + v)).alias("total"),
    )


@query(
    "argmax_class",
    check(
        ["emb"],
        """SELECT vec_id, CAST(list_position(s, list_max(s)) - 1 AS BIGINT) AS predicted FROM (
        SELECT vec_id, [floor(20 * CAST(embedding[1] AS DOUBLE)), floor(20 * CAST(embedding[2] AS DOUBLE)),
        floor(20 * CAST(embedding[3] AS DOUBLE)), floor(20 * CAST(embedding[4] AS DOUBLE))] AS s FROM emb)""",
    ),
)
def _(spark, sf):
    scores = F.array(*[F.floor(20 * F.col("embedding")[k].cast("double")) for k in range(4)])
    return derived.embeddings(spark, sf).select(
        "vec_id", names.argmax_class(scores).cast("bigint").alias("predicted")
    )


@query(
    "vector_to_array",
    check(
        ["emb"],
        f"""SELECT vec_id, i AS position, {sq('CAST(embedding[i + 1] AS DOUBLE)')} AS value
        FROM emb, (SELECT unnest(range(64)) AS i)""",
    ),
)
def _(spark, sf):
    rows = rel.vector_to_rows(derived.embeddings(spark, sf), "embedding", "vec_id")
    return rows.withColumn("value", r6(F.col("value").cast("double")))


@query(
    "parse_contour_text",
    check(
        ["cyto_v"],
        """SELECT vec_id, CASE WHEN vec_id % 50 = 7 THEN NULL ELSE count(*) END AS n_points,
        CASE WHEN vec_id % 50 = 7 THEN NULL ELSE CAST(sum(x * (i + 1)) AS BIGINT) END AS weighted_x,
        CASE WHEN vec_id % 50 = 7 THEN NULL ELSE CAST(sum(y * (i + 1)) AS BIGINT) END AS weighted_y
        FROM cyto_v GROUP BY vec_id""",
    ),
)
def _(spark, sf):
    text = derived.cytoplasms(spark, sf).selectExpr(
        "vec_id",
        "concat('[', array_join(transform(contour, p -> concat('[[', p.x, '  ', p.y, ']]')), '\n '),"
        " case when vec_id % 50 = 7 then '' else ']' end) as text",
    )
    parsed = text.select("vec_id", ring.parse_contour_text(F.col("text")).alias("c"))
    return parsed.selectExpr(
        "vec_id",
        "cast(case when c is not null then size(c) end as bigint) as n_points",
        "aggregate(transform(c, (p, i) -> p.x * (i + 1)), 0L, (a, v) -> a + v) as weighted_x",
        "aggregate(transform(c, (p, i) -> p.y * (i + 1)), 0L, (a, v) -> a + v) as weighted_y",
    )


# ---------------------------------------------------------------- joins


def _linked_objects(spark, sf):
    return derived.embeddings(spark, sf).selectExpr(
        "vec_id", "image_name", "object_id as cyto_id", "label as model_label"
    )


@query(
    "label_join",
    check(
        ["emb", "vote"],
        f"""SELECT e.vec_id, e.image_name AS cyto_image_name, e.object_id AS cyto_index, v.cons_xgal,
        v.cons_morph_status,
        CAST({_PHENOTYPE.format(a='v.cons_xgal', b='v.cons_morph_status')} AS BIGINT) AS label
        FROM emb e JOIN vote v ON e.image_name = v.image_name AND e.object_id = v.cyto_id""",
    ),
)
def _(spark, sf):
    objects = derived.embeddings(spark, sf).selectExpr(
        "vec_id", "image_name as cyto_image_name", "object_id as cyto_index"
    )
    labels = derived.votes(spark, sf).selectExpr(
        "image_name as cyto_image", "cyto_id", "cons_xgal", "cons_morph_status"
    )
    joined = rel.label_join(
        objects, labels, {"cyto_image_name": "cyto_image", "cyto_index": "cyto_id"}
    )
    return rel.consensus_labels(joined)


@query(
    "annotator_join",
    check(
        ["majority"],
        f"""SELECT vec_id, image_name, cyto_id, CAST(maj_xgal AS BIGINT) AS cons_xgal,
        CAST(maj_sstatus AS BIGINT) AS cons_sstatus,
        CAST({_PHENOTYPE.format(a='maj_xgal', b='maj_sstatus')} AS BIGINT) AS label FROM majority""",
    ),
)
def _(spark, sf):
    objects = derived.embeddings(spark, sf).select(
        "vec_id",
        F.concat(F.lit("img"), "image_id", F.lit("green.tif")).alias("image_name"),
        F.col("object_id").alias("contour_index"),
    )
    joined = rel.annotator_join(objects, derived.votes(spark, sf).drop("vec_id"))
    return joined.select("vec_id", "image_name", "cyto_id", "cons_xgal", "cons_sstatus", "label")


@query(
    "blacklist_anti_join",
    check(["emb"], "SELECT vec_id, image_name, object_id AS cyto_id, label AS model_label FROM emb WHERE vec_id % 10 <> 3"),
)
def _(spark, sf):
    rejected = rel.blacklist_explode(derived.blacklist(spark, sf))
    return rel.blacklist_anti_join(_linked_objects(spark, sf), rejected, "image_name", "cyto_id").select(
        "vec_id", "image_name", "cyto_id", "model_label"
    )


def _copies(spark, sf):
    """Objects with copies of some cytoplasms (several nuclei in one cell)."""
    once = derived.embeddings(spark, sf).selectExpr(
        "vec_id as obj_id", "image_name", "object_id as cyto_id", "label"
    )
    again = once.filter("obj_id % 3 = 0").selectExpr(
        "obj_id + 1000000 as obj_id", "image_name", "cyto_id", "(label + 1) % 4 as label"
    )
    return once.unionByName(again)


@query(
    "dedup_keep_first",
    check(["emb"], "SELECT vec_id AS obj_id, image_name, object_id AS cyto_id, label FROM emb"),
)
def _(spark, sf):
    return rel.dedup_keep_first(_copies(spark, sf), ["image_name", "cyto_id"])


@query(
    "unique_objects",
    check(
        ["emb"],
        """SELECT vec_id AS obj_id, image_name, object_id AS cyto_id, label,
        concat('img_img', image_id, '_crop_', object_id, '.tif') AS crop_name FROM emb""",
    ),
)
def _(spark, sf):
    return rel.unique_objects(_copies(spark, sf))


@query(
    "crop_label_lookup",
    check(
        ["emb"],
        """SELECT concat('img_img', image_id, '_crop_', object_id, '.tif') AS crop_name, image_name,
        object_id AS cyto_id, label, CASE label WHEN 0 THEN 'normal' WHEN 1 THEN 'quiescent'
        WHEN 2 THEN 'fully_senescent' ELSE 'senescent_like' END AS label_name
        FROM emb WHERE vec_id % 4 <> 1""",
    ),
)
def _(spark, sf):
    crops = derived.embeddings(spark, sf).select(
        names.crop_name(F.col("image_name"), F.col("object_id")).alias("crop_name")
    )
    known = _copies(spark, sf).filter("(obj_id % 1000000) % 4 <> 1")
    return rel.crop_label_lookup(crops, known).select(
        "crop_name", "image_name", "cyto_id", "label", "label_name"
    )


@query(
    "crops_without_label",
    check(
        ["emb"],
        "SELECT concat('img_img', image_id, '_crop_', object_id, '.tif') AS crop_name FROM emb WHERE vec_id % 4 = 1",
    ),
)
def _(spark, sf):
    crops = derived.embeddings(spark, sf).select(
        names.crop_name(F.col("image_name"), F.col("object_id")).alias("crop_name")
    )
    known = _copies(spark, sf).filter("(obj_id % 1000000) % 4 <> 1")
    return rel.crops_without_label(crops, known)


_UNION = """SELECT image_name, object_id AS cyto_id, label, CASE WHEN vec_id % 2 = 0
    THEN vec_id * 2 END AS dose, CASE WHEN vec_id % 2 = 0 THEN 'tmz' ELSE 'ctr' END AS tx FROM emb"""


def _union(spark, sf):
    objects = derived.embeddings(spark, sf).selectExpr(
        "vec_id", "image_name", "object_id as cyto_id", "label", "vec_id * 2 as dose"
    )
    return rel.treatment_union(
        objects.filter("vec_id % 2 = 0").drop("vec_id"),
        objects.filter("vec_id % 2 = 1").drop("vec_id", "dose"),
    )


@query("treatment_union", check(["emb"], _UNION))
def _(spark, sf):
    return _union(spark, sf)


@query(
    "object_id",
    check(
        ["emb"],
        f"""SELECT *, row_number() OVER (ORDER BY CASE WHEN tx = 'tmz' THEN 0 ELSE 1 END,
        image_name, cyto_id) - 1 AS obj_id FROM ({_UNION})""",
    ),
)
def _(spark, sf):
    return rel.object_id(_union(spark, sf), "image_name", "cyto_id")
