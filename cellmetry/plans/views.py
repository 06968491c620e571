"""Check views: the derived cell tables in SQL, independent of the Spark code."""

from __future__ import annotations

from cellmetry.functions.names import BASE_FEATURES
from cellmetry.plans.registry import view

view(
    "emb",
    [],
    """SELECT vec_id, vec_id // 8 AS image_id, concat('img', vec_id // 8, '.tif') AS image_name,
    vec_id % 8 AS slot, vec_id % 8 + 1 AS object_id, CAST(label % 4 AS BIGINT) AS label,
    CAST(label AS BIGINT) AS raw_label, 70 * ((vec_id % 8) % 4) + 60 AS ring_x,
    70 * ((vec_id % 8) // 4) + 60 AS ring_y, embedding FROM embeddings""",
)
view("pts", [], "SELECT unnest(range(64)) AS i")


def _ring(cx: str, cy: str, base: int, factor: int) -> str:
    r = f"({base} + floor({factor} * abs(CAST(embedding[i + 1] AS DOUBLE))))"
    return (
        f"CAST({cx} + floor({r} * cos(2 * pi() * i / 64) + 0.5) AS BIGINT) AS x, "
        f"CAST({cy} + floor({r} * sin(2 * pi() * i / 64) + 0.5) AS BIGINT) AS y"
    )


view(
    "cyto_v",
    ["emb", "pts"],
    "SELECT vec_id, image_id, image_name, object_id, label, i, "
    + _ring("ring_x", "ring_y", 30, 200)
    + " FROM emb, pts",
)
view(
    "nuc",
    ["emb"],
    """SELECT vec_id AS nucleus_id, image_id, image_name, embedding,
    CAST(ring_x + floor(250 * CAST(embedding[1] AS DOUBLE)) AS BIGINT) AS px,
    CAST(ring_y + floor(250 * CAST(embedding[2] AS DOUBLE)) AS BIGINT) AS py FROM emb""",
)
view(
    "nuc_v",
    ["nuc", "pts"],
    "SELECT nucleus_id AS vec_id, i, " + _ring("px", "py", 8, 50) + " FROM nuc, pts",
)
_RADIUS = "(40 + floor(100 * abs(CAST(embedding[k + 1] AS DOUBLE))))"
_ARC = "(1.6 * pi() * k / 31)"
view(
    "crescent_v",
    ["emb", "pts"],
    f"""SELECT vec_id, i, CAST(200 + floor(({_RADIUS} - inset) * cos{_ARC} + 0.5) AS BIGINT) AS x,
    CAST(200 + floor(({_RADIUS} - inset) * sin{_ARC} + 0.5) AS BIGINT) AS y
    FROM (SELECT vec_id, embedding, i, CASE WHEN i < 32 THEN i ELSE 63 - i END AS k,
    CASE WHEN i < 32 THEN 0 ELSE 20 END AS inset FROM emb, pts)""",
)


def _edges(source: str) -> str:
    return f"""SELECT vec_id, i, x AS x1, y AS y1,
    coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2,
    coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2
    FROM {source} WINDOW w AS (PARTITION BY vec_id ORDER BY i
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""


def _poly(edges: str) -> str:
    return f"""SELECT vec_id, abs(a2) / 2.0 AS area, perimeter, sx // (3 * a2) AS cx, sy // (3 * a2) AS cy
    FROM (SELECT vec_id, CAST(sum(x1 * y2 - x2 * y1) AS BIGINT) AS a2,
    CAST(sum((x1 + x2) * (x1 * y2 - x2 * y1)) AS BIGINT) AS sx,
    CAST(sum((y1 + y2) * (x1 * y2 - x2 * y1)) AS BIGINT) AS sy,
    sum(sqrt(CAST((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS DOUBLE))) AS perimeter
    FROM {edges} GROUP BY vec_id)"""


for _name, _source in (("cyto", "cyto_v"), ("nucl", "nuc_v"), ("crescent", "crescent_v")):
    view(f"{_name}_e", [_source], _edges(_source))
    view(f"{_name}_p", [f"{_name}_e"], _poly(f"{_name}_e"))

view("img", [], "SELECT DISTINCT vec_id // 8 AS image_id FROM embeddings")
view(
    "lines",
    [],
    """SELECT image_id, y, vectors[y % len(vectors) + 1] AS line FROM (
    SELECT vec_id // 8 AS image_id, list(embedding ORDER BY vec_id) AS vectors
    FROM embeddings GROUP BY vec_id // 8), (SELECT unnest(range(64)) AS y)""",
)
view(
    "pix",
    ["lines"],
    """SELECT image_id, y, x, grayscale, (grayscale * 5 + y) % 256 AS red,
    (grayscale * 7 + x) % 256 AS green, (grayscale * 11 + x + y) % 256 AS blue,
    CASE WHEN (x % 16 - 8) * (x % 16 - 8) + (y % 16 - 8) * (y % 16 - 8) <= 20 + 4 * (image_id % 5)
    THEN 1 + x // 16 + 4 * (y // 16) ELSE 0 END AS obj
    FROM (SELECT image_id, y, x, (3 * x * x + 7 * y + 13 * image_id + x * y
    + CAST(floor(500 * abs(CAST(line[x + 1] AS DOUBLE))) AS BIGINT)) % 256 AS grayscale
    FROM lines, (SELECT unnest(range(64)) AS x))""",
)
_DISK_RADIUS = "sqrt(CAST(20 + 4 * (image_id % 5) AS DOUBLE))"
view(
    "disk_v",
    ["img"],
    f"""SELECT image_id * 16 + k AS vec_id, i,
    CAST(8 + 16 * (k % 4) + floor({_DISK_RADIUS} * cos(2 * pi() * i / 24) + 0.5) AS BIGINT) AS x,
    CAST(8 + 16 * (k // 4) + floor({_DISK_RADIUS} * sin(2 * pi() * i / 24) + 0.5) AS BIGINT) AS y
    FROM img, (SELECT unnest(range(16)) AS k), (SELECT unnest(range(24)) AS i)""",
)
view("disk_e", ["disk_v"], _edges("disk_v"))
view(
    "predmask",
    ["img"],
    """SELECT image_id, y, x, CASE WHEN u >= 0
    AND (u % 16 - 8) * (u % 16 - 8) + (y % 16 - 8) * (y % 16 - 8) <= 20 + 4 * (image_id % 5)
    AND (u // 16 + 4 * (y // 16)) % 7 <> 6 THEN 101 + u // 16 + 4 * (y // 16) ELSE 0 END AS pred
    FROM (SELECT image_id, y, x, x - image_id % 3 AS u
    FROM img, (SELECT unnest(range(64)) AS y), (SELECT unnest(range(64)) AS x))""",
)
view(
    "vote",
    ["emb"],
    """SELECT vec_id, image_name, object_id AS cyto_id, (vec_id * 1 + raw_label) % 2 AS xgal_1,
    (vec_id * 2 + raw_label) % 2 AS xgal_2, (vec_id * 3 + raw_label) % 2 AS xgal_3,
    (vec_id // 1 + raw_label) % 2 AS s_status_1,
    CASE WHEN vec_id % 97 = 0 THEN NULL ELSE (vec_id // 2 + raw_label) % 2 END AS s_status_2,
    (vec_id // 3 + raw_label) % 2 AS s_status_3, raw_label % 2 AS cons_xgal,
    (raw_label // 2) % 2 AS cons_morph_status FROM emb WHERE vec_id % 9 <> 4""",
)
view(
    "majority",
    ["vote"],
    """SELECT *, CASE WHEN xs > 1 THEN 1 WHEN xs < 2 THEN 0 END AS maj_xgal,
    CASE WHEN ss > 1 THEN 1 WHEN ss < 2 THEN 0 END AS maj_sstatus
    FROM (SELECT *, xgal_1 + xgal_2 + xgal_3 AS xs,
    s_status_1 + s_status_2 + s_status_3 AS ss FROM vote)""",
)
view(
    "feat",
    ["emb"],
    "SELECT vec_id, image_name, object_id, "
    + ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS {c}" for k, c in enumerate(BASE_FEATURES))
    + """, label, CASE WHEN vec_id % 5 = 0 THEN (raw_label + 1) % 4 ELSE label END AS predicted,
    CASE WHEN vec_id % 2 = 0 THEN 'tmz' ELSE 'ctr' END AS tx FROM emb""",
)
view(
    "featrow",
    ["feat"],
    " UNION ALL ".join(
        f"SELECT vec_id, label, tx, '{c}' AS feature, {c} AS value FROM feat" for c in BASE_FEATURES
    ),
)
view(
    "file_a",
    [],
    """SELECT doc_id, lang AS class_name,
    concat('img_A', doc_id // 10, '_crop_', doc_id, '.tif') AS file_name FROM documents""",
)
view(
    "file_b",
    ["file_a"],
    """SELECT doc_id, class_name,
    CASE WHEN doc_id % 3 = 0 THEN upper(file_name) ELSE file_name END AS file_name
    FROM file_a WHERE doc_id % 11 <> 0 AND class_name <> 'es'""",
)
view(
    "pairdist",
    ["cyto_v"],
    """SELECT image_id, id_a, id_b, label_a, label_b, min(code) // 4096 AS d2,
    min(code) % 4096 // 64 AS ia, min(code) % 64 AS ib FROM (
    SELECT a.image_id, a.object_id AS id_a, b.object_id AS id_b, least(a.label, b.label) AS label_a,
    greatest(a.label, b.label) AS label_b,
    ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) * 4096 + a.i * 64 + b.i AS code
    FROM cyto_v a JOIN cyto_v b ON a.image_id = b.image_id AND a.object_id < b.object_id)
    GROUP BY image_id, id_a, id_b, label_a, label_b""",
)
view(
    "overlap",
    ["pix", "predmask"],
    """SELECT image_id, obj, pred, count(*) AS inter FROM pix JOIN predmask USING (image_id, y, x)
    GROUP BY image_id, obj, pred""",
)
view(
    "scored",
    ["overlap"],
    """SELECT image_id, obj, pred, inter, area_gt, area_pred, area_gt + area_pred - inter AS uni
    FROM (SELECT *, CAST(sum(inter) OVER (PARTITION BY image_id, obj) AS BIGINT) AS area_gt,
    CAST(sum(inter) OVER (PARTITION BY image_id, pred) AS BIGINT) AS area_pred FROM overlap)
    WHERE obj <> 0 AND pred <> 0""",
)
view(
    "matched",
    ["scored"],
    "SELECT *, CAST(inter AS DOUBLE) / uni AS iou FROM scored WHERE inter * 5 >= 4 * uni",
)
view(
    "segm",
    ["overlap", "matched"],
    """SELECT c.image_id, coalesce(iou, 0.0) AS iou, coalesce(dice, 0.0) AS dice,
    CASE WHEN n_pred > 0 THEN coalesce(m, 0) / CAST(n_pred AS DOUBLE) ELSE 1.0 END AS prec,
    CASE WHEN n_gt > 0 THEN coalesce(m, 0) / CAST(n_gt AS DOUBLE) ELSE 1.0 END AS rec, mae
    FROM (SELECT image_id, count(DISTINCT CASE WHEN obj <> 0 THEN obj END) AS n_gt,
    count(DISTINCT CASE WHEN pred <> 0 THEN pred END) AS n_pred FROM overlap GROUP BY image_id) c
    LEFT JOIN (SELECT image_id, count(*) AS m, avg(iou) AS iou,
    avg(2.0 * inter / CAST(area_gt + area_pred AS DOUBLE)) AS dice FROM matched GROUP BY image_id) h
    ON c.image_id = h.image_id
    JOIN (SELECT o.image_id, CAST(sum(o.inter * abs(o.obj - coalesce(m.obj, 0))) AS DOUBLE)
    / CAST(sum(o.inter) AS DOUBLE) AS mae FROM overlap o LEFT JOIN matched m
    ON o.image_id = m.image_id AND o.pred = m.pred GROUP BY o.image_id) e ON c.image_id = e.image_id""",
)
view(
    "confusion",
    ["feat"],
    """SELECT t.label, p.predicted, count(f.vec_id) AS n
    FROM (SELECT unnest(range(5)) AS label) t CROSS JOIN (SELECT unnest(range(5)) AS predicted) p
    LEFT JOIN feat f ON f.label = t.label AND f.predicted = p.predicted GROUP BY t.label, p.predicted""",
)
view(
    "classscore",
    ["confusion"],
    """SELECT label, tp, support, claimed, rec, prec,
    CASE WHEN rec + prec > 0 THEN 2 * rec * prec / (rec + prec) ELSE 0.0 END AS f1
    FROM (SELECT *, CASE WHEN support > 0 THEN tp / CAST(support AS DOUBLE) ELSE 0.0 END AS rec,
    CASE WHEN claimed > 0 THEN tp / CAST(claimed AS DOUBLE) ELSE 0.0 END AS prec
    FROM (SELECT c.label, sum(CASE WHEN c.label = c.predicted THEN n ELSE 0 END) AS tp,
    sum(n) AS support, any_value(k.claimed) AS claimed FROM confusion c
    JOIN (SELECT predicted, sum(n) AS claimed FROM confusion GROUP BY predicted) k
    ON k.predicted = c.label GROUP BY c.label))""",
)
