"""Queries over contours: shape features, containment, distances, filling."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellmetry.functions import contour as ring
from cellmetry.operators import geometry, spatial
from cellmetry.plans.registry import check, query, r6, rounded, sq
from cellmetry.sources import derived


def _measured(spark, sf, *columns):
    return rounded(
        geometry.polygon_features(derived.cytoplasms(spark, sf)).select("vec_id", *columns),
        *[c for c in columns if c not in ("cx", "cy")],
    )


@query("polygon_area", check(["cyto_p"], f"SELECT vec_id, {sq('area')} AS area FROM cyto_p"))
def _(spark, sf):
    return _measured(spark, sf, "area")


@query(
    "polygon_perimeter",
    check(["cyto_p"], f"SELECT vec_id, {sq('perimeter')} AS perimeter FROM cyto_p"),
)
def _(spark, sf):
    return _measured(spark, sf, "perimeter")


@query("polygon_centroid", check(["cyto_p"], "SELECT vec_id, cx, cy FROM cyto_p"))
def _(spark, sf):
    return _measured(spark, sf, "cx", "cy")


_ROUND = sq("perimeter * perimeter / (4.0 * pi() * area)")


@query("roundness", check(["cyto_p"], f"SELECT vec_id, {_ROUND} AS roundness FROM cyto_p"))
def _(spark, sf):
    return _measured(spark, sf, "roundness")


_RADII = """SELECT v.vec_id, sqrt(CAST(max(d) AS DOUBLE)) / sqrt(CAST(min(CASE WHEN d > 0 THEN d END) AS DOUBLE))
    AS radius_ratio FROM (SELECT v.vec_id, (x - cx) * (x - cx) + (y - cy) * (y - cy) AS d
    FROM cyto_v v JOIN cyto_p p ON v.vec_id = p.vec_id) v GROUP BY v.vec_id"""


@query(
    "radius_ratio",
    check(
        ["cyto_v", "cyto_p"],
        f"SELECT vec_id, {sq('radius_ratio')} AS radius_ratio FROM radii",
        ("radii", _RADII),
    ),
)
def _(spark, sf):
    return _measured(spark, sf, "radius_ratio")


@query(
    "ring_edges",
    check(["cyto_e"], "SELECT vec_id, i AS edge, x1, y1, x2, y2 FROM cyto_e"),
)
def _(spark, sf):
    edges = derived.cytoplasms(spark, sf).select(
        "vec_id", F.posexplode(ring.ring_edges(F.col("contour"))).alias("edge", "e")
    )
    return edges.select("vec_id", F.col("edge").cast("bigint").alias("edge"), "e.*")


@query(
    "bounding_box",
    check(
        ["cyto_v"],
        """SELECT vec_id, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h
        FROM cyto_v GROUP BY vec_id""",
    ),
)
def _(spark, sf):
    return geometry.bounding_boxes(derived.cytoplasms(spark, sf)).select("vec_id", "x", "y", "w", "h")


@query(
    "crop_window_size",
    check(
        ["cyto_v"],
        """SELECT max(least(w, h)) AS max_width, max(greatest(w, h)) AS max_height FROM (
        SELECT max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM cyto_v GROUP BY vec_id)""",
    ),
)
def _(spark, sf):
    from cellmetry.operators.pixels import crop_window_size

    return crop_window_size(geometry.bounding_boxes(derived.cytoplasms(spark, sf)))


def _side(edges: str, points: str, px: str = "px", py: str = "py") -> str:
    """+1, 0, -1 for the points joined to the edges in ``points`` (key columns k)."""
    turn = f"((x2 - x1) * ({py} - y1) - ({px} - x1) * (y2 - y1))"
    return f"""SELECT k, CASE WHEN max(CASE WHEN {turn} = 0 AND {px} BETWEEN least(x1, x2)
    AND greatest(x1, x2) AND {py} BETWEEN least(y1, y2) AND greatest(y1, y2) THEN 1 ELSE 0 END) = 1 THEN 0
    WHEN sum(CASE WHEN (y1 > {py}) <> (y2 > {py}) AND CASE WHEN y2 > y1 THEN {turn} > 0 ELSE {turn} < 0 END
    THEN 1 ELSE 0 END) % 2 = 1 THEN 1 ELSE -1 END AS side FROM {points} GROUP BY k"""


_PARENT_POINTS = """(SELECT n.nucleus_id * 1000000 + c.vec_id AS k, px, py, e.*
    FROM nuc n JOIN (SELECT DISTINCT vec_id, image_id FROM cyto_v) c ON n.image_id = c.image_id
    JOIN cyto_e e ON e.vec_id = c.vec_id)"""


@query(
    "point_in_polygon",
    check(
        ["nuc", "cyto_v", "cyto_e"],
        """SELECT k // 1000000 AS nucleus_id, k % 1000000 AS vec_id, CAST(side AS BIGINT) AS side
        FROM sides WHERE side >= 0""",
        ("sides", _side("cyto_e", _PARENT_POINTS)),
    ),
)
def _(spark, sf):
    """Every nucleus centre against the rings whose box holds it."""
    cyto = derived.cytoplasms(spark, sf).select(
        "image_id", "vec_id", ring.bounding_box(F.col("contour")).alias("_box"), "contour"
    )
    rings = spatial._over_cells(cyto, spatial.GRID)
    points = derived.nuclei(spark, sf).select(
        "image_id",
        "nucleus_id",
        "px",
        "py",
        spatial._cell(F.col("py"), spatial.GRID).alias("_cell_y"),
        spatial._cell(F.col("px"), spatial.GRID).alias("_cell_x"),
    )
    side = ring.point_side(ring.ring_edges(F.col("contour")), F.col("px"), F.col("py"))
    return (
        points.join(rings, ["image_id", "_cell_y", "_cell_x"])
        .select("nucleus_id", "vec_id", side.alias("side"))
        .filter("side >= 0")
    )


_PARENTS = """SELECT k // 1000000 AS nucleus_id, min(k % 1000000) AS parent FROM sides
    WHERE side >= 0 GROUP BY k // 1000000"""


@query(
    "nucleus_parent_join",
    check(
        ["nuc", "cyto_v", "cyto_e"],
        """SELECT p.parent // 8 AS image_id, p.nucleus_id, p.parent % 8 + 1 AS object_id
        FROM parents p""",
        ("sides", _side("cyto_e", _PARENT_POINTS)),
        ("parents", _PARENTS),
    ),
)
def _(spark, sf):
    return spatial.nucleus_parents(derived.nuclei(spark, sf), derived.cytoplasms(spark, sf))


@query(
    "link_objects",
    check(
        ["nuc", "cyto_v", "cyto_e", "emb", "cyto_p", "nucl_p"],
        f"""SELECT n.nucleus_id AS nuc_nucleus_id, e.image_name AS cyto_image_name,
        n.image_name AS nuc_image_name, e.object_id AS cyto_object_id, e.label AS cyto_label,
        {sq('c.area')} AS cyto_area, {sq('q.area')} AS nuc_area
        FROM parents p JOIN nuc n ON n.nucleus_id = p.nucleus_id JOIN emb e ON e.vec_id = p.parent
        JOIN cyto_p c ON c.vec_id = p.parent JOIN nucl_p q ON q.vec_id = p.nucleus_id""",
        ("sides", _side("cyto_e", _PARENT_POINTS)),
        ("parents", _PARENTS),
    ),
)
def _(spark, sf):
    linked = spatial.link_objects(
        geometry.polygon_features(derived.nuclei(spark, sf)),
        geometry.polygon_features(derived.cytoplasms(spark, sf)),
    )
    return rounded(
        linked.select(
            "nuc_nucleus_id",
            "cyto_image_name",
            "nuc_image_name",
            "cyto_object_id",
            "cyto_label",
            "cyto_area",
            "nuc_area",
        ),
        "cyto_area",
        "nuc_area",
    )


@query(
    "contour_min_distance",
    check(
        ["pairdist", "cyto_v"],
        f"""SELECT p.image_id, id_a, id_b, {sq('sqrt(CAST(d2 AS DOUBLE))')} AS distance,
        a.xs[ia + 1] AS ax, a.ys[ia + 1] AS ay, b.xs[ib + 1] AS bx, b.ys[ib + 1] AS by
        FROM pairdist p JOIN whole a ON a.image_id = p.image_id AND a.object_id = p.id_a
        JOIN whole b ON b.image_id = p.image_id AND b.object_id = p.id_b WHERE d2 <= 64""",
        (
            "whole",
            """SELECT image_id, object_id, list(x ORDER BY i) AS xs, list(y ORDER BY i) AS ys
            FROM cyto_v GROUP BY image_id, object_id""",
        ),
    ),
)
def _(spark, sf):
    return rounded(
        spatial.contour_min_distance(derived.cytoplasms(spark, sf), max_gap=8), "distance"
    )


_COUNTED = f"""SELECT label_a, label_b, {sq('sqrt(CAST(d2 AS DOUBLE))')} AS distance,
    CAST(count(*) {{times}} AS BIGINT) AS n_pairs FROM pairdist GROUP BY label_a, label_b, d2"""


@query("pairwise_unordered", check(["pairdist"], _COUNTED.format(times="")))
def _(spark, sf):
    return rounded(spatial.pair_distance_counts(derived.cytoplasms(spark, sf)), "distance")


@query(
    "pairwise_ordered",
    check(["pairdist"], _COUNTED.format(times="* CASE WHEN label_a = label_b THEN 2 ELSE 1 END")),
)
def _(spark, sf):
    from cellmetry.operators.relational import dedup_keep_first

    once = derived.cytoplasms(spark, sf).select("*", F.col("vec_id").alias("obj_id"))
    again = once.filter("vec_id % 3 = 0").withColumn("obj_id", F.col("obj_id") + 1000000)
    unique = dedup_keep_first(once.unionByName(again), ["image_id", "object_id"])
    counts = spatial.pair_distance_counts(unique)
    return rounded(spatial.ordered_pair_counts(counts), "distance")


@query(
    "pair_distance_hist",
    check(
        ["pairdist"],
        """SELECT label_a, label_b, CAST(CASE WHEN low = high THEN 5 ELSE
        least(floor((distance - low) * 10 / (high - low)), 9) END AS BIGINT) AS bin,
        count(*) AS n_pairs FROM (SELECT label_a, label_b, distance,
        min(distance) OVER (PARTITION BY label_a, label_b) AS low,
        max(distance) OVER (PARTITION BY label_a, label_b) AS high FROM (
        SELECT label_a, label_b, sqrt(CAST(d2 AS DOUBLE)) AS distance FROM pairdist))
        GROUP BY 1, 2, 3""",
    ),
)
def _(spark, sf):
    counts = spatial.pair_distance_counts(derived.cytoplasms(spark, sf))
    return spatial.distance_histogram(counts)


def fill_parts(rings: str, edges: str) -> list[tuple[str, str]]:
    """Named parts up to ``covered``, the pixels (vec_id, y, x) of rings, border included."""
    cross = "x1 + CAST((l.y - y1) * (x2 - x1) AS DOUBLE) / (y2 - y1)"
    return [
        (
            "ring_lines",
            f"""SELECT vec_id, unnest(range(lo, hi + 1)) AS y FROM (
            SELECT vec_id, min(y) AS lo, max(y) AS hi FROM {rings} GROUP BY vec_id)""",
        ),
        (
            "cuts",
            f"""SELECT l.vec_id, l.y, row_number() OVER (PARTITION BY l.vec_id, l.y ORDER BY {cross}) AS r,
            CAST(floor({cross} + 1e-9) AS BIGINT) AS lo, CAST(ceil({cross} - 1e-9) AS BIGINT) AS hi
            FROM ring_lines l JOIN {edges} e ON e.vec_id = l.vec_id AND (y1 > l.y) <> (y2 > l.y)""",
        ),
        (
            "covered",
            f"""SELECT vec_id, y, unnest(range(a, b + 1)) AS x FROM (
            SELECT p.vec_id, p.y, p.hi AS a, q.lo AS b FROM cuts p JOIN cuts q
            ON p.vec_id = q.vec_id AND p.y = q.y AND q.r = p.r + 1 AND p.r % 2 = 1 WHERE p.hi <= q.lo)
            UNION SELECT vec_id, y1, unnest(range(least(x1, x2), greatest(x1, x2) + 1)) FROM {edges} WHERE y1 = y2
            UNION SELECT vec_id, y1, x1 FROM {edges}""",
        ),
    ]


@query(
    "polygon_rasterize",
    check(
        ["cyto_v", "cyto_e"],
        """SELECT vec_id // 8 AS image_id, vec_id % 8 + 1 AS object_id, count(*) AS n,
        CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(y) AS BIGINT) AS sum_y,
        CAST(sum(x * y) AS BIGINT) AS sum_xy FROM covered GROUP BY vec_id""",
        *fill_parts("cyto_v", "cyto_e"),
    ),
)
def _(spark, sf):
    return (
        spatial.polygon_rasterize(derived.cytoplasms(spark, sf))
        .groupBy("image_id", "object_id")
        .agg(
            F.count("*").alias("n"),
            F.sum("x").alias("sum_x"),
            F.sum("y").alias("sum_y"),
            F.sum(F.col("x") * F.col("y")).alias("sum_xy"),
        )
    )


# ------------------------------------------------- rectangles, ellipses, poles

_HULL = """SELECT h.vec_id, h.ux, h.uy, (max(v.x * h.ux + v.y * h.uy) - min(v.x * h.ux + v.y * h.uy))
    * (max(v.y * h.ux - v.x * h.uy) - min(v.y * h.ux - v.x * h.uy))
    / CAST(h.ux * h.ux + h.uy * h.uy AS DOUBLE) AS box,
    min((v.y - h.oy) * h.ux - (v.x - h.ox) * h.uy) AS lowest
    FROM (SELECT DISTINCT a.vec_id, a.x AS ox, a.y AS oy, b.x - a.x AS ux, b.y - a.y AS uy
    FROM cyto_v a JOIN cyto_v b ON a.vec_id = b.vec_id AND (a.x <> b.x OR a.y <> b.y)) h
    JOIN cyto_v v ON v.vec_id = h.vec_id GROUP BY h.vec_id, h.ox, h.oy, h.ux, h.uy"""
_BOXES = "SELECT vec_id, min(box) AS box FROM hull WHERE lowest >= 0 GROUP BY vec_id"


@query(
    "area_box",
    check(
        ["cyto_v", "cyto_p"],
        f"SELECT p.vec_id, {sq('area / box')} AS area_box FROM cyto_p p JOIN boxes b ON p.vec_id = b.vec_id",
        ("hull", _HULL),
        ("boxes", _BOXES),
    ),
)
def _(spark, sf):
    return rounded(
        geometry.area_box(derived.cytoplasms(spark, sf)).select("vec_id", "area_box"), "area_box"
    )


def _solve(name: str, source: str, terms: list[str], key: str = "vec_id") -> list[tuple[str, str]]:
    """Named parts that solve the normal equations of terms . s = 1 by elimination."""
    n = len(terms)
    sums = [
        f"sum(({terms[a]}) * ({terms[b]})) AS m{a}_{b}" for a in range(n) for b in range(n)
    ] + [f"sum({terms[a]}) AS m{a}_{n}" for a in range(n)]
    parts = [(f"{name}0", f"SELECT {key}, {', '.join(sums)} FROM {source} GROUP BY {key}")]
    for p in range(n):
        cells = []
        for a in range(n):
            for b in range(n + 1):
                if a == p:
                    cells.append(f"m{p}_{b} / m{p}_{p} AS m{a}_{b}")
                else:
                    cells.append(f"m{a}_{b} - m{a}_{p} * m{p}_{b} / m{p}_{p} AS m{a}_{b}")
        parts.append((f"{name}{p + 1}", f"SELECT {key}, {', '.join(cells)} FROM {name}{p}"))
    parts.append(
        (name, f"SELECT {key}, {', '.join(f'm{a}_{n} AS s{a}' for a in range(n))} FROM {name}{n}")
    )
    return parts


_ELLIPSE = [
    (
        "centred",
        """SELECT v.vec_id, (x - mx) / s AS x, (y - my) / s AS y, s FROM cyto_v v JOIN (
        SELECT v.vec_id, any_value(mx) AS mx, any_value(my) AS my,
        max(greatest(abs(x - mx), abs(y - my))) AS s FROM cyto_v v JOIN (
        SELECT vec_id, avg(x) AS mx, avg(y) AS my FROM cyto_v GROUP BY vec_id) m
        ON m.vec_id = v.vec_id GROUP BY v.vec_id) c ON c.vec_id = v.vec_id""",
    ),
    *_solve("conic", "centred", ["-x * x", "-y * y", "-x * y", "x", "y"]),
    (
        "shifted",
        """SELECT c.vec_id, s, x - (2 * s1 * s3 - s2 * s4) / (4 * s0 * s1 - s2 * s2) AS u,
        y - (2 * s0 * s4 - s2 * s3) / (4 * s0 * s1 - s2 * s2) AS w
        FROM centred c JOIN conic g ON g.vec_id = c.vec_id""",
    ),
    *_solve("axes", "shifted", ["u * u", "w * w", "u * w"]),
    (
        "fitted",
        """SELECT a.vec_id, s * 2 / sqrt((s0 + s1 - sqrt((s0 - s1) * (s0 - s1) + s2 * s2)) / 2) AS major,
        s * 2 / sqrt((s0 + s1 + sqrt((s0 - s1) * (s0 - s1) + s2 * s2)) / 2) AS minor
        FROM axes a JOIN (SELECT DISTINCT vec_id, s FROM centred) c ON c.vec_id = a.vec_id""",
    ),
]
_ECCENTRICITY = "sqrt(greatest(major * major - minor * minor, 0.0)) / (major * major)"


@query(
    "ellipse_features",
    check(
        ["cyto_v"],
        f"SELECT vec_id, {sq('major / minor')} AS aspect, {sq(_ECCENTRICITY)} AS eccentricity FROM fitted",
        *_ELLIPSE,
    ),
)
def _(spark, sf):
    fitted = geometry.ellipse_features(derived.cytoplasms(spark, sf))
    return rounded(fitted.select("vec_id", "aspect", "eccentricity"), "aspect", "eccentricity")


_INDEX = (
    "0.9 * (major / minor) - 0.87 * (area / box) + 0.96 * radius_ratio"
    " + 0.92 * (perimeter * perimeter / (4.0 * pi() * area))"
)


@query(
    "irregularity_index",
    check(
        ["cyto_v", "cyto_p"],
        f"""SELECT p.vec_id, {sq(_INDEX)} AS ii FROM cyto_p p JOIN boxes b ON p.vec_id = b.vec_id
        JOIN fitted f ON f.vec_id = p.vec_id JOIN radii r ON r.vec_id = p.vec_id""",
        *_ELLIPSE,
        ("hull", _HULL),
        ("boxes", _BOXES),
        ("radii", _RADII),
    ),
)
def _(spark, sf):
    return rounded(
        geometry.morpho_features(derived.cytoplasms(spark, sf)).select("vec_id", "ii"), "ii"
    )


@query(
    "morpho_features",
    check(
        ["cyto_v", "cyto_p", "cyto_e"],
        f"""SELECT p.vec_id, cx AS cx_coords, cy AS cy_coords, {sq('area')} AS area,
        {sq('area / box')} AS area_box, {sq('radius_ratio')} AS radius_ratio,
        {sq('major / minor')} AS aspect, {sq(_ECCENTRICITY)} AS eccentricity,
        {_ROUND} AS roundness, {sq(_INDEX)} AS ii
        FROM cyto_p p JOIN boxes b ON p.vec_id = b.vec_id
        JOIN fitted f ON f.vec_id = p.vec_id JOIN radii r ON r.vec_id = p.vec_id""",
        *_ELLIPSE,
        ("hull", _HULL),
        ("boxes", _BOXES),
        ("radii", _RADII),
    ),
)
def _(spark, sf):
    shapes = geometry.morpho_features(derived.cytoplasms(spark, sf)).drop(
        "image_id", "image_name", "object_id", "label", "contour"
    )
    return rounded(shapes, "area", "area_box", "radius_ratio", "aspect", "eccentricity", "roundness", "ii")




@query("interior_pole")
def _(spark, sf):
    """Deepest point of C-shaped rings; compared with a full search in the tests."""
    return geometry.interior_poles(derived.crescents(spark, sf)).select("vec_id", "pole_x", "pole_y")


@query(
    "centroid_inside",
    check(
        ["crescent_e", "crescent_p"],
        "SELECT k AS vec_id, CAST(side AS BIGINT) AS side FROM sides",
        (
            "sides",
            _side(
                "crescent_e",
                "(SELECT e.vec_id AS k, e.*, cx AS px, cy AS py FROM crescent_e e"
                " JOIN crescent_p p ON p.vec_id = e.vec_id)",
            ),
        ),
    ),
)
def _(spark, sf):
    placed = geometry.with_ring(derived.crescents(spark, sf))
    sums = F.col("_sums")
    return placed.select(
        "vec_id",
        ring.point_side(F.col("_edges"), ring.centroid_x(sums), ring.centroid_y(sums)).alias("side"),
    )


@query("object_centre")
def _(spark, sf):
    """Centre of C-shaped rings: centroid where inside, else the pole."""
    return geometry.object_centre(derived.crescents(spark, sf)).select(
        "vec_id", "cx_coords", "cy_coords"
    )
