"""Queries over pixel tables: intensity, texture, neighbourhoods, labels, crops."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellmetry.functions.names import CHANNELS
from cellmetry.operators import components, geometry, outlines, pixels as px, spatial, texture, tiles
from cellmetry.operators.tiles import glcm_offsets
from cellmetry.plans import pipeline
from cellmetry.plans.registry import check, query, r6, rounded, sq
from cellmetry.plans.shapes import fill_parts
from cellmetry.sources import derived

_RING8 = [(0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1)]

# ---------------------------------------------------------------- pointwise


@query(
    "quantize_levels",
    check(
        ["pix"],
        "SELECT image_id, y, x, least(grayscale // 8, 31) AS level FROM pix",
    ),
)
def _(spark, sf):
    return derived.pixels(spark, sf).select(
        "image_id", "y", "x", texture.quantize_levels(F.col("grayscale")).alias("level")
    )


@query(
    "threshold_mask",
    check(
        ["pix"],
        """SELECT image_id, y, x, CAST(CASE WHEN grayscale > 200 OR grayscale < 30 THEN 0 ELSE 255 END
        AS BIGINT) AS mask FROM pix""",
    ),
)
def _(spark, sf):
    return derived.pixels(spark, sf).select(
        "image_id", "y", "x", px.threshold_mask(F.col("grayscale"), 30, 200).alias("mask")
    )


_RESCALED = """SELECT image_id, y, x, CAST(floor(255.0 * ((grayscale - mean) / (dev + 1e-6) - (low - mean) / (dev + 1e-6))
    / ((high - mean) / (dev + 1e-6) - (low - mean) / (dev + 1e-6) + 1e-6)) AS BIGINT) AS grayscale
    FROM pix JOIN (SELECT image_id, s / n AS mean, sqrt((n * ss - s * s) / (n * n)) AS dev, low, high
    FROM (SELECT image_id, CAST(count(*) AS DOUBLE) AS n, CAST(sum(grayscale) AS DOUBLE) AS s,
    CAST(sum(grayscale * grayscale) AS DOUBLE) AS ss, CAST(min(grayscale) AS DOUBLE) AS low,
    CAST(max(grayscale) AS DOUBLE) AS high FROM pix GROUP BY image_id)) USING (image_id)"""


@query(
    "zscore_rescale",
    check(
        ["pix"],
        _RESCALED,
    ),
)
def _(spark, sf):
    return px.zscore_rescale(derived.pixels(spark, sf)).select("image_id", "y", "x", "grayscale")


@query(
    "minmax_image",
    check(
        ["pix"],
        f"""SELECT image_id, y, x, {sq('(grayscale - a) / (b - a + 1e-6)')} AS grayscale,
        {sq('(red - c) / (d - c + 1e-6)')} AS red FROM pix JOIN (SELECT image_id,
        min(grayscale) AS a, max(grayscale) AS b, min(red) AS c, max(red) AS d
        FROM pix GROUP BY image_id) USING (image_id)""",
    ),
)
def _(spark, sf):
    scaled = px.minmax_image(derived.pixels(spark, sf), ["grayscale", "red"])
    return rounded(scaled.select("image_id", "y", "x", "grayscale", "red"), "grayscale", "red")


@query(
    "channel_adjust",
    check(
        ["pix"],
        "SELECT image_id, y, x, grayscale AS c0, red AS c1, grayscale AS c2 FROM pix",
    ),
)
def _(spark, sf):
    return px.channel_adjust(
        derived.pixels(spark, sf), ["grayscale", "red"], 3, ("image_id", "y", "x")
    )


@query(
    "channel_blend",
    check(
        ["pix"],
        """SELECT image_id, y, x, CAST(round_even(0.5 * red + 0.5 * green, 0) AS BIGINT) AS v FROM pix""",
    ),
)
def _(spark, sf):
    base = derived.pixels(spark, sf)
    return px.channel_blend(
        base.selectExpr("image_id", "y", "x", "red as v"),
        base.selectExpr("image_id", "y", "x", "green as v"),
    )


@query(
    "apply_mask",
    check(
        ["pix"],
        """SELECT image_id, y, x, CASE WHEN obj = 6 THEN grayscale ELSE 0 END AS grayscale FROM pix""",
    ),
)
def _(spark, sf):
    base = derived.pixels(spark, sf).select("image_id", "y", "x", "grayscale", "obj")
    masked = px.apply_mask(base, base.filter("obj = 6"), "grayscale")
    return masked.select("image_id", "y", "x", F.col("grayscale").cast("bigint").alias("grayscale"))


@query("object_ids", check(["pix"], "SELECT DISTINCT image_id, obj FROM pix WHERE obj > 0"))
def _(spark, sf):
    return px.object_ids(derived.pixels(spark, sf))


@query(
    "object_pixel_counts",
    check(
        ["pix"],
        """SELECT image_id, obj, count(*) AS n_inside, 4096 - count(*) AS n_outside FROM pix
        WHERE obj > 0 GROUP BY image_id, obj""",
    ),
)
def _(spark, sf):
    return px.object_pixel_counts(derived.pixels(spark, sf))


@query(
    "remove_small_objects",
    check(
        ["pix"],
        """SELECT image_id, y, x, CASE WHEN obj > 0 AND n >= 80 THEN obj ELSE 0 END AS obj FROM (
        SELECT *, count(*) OVER (PARTITION BY image_id, obj) AS n FROM pix)""",
    ),
)
def _(spark, sf):
    return px.remove_small_objects(
        derived.pixels(spark, sf).select("image_id", "y", "x", "obj"), least=80
    )


# ---------------------------------------------------------------- neighbourhoods

# Five weights of sigma 4 in 256ths.
_WEIGHTS = "SELECT unnest([-2, -1, 0, 1, 2]) AS t, unnest([48, 53, 54, 53, 48]) AS w"


def _mirrored(axis: str, step: str) -> str:
    return f"63 - abs(63 - abs({axis} + {step}))"


@query(
    "gaussian_blur",
    check(
        ["pix"],
        f"""SELECT image_id, y, x, CAST((sum(w * v) + 32768) // 65536 AS BIGINT) AS grayscale FROM (
        SELECT r.image_id, r.y, p.x, t.w, r.v FROM (SELECT p.image_id, p.y, q.x, sum(t.w * q.grayscale) AS v
        FROM pix p, taps t, pix q WHERE p.x = q.x AND q.image_id = p.image_id
        AND q.y = {_mirrored('p.y', 't.t')} GROUP BY p.image_id, p.y, q.x) r, taps t, pix p
        WHERE p.image_id = r.image_id AND p.y = r.y AND r.x = {_mirrored('p.x', 't.t')})
        GROUP BY image_id, y, x""",
        ("taps", _WEIGHTS),
    ),
)
def _(spark, sf):
    return tiles.gaussian_blur(derived.pixels(spark, sf))


@query(
    "grey_close_3x3",
    check(
        ["pix"],
        """SELECT d.image_id, d.y, d.x, min(e.v) AS obj FROM dilated d JOIN dilated e
        ON d.image_id = e.image_id AND e.y BETWEEN d.y - 1 AND d.y + 1 AND e.x BETWEEN d.x - 1 AND d.x + 1
        GROUP BY d.image_id, d.y, d.x""",
        (
            "dilated",
            """SELECT image_id, y + dy AS y, x + dx AS x, max(obj) AS v FROM pix,
            (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)
            WHERE y + dy BETWEEN 0 AND 63 AND x + dx BETWEEN 0 AND 63 GROUP BY 1, 2, 3""",
        ),
    ).replace(
        """FROM dilated d JOIN dilated e
        ON d.image_id = e.image_id AND e.y BETWEEN d.y - 1 AND d.y + 1 AND e.x BETWEEN d.x - 1 AND d.x + 1""",
        """FROM dilated d, (SELECT image_id, y + dy AS ty, x + dx AS tx, v FROM dilated,
        (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)) e
        WHERE d.image_id = e.image_id AND d.y = e.ty AND d.x = e.tx""",
    ),
)
def _(spark, sf):
    return tiles.grey_close_3x3(derived.pixels(spark, sf))


_SHIFTED = ", ".join(f"({dy}, {dx})" for dy, dx in _RING8)


@query(
    "boundary_pixels",
    check(
        ["pix"],
        f"""SELECT image_id, y, x, obj FROM (SELECT p.image_id, p.y, p.x, p.obj, count(q.obj) AS same
        FROM (SELECT p.*, dy, dx FROM pix p, (VALUES {_SHIFTED}) s(dy, dx) WHERE obj > 0) p
        LEFT JOIN pix q ON q.image_id = p.image_id AND q.y = p.y + dy AND q.x = p.x + dx AND q.obj = p.obj
        GROUP BY p.image_id, p.y, p.x, p.obj) WHERE same < 8""",
    ),
)
def _(spark, sf):
    return tiles.boundary_pixels(derived.pixels(spark, sf))


def _bits(channel: str) -> list[str]:
    """SQL bits of the pattern in ring order, from columns <channel>_<k> of the neighbours."""
    out = []
    for k, (dy, dx) in enumerate(_RING8):
        if dy == 0 or dx == 0:
            out.append(f"CASE WHEN {channel}_{k} >= {channel} THEN 1 ELSE 0 END")
        else:
            a, b = _RING8.index((dy, 0)), _RING8.index((0, dx))
            out.append(
                f"CASE WHEN 5000045521 * {channel}_{k} + 2071054479 * ({channel}_{a} + {channel}_{b})"
                f" + 857845521 * {channel} >= 10000000000 * {channel} THEN 1 ELSE 0 END"
            )
    return out


# Neighbours by two steps along rows and columns; what lies outside an image is 0.
_SIDES = {-1: "before_", 0: "", 1: "after_"}


def _neighbour(column: str, dy: int, dx: int) -> str:
    beside = _SIDES[dx] + column
    step = {-1: "lag", 1: "lead"}.get(dy)
    return f"{step}({beside}, 1, 0) OVER columns" if step else beside


_BESIDE = (
    "SELECT *, "
    + ", ".join(
        f"{step}({c}, 1, 0) OVER rows_ AS {side}{c}"
        for step, side in (("lag", "before_"), ("lead", "after_"))
        for c in (*CHANNELS, "obj")
    )
    + " FROM pix WINDOW rows_ AS (PARTITION BY image_id, y ORDER BY x)"
)
_NEAR = (
    "SELECT image_id, y, x, obj, "
    + ", ".join(CHANNELS)
    + ", "
    + ", ".join(
        f"{_neighbour(c, dy, dx)} AS {c}_{k}"
        for k, (dy, dx) in enumerate(_RING8)
        for c in (*CHANNELS, "obj")
    )
    + f" FROM ({_BESIDE}) WINDOW columns AS (PARTITION BY image_id, x ORDER BY y)"
)
_PATTERNS = (
    "SELECT image_id, y, x, obj, "
    + ", ".join(f"{b} AS {c}_b{k}" for c in CHANNELS for k, b in enumerate(_bits(c)))
    + " FROM near"
)
_CODES = (
    "SELECT image_id, y, x, obj, "
    + ", ".join(
        "CAST(CASE WHEN "
        + " + ".join(f"abs({c}_b{k} - {c}_b{(k + 7) % 8})" for k in range(8))
        + " <= 2 THEN "
        + " + ".join(f"{c}_b{k}" for k in range(8))
        + f" ELSE 9 END AS BIGINT) AS {c}"
        for c in CHANNELS
    )
    + " FROM patterns"
)
_LBP = [("near", _NEAR), ("patterns", _PATTERNS), ("codes", _CODES)]


@query("lbp_codes", check(["pix"], "SELECT * FROM codes", *_LBP))
def _(spark, sf):
    return tiles.lbp_codes(derived.pixels(spark, sf), CHANNELS)


_HISTOGRAM = [
    *fill_parts("disk_v", "disk_e"),
    ("filled", "SELECT vec_id // 16 AS image_id, vec_id % 16 + 1 AS obj, y, x FROM covered"),
    (
        "every",
        " UNION ALL ".join(
            f"SELECT image_id, y, x, '{c}' AS channel, {c} AS code FROM codes" for c in CHANNELS
        ),
    ),
    ("coded", "SELECT image_id, obj, channel, code FROM every JOIN filled USING (image_id, y, x)"),
    ("top", "SELECT image_id, channel, max(code) AS top FROM every GROUP BY image_id, channel"),
    (
        "bins",
        """SELECT o.image_id, o.obj, o.channel, unnest(range(t.top + 1)) AS code, o.total FROM (
        SELECT image_id, obj, channel, count(*) AS total FROM coded WHERE obj > 0
        GROUP BY image_id, obj, channel) o JOIN top t
        ON t.image_id = o.image_id AND t.channel = o.channel""",
    ),
    (
        "hist",
        """SELECT b.image_id, b.obj, b.channel, b.code, count(c.code) / CAST(any_value(total) AS DOUBLE) AS p
        FROM bins b LEFT JOIN coded c ON c.image_id = b.image_id AND c.obj = b.obj
        AND c.channel = b.channel AND c.code = b.code GROUP BY b.image_id, b.obj, b.channel, b.code""",
    ),
]


def _contour_codes(spark, sf):
    """Pattern counts within the contour of every disk."""
    rings = derived.disk_contours(spark, sf).select("image_id", "obj", "contour")
    filled = spatial.polygon_rasterize(rings, "image_id", "obj")
    return tiles.lbp_counts(derived.pixels(spark, sf), CHANNELS, filled=filled)


@query(
    "lbp_histogram",
    check(
        ["pix", "disk_v", "disk_e"],
        f"SELECT image_id, obj, channel, code, {sq('p')} AS p FROM hist",
        *_LBP,
        *_HISTOGRAM,
    ),
)
def _(spark, sf):
    return rounded(texture.lbp_histogram(_contour_codes(spark, sf)), "p")


_LBP_METRICS = [
    (
        "share",
        """SELECT image_id, obj, channel, code, p / (sum(p) OVER (PARTITION BY image_id, obj, channel) + 1e-12)
        AS h FROM hist""",
    ),
    (
        "centre",
        "SELECT image_id, obj, channel, sum(code * h) AS m FROM share GROUP BY image_id, obj, channel",
    ),
    (
        "lbpm",
        """SELECT image_id, obj, channel, entropy, sqrt(asm) AS energy, asm, mean_code, var_code,
        m3 / (pow(var_code, 1.5) + 1e-12) AS skewness, m4 / (var_code * var_code + 1e-12) AS kurtosis
        FROM (SELECT s.image_id, s.obj, s.channel, -sum((h + 1e-12) * ln(h + 1e-12)) AS entropy,
        sum(h * h) AS asm, any_value(m) AS mean_code, sum(h * (code - m) * (code - m)) AS var_code,
        sum(h * (code - m) * (code - m) * (code - m)) AS m3,
        sum(h * (code - m) * (code - m) * (code - m) * (code - m)) AS m4
        FROM share s JOIN centre c ON c.image_id = s.image_id AND c.obj = s.obj
        AND c.channel = s.channel GROUP BY s.image_id, s.obj, s.channel)""",
    ),
]


@query(
    "lbp_metrics",
    check(
        ["pix", "disk_v", "disk_e"],
        "SELECT image_id, obj, channel, "
        + ", ".join(f"{sq(m)} AS {m}" for m in texture.LBP_METRICS)
        + " FROM lbpm",
        *_LBP,
        *_HISTOGRAM,
        *_LBP_METRICS,
    ),
)
def _(spark, sf):
    counts = _contour_codes(spark, sf)
    return rounded(texture.lbp_metrics(texture.lbp_histogram(counts)), *texture.LBP_METRICS)


_ROTATIONS = ", ".join(
    f"concat({', '.join(f'grayscale_b{(k + s) % 8}' for k in range(8))})" for s in range(8)
)


@query(
    "rotation_min_code",
    check(
        ["pix"],
        f"SELECT image_id, y, x, obj, least({_ROTATIONS}) AS code FROM simple",
        ("near", _NEAR),
        (
            "simple",
            "SELECT image_id, y, x, obj, "
            + ", ".join(
                f"CASE WHEN grayscale > grayscale_{k} THEN '0' ELSE '1' END AS grayscale_b{k}"
                for k in range(8)
            )
            + " FROM near WHERE obj > 0 AND "
            + " AND ".join(f"obj_{k} = obj" for k in range(8)),
        ),
    ),
)
def _(spark, sf):
    return tiles.rotation_min_codes(derived.pixels(spark, sf))


# ---------------------------------------------------------------- GLCM

_OFFSETS = ", ".join(str(o) for o in glcm_offsets(texture.DISTANCES, texture.ANGLES))
_PAIRS = [
    (
        "levels",
        " UNION ALL ".join(
            f"SELECT image_id, y, x, obj, '{c}' AS channel, least({c} // 8, 31) AS q FROM pix WHERE obj > 0"
            for c in CHANNELS
        ),
    ),
    (
        "glcm",
        f"""SELECT a.image_id, a.obj, a.channel, CAST(d AS BIGINT) AS d, CAST(angle AS BIGINT) AS angle,
        a.q AS i, b.q AS j, count(*) AS n
        FROM (SELECT l.*, d, angle, y + dy AS y2, x + dx AS x2 FROM levels l,
        (VALUES {_OFFSETS}) o(d, angle, dy, dx)) a JOIN levels b
        ON b.image_id = a.image_id AND b.channel = a.channel AND b.obj = a.obj
        AND b.y = a.y2 AND b.x = a.x2
        GROUP BY a.image_id, a.obj, a.channel, d, angle, a.q, b.q""",
    ),
]


def _glcm(spark, sf):
    return tiles.glcm_pairs(
        derived.pixels(spark, sf), CHANNELS, texture.DISTANCES, texture.ANGLES, texture.LEVELS
    )


@query(
    "glcm_pairs",
    check(
        ["pix"],
        """SELECT image_id, obj, channel, d, angle, count(*) AS cells, CAST(sum(n) AS BIGINT) AS pairs,
        CAST(sum(n * (32 * i + j + 1)) AS BIGINT) AS weighted, CAST(sum(n * n) AS BIGINT) AS squares
        FROM glcm GROUP BY image_id, obj, channel, d, angle""",
        *_PAIRS,
    ),
)
def _(spark, sf):
    """One line of totals per matrix, since the cells themselves are many."""
    n = F.col("n")
    return (
        _glcm(spark, sf)
        .groupBy("image_id", "obj", "channel", "d", "angle")
        .agg(
            F.count("*").alias("cells"),
            F.sum(n).alias("pairs"),
            F.sum(n * (32 * F.col("i") + F.col("j") + 1)).alias("weighted"),
            F.sum(n * n).alias("squares"),
        )
    )


_MATRIX = (
    "probs",
    """SELECT image_id, obj, channel, d, angle, i, j, n / CAST(sum(n) OVER (
    PARTITION BY image_id, obj, channel, d, angle) AS DOUBLE) AS p FROM glcm""",
)


@query(
    "glcm_matrix",
    check(
        ["pix"],
        f"""SELECT image_id, obj, channel, d, angle, {sq('sum(p)')} AS total, {sq('max(p)')} AS largest,
        {sq('sum(p * p)')} AS squares, {sq('sum(p * (32 * i + j + 1))')} AS weighted
        FROM probs GROUP BY image_id, obj, channel, d, angle""",
        *_PAIRS,
        _MATRIX,
    ),
)
def _(spark, sf):
    summary = (
        texture.glcm_matrix(_glcm(spark, sf))
        .groupBy("image_id", "obj", "channel", "d", "angle")
        .agg(
            F.sum("p").alias("total"),
            F.max("p").alias("largest"),
            F.sum(F.col("p") * F.col("p")).alias("squares"),
            F.sum(F.col("p") * (32 * F.col("i") + F.col("j") + 1)).alias("weighted"),
        )
    )
    return rounded(summary, "total", "largest", "squares", "weighted")


@query(
    "glcm_features",
    check(
        ["pix"],
        f"""SELECT o.image_id, o.obj, o.channel, CAST(o.d AS BIGINT) AS d,
        {sq('coalesce(sum(contrast), 0) / 4')} AS contrast,
        {sq('coalesce(sum(dissimilarity), 0) / 4')} AS dissimilarity,
        {sq('coalesce(sum(homogeneity), 0) / 4')} AS homogeneity,
        {sq('coalesce(sum(sqrt(asm)), 0) / 4')} AS energy,
        {sq('(coalesce(sum(correlation - 1), 0) + 4) / 4')} AS correlation,
        {sq('coalesce(sum(asm), 0) / 4')} AS "ASM", {sq('coalesce(sum(entropy), 0) / 4')} AS entropy
        FROM (SELECT DISTINCT image_id, obj, channel, d FROM levels, (SELECT unnest([3, 6, 9, 18]) AS d)) o
        LEFT JOIN props g ON g.image_id = o.image_id AND g.obj = o.obj AND g.channel = o.channel
        AND g.d = o.d GROUP BY o.image_id, o.obj, o.channel, o.d""",
        *_PAIRS,
        _MATRIX,
        (
            "marginal",
            """SELECT image_id, obj, channel, d, angle, sum(p * i) AS mi, sum(p * j) AS mj
            FROM probs GROUP BY image_id, obj, channel, d, angle""",
        ),
        (
            "props",
            """SELECT image_id, obj, channel, d, angle, contrast, dissimilarity, homogeneity, asm, entropy,
            CASE WHEN vi < 1e-15 OR vj < 1e-15 THEN 1.0 ELSE cov / (sqrt(vi) * sqrt(vj)) END AS correlation
            FROM (SELECT g.image_id, g.obj, g.channel, g.d, g.angle, sum(p * (i - j) * (i - j)) AS contrast,
            sum(p * abs(i - j)) AS dissimilarity, sum(p / (1.0 + (i - j) * (i - j))) AS homogeneity,
            sum(p * p) AS asm, -sum(p * ln(p)) AS entropy, sum(p * (i - mi) * (i - mi)) AS vi,
            sum(p * (j - mj) * (j - mj)) AS vj, sum(p * (i - mi) * (j - mj)) AS cov
            FROM probs g JOIN marginal m ON m.image_id = g.image_id AND m.obj = g.obj
            AND m.channel = g.channel AND m.d = g.d AND m.angle = g.angle
            GROUP BY g.image_id, g.obj, g.channel, g.d, g.angle)""",
        ),
    ),
)
def _(spark, sf):
    objects = texture.object_channels(derived.pixels(spark, sf), CHANNELS)
    return rounded(
        texture.glcm_features(_glcm(spark, sf), objects), *texture.GLCM_PROPERTIES
    )


# ---------------------------------------------------------------- intensity


@query(
    "intensity_features",
    check(
        ["pix"],
        "SELECT image_id, obj, "
        + ", ".join(
            f"""{sq(f'avg({c})')} AS {c}_mean, {sq(f'median({c})')} AS {c}_median,
            CAST(max({c}) AS DOUBLE) AS {c}_max, CAST(min({c}) AS DOUBLE) AS {c}_min,
            CAST(sum({c}) AS DOUBLE) AS {c}_sum,
            {sq(f'CAST(sum({c}) AS DOUBLE) / (CAST(count(*) AS DOUBLE) / 2)')} AS {c}_int_density"""
            for c in CHANNELS
        )
        + " FROM pix WHERE obj > 0 GROUP BY image_id, obj",
    ),
)
def _(spark, sf):
    base = derived.pixels(spark, sf)
    areas = base.filter("obj > 0").groupBy("image_id", "obj").agg((F.count("*") / 2).alias("area"))
    wide = texture.intensity_features(base, areas, CHANNELS)
    return rounded(
        wide, *[f"{c}_{m}" for c in CHANNELS for m in ("mean", "median", "int_density")]
    )


# ---------------------------------------------------------------- regions


@query(
    "label_components",
    check(
        ["pix"],
        """SELECT p.image_id, p.y, p.x, r.component FROM pix p JOIN (
        SELECT image_id, obj, row_number() OVER (PARTITION BY image_id ORDER BY first) AS component
        FROM (SELECT image_id, obj, min(y * 64 + x) AS first FROM pix WHERE obj > 0
        GROUP BY image_id, obj)) r ON r.image_id = p.image_id AND r.obj = p.obj""",
    ),
)
def _(spark, sf):
    binary = derived.pixels(spark, sf).selectExpr(
        "image_id", "y", "x", "case when obj > 0 then 1L else 0L end as v"
    )
    return components.label_components(binary, "v", side=24).select(
        "image_id", "y", "x", "component"
    )


@query("label_components_irregular")
def _(spark, sf):
    """Regions of a threshold image; compared with a flood fill in the tests."""
    binary = derived.pixels(spark, sf).selectExpr(
        "image_id", "y", "x", "case when grayscale >= 128 then 1L else 0L end as v"
    )
    return (
        components.label_components(binary, "v")
        .groupBy("image_id", "component")
        .agg(F.count("*").alias("n"), F.min("y").alias("top"), F.min("x").alias("left"))
    )


# Disks with a ring cut out round their middle; a third of them are open to the right, so the
# ring is no hole and the middle is a region of its own.
_HOLED = """obj > 0 AND NOT (d2 BETWEEN 1 AND 4) AND NOT (obj % 3 = 0 AND y % 16 = 8 AND x % 16 > 8)"""
_MIDDLE = "(y % 16 - 8) * (y % 16 - 8) + (x % 16 - 8) * (x % 16 - 8)"
_CONTOURED = [
    (
        "inside",
        f"""SELECT image_id, y, x, obj FROM (SELECT *, {_MIDDLE} AS d2 FROM pix) WHERE obj > 0
        AND (obj % 3 <> 0 OR ({_HOLED} AND d2 > 0))""",
    ),
    (
        "squares",
        """SELECT image_id, obj, n, CASE n WHEN 3 THEN 0.5 WHEN 4 THEN 1 ELSE 0 END AS part,
        n = 2 AND y2 = y1 + 1 AND x2 = x1 + 1 AS diagonal FROM (
        SELECT image_id, obj, qy, qx, count(*) AS n, min(y) AS y1, max(y) AS y2, min(x) AS x1, max(x) AS x2 FROM (
        SELECT image_id, obj, y, x, y - dy AS qy, x - dx AS qx FROM inside, (SELECT unnest([0, 1]) AS dy),
        (SELECT unnest([0, 1]) AS dx)) GROUP BY image_id, obj, qy, qx)""",
    ),
    (
        "sized",
        """SELECT image_id, obj, CAST(sum(part) AS DOUBLE) AS area FROM squares GROUP BY image_id, obj""",
    ),
]


def _holed(spark, sf):
    return derived.pixels(spark, sf).selectExpr("*", f"{_MIDDLE} as d2").selectExpr(
        "image_id", "y", "x", "obj", f"case when {_HOLED} then 1L else 0L end as v"
    )


@query(
    "component_size_filter",
    check(
        ["pix"],
        "SELECT image_id, y, x FROM inside JOIN sized USING (image_id, obj) WHERE area BETWEEN 45 AND 80",
        *_CONTOURED,
    ),
)
def _(spark, sf):
    """Holed and open disks over several tiles: kept by the area of their outer contour."""
    return outlines.component_size_filter(_holed(spark, sf), "v", 45, 80, side=24)


@query(
    "contour_areas",
    check(["pix"], "SELECT image_id, obj, area FROM sized", *_CONTOURED),
)
def _(spark, sf):
    base = _holed(spark, sf)
    filled = outlines.outside_filled(base, "v", side=24).selectExpr("*", "1L as one")
    regions = components.pixel_regions(filled, "one", side=24)
    named = base.filter("v > 0").selectExpr("image_id", f"y * {components.ROW} + x as root", "obj")
    areas = outlines.contour_areas(regions, side=24).filter("area > 0")  # without lone middles
    return areas.join(named.hint("merge"), ["image_id", "root"]).select("image_id", "obj", "area")


@query(
    "mask_outlines",
    check(
        ["pix"],
        """SELECT image_id, obj, string_agg(concat(x, ',', y), ' ' ORDER BY turn) AS contour FROM around
        GROUP BY image_id, obj""",
        (
            "around",
            """SELECT p.image_id, p.obj, p.x, p.y, CASE WHEN t > turn0 + 1e-9 THEN turn0 + 2 * pi() - t
            ELSE turn0 - t END AS turn FROM (SELECT *, atan2(y % 16 - 8, x % 16 - 8) AS t FROM pix WHERE obj > 0) p
            JOIN (SELECT image_id, obj, min_by(atan2(y % 16 - 8, x % 16 - 8), y * 64 + x) AS turn0 FROM pix
            WHERE obj > 0 GROUP BY image_id, obj) USING (image_id, obj) WHERE EXISTS (SELECT 1 FROM pix q
            WHERE q.image_id = p.image_id AND abs(q.y - p.y) + abs(q.x - p.x) = 1 AND q.obj <> p.obj)""",
        ),
    ),
)
def _(spark, sf):
    """Contours of the disks over tiles of 24, in order against the sense of the clock."""
    labels = derived.pixels(spark, sf).select("image_id", "y", "x", "obj")
    return outlines.mask_outlines(labels, "obj", side=24).selectExpr(
        "image_id", "obj", "array_join(transform(contour, p -> concat(p.x, ',', p.y)), ' ') as contour"
    )


@query(
    "outline_features",
    check(
        ["pix"],
        f"""SELECT image_id, obj, {sq('area')} AS area, {sq('perimeter')} AS perimeter, n FROM (
        SELECT image_id, obj, CAST(sum(part) AS DOUBLE) AS area,
        sum(CASE WHEN n = 3 THEN sqrt(2.0::DOUBLE) WHEN diagonal THEN 2 * sqrt(2.0::DOUBLE) WHEN n = 2 THEN 1 ELSE 0 END)
        AS perimeter, CAST(sum(CASE WHEN n = 3 THEN 1 WHEN diagonal THEN 2 WHEN n = 2 THEN 1 ELSE 0 END) AS BIGINT) AS n
        FROM squares GROUP BY image_id, obj)""",
        *_CONTOURED,
    ),
)
def _(spark, sf):
    """Mask to rings to polygon features: no given contours are needed."""
    mask = _holed(spark, sf)
    filled = outlines.outside_filled(mask, "v", side=24).join(
        mask.select("image_id", "y", "x", "obj").hint("merge"), ["image_id", "y", "x"]
    )
    rings = outlines.mask_outlines(filled, "obj", side=24).filter("size(contour) > 1")
    measured = geometry.polygon_features(rings)
    return rounded(
        measured.selectExpr("image_id", "obj", "area", "perimeter", "cast(size(contour) as bigint) as n"),
        "area",
        "perimeter",
    )


# ---------------------------------------------------------------- enhancement, resize, crops

_CLAHE = [
    (
        "tilehist",
        """SELECT image_id, y // 8 AS ty, x // 8 AS tx, grayscale AS v, count(*) AS n FROM pix
        GROUP BY 1, 2, 3, 4""",
    ),
    (
        "excess",
        """SELECT image_id, ty, tx, CAST(sum(greatest(n - 1, 0)) AS BIGINT) AS e FROM tilehist
        GROUP BY image_id, ty, tx""",
    ),
    (
        "filled",
        """SELECT e.image_id, e.ty, e.tx, g.v, least(coalesce(h.n, 0), 1) + e // 256
        + CASE WHEN g.v % greatest(256 // greatest(e % 256, 1), 1) = 0
        AND g.v // greatest(256 // greatest(e % 256, 1), 1) < e % 256 THEN 1 ELSE 0 END AS n
        FROM excess e CROSS JOIN (SELECT unnest(range(256)) AS v) g LEFT JOIN tilehist h
        ON h.image_id = e.image_id AND h.ty = e.ty AND h.tx = e.tx AND h.v = g.v""",
    ),
    (
        "curve",
        """SELECT image_id, ty, tx, v, least(round_even(CAST(sum(n) OVER (
        PARTITION BY image_id, ty, tx ORDER BY v) AS DOUBLE) * (255.0::DOUBLE / 64), 0), 255) AS level
        FROM filled""",
    ),
    (
        "place",
        """SELECT image_id, y, x, grayscale AS v, y / 8.0::DOUBLE - 0.5 - floor(y / 8.0::DOUBLE - 0.5) AS fy,
        x / 8.0::DOUBLE - 0.5 - floor(x / 8.0::DOUBLE - 0.5) AS fx,
        CAST(greatest(floor(y / 8.0::DOUBLE - 0.5), 0) AS BIGINT) AS y1,
        CAST(least(floor(y / 8.0::DOUBLE - 0.5) + 1, 7) AS BIGINT) AS y2,
        CAST(greatest(floor(x / 8.0::DOUBLE - 0.5), 0) AS BIGINT) AS x1,
        CAST(least(floor(x / 8.0::DOUBLE - 0.5) + 1, 7) AS BIGINT) AS x2 FROM pix""",
    ),
]


_EQUALISED = (
    """SELECT p.image_id, p.y, p.x, CAST(round_even((a.level * (1.0::DOUBLE - fx) + b.level * fx)
    * (1.0::DOUBLE - fy) + (c.level * (1.0::DOUBLE - fx) + d.level * fx) * fy, 0) AS BIGINT)
    AS grayscale FROM place p """
    + " ".join(
        f"JOIN curve {n} ON {n}.image_id = p.image_id AND {n}.v = p.v AND {n}.ty = p.{y} AND {n}.tx = p.{x}"
        for n, y, x in (("a", "y1", "x1"), ("b", "y1", "x2"), ("c", "y2", "x1"), ("d", "y2", "x2"))
    )
)


@query(
    "clahe",
    check(
        ["pix"],
        _EQUALISED,
        *_CLAHE,
    ),
)
def _(spark, sf):
    return px.clahe(derived.pixels(spark, sf))


@query(
    "clahe_uneven",
    check(
        ["pix"],
        _EQUALISED,
        ("cutpix", "SELECT image_id, y, x, grayscale FROM pix WHERE x < 59 AND y < 61 - 5 * (image_id % 2)"),
        (
            "mirrored",
            """SELECT image_id, t.yy AS y, u.xx AS x, grayscale FROM (SELECT unnest(range(64)) AS yy) t,
            (SELECT unnest(range(64)) AS xx) u, cutpix c WHERE c.x = CASE WHEN xx < 59 THEN xx ELSE 116 - xx END
            AND c.y = CASE WHEN yy < 61 - 5 * (image_id % 2) THEN yy ELSE 120 - 10 * (image_id % 2) - yy END""",
        ),
        *[(n, t.replace("FROM pix", "FROM mirrored" if n == "tilehist" else "FROM cutpix")) for n, t in _CLAHE],
    ),
)
def _(spark, sf):
    """Sides of 61 or 56 and 59 on a grid of 8."""
    cut = derived.pixels(spark, sf).filter("x < 59 and y < 61 - 5 * (image_id % 2)")
    return px.clahe(cut.select("image_id", "y", "x", "grayscale"))


@query(
    "enhancement_chain",
    check(
        ["pix"],
        _EQUALISED,
        ("enhanced", _RESCALED),
        *[(name, text.replace("FROM pix", "FROM enhanced")) for name, text in _CLAHE],
    ),
)
def _(spark, sf):
    """Rescaling and equalisation as one plan."""
    rescaled = px.zscore_rescale(derived.pixels(spark, sf))
    return px.clahe(rescaled.select("image_id", "y", "x", "grayscale"))


@query(
    "resize_bilinear",
    check(
        ["pix"],
        f"""SELECT image_id, r.t AS y, c.t AS x, {sq('''(g[r.k0 * 64 + c.k0 + 1] * (1 - c.f)
        + g[r.k0 * 64 + c.k1 + 1] * c.f) * (1 - r.f) + (g[r.k1 * 64 + c.k0 + 1] * (1 - c.f)
        + g[r.k1 * 64 + c.k1 + 1] * c.f) * r.f''')} AS grayscale FROM flat, axis40 r, axis24 c""",
        ("flat", "SELECT image_id, list(grayscale ORDER BY y, x) AS g FROM pix GROUP BY image_id"),
        *[
            (
                f"axis{n}",
                f"""SELECT t, CAST(floor(s) AS BIGINT) AS k0, CAST(least(floor(s) + 1, 63) AS BIGINT) AS k1,
                s - floor(s) AS f FROM (SELECT t, least(greatest((t + 0.5::DOUBLE) * (64 / {n}.0::DOUBLE) - 0.5, 0), 63)
                AS s FROM (SELECT unnest(range({n})) AS t))""",
            )
            for n in (40, 24)
        ],
    ),
)
def _(spark, sf):
    return rounded(px.resize_bilinear(derived.pixels(spark, sf), (40, 24)), "grayscale")


_CROPPED = """SELECT image_id, obj, CASE WHEN wide THEN lx ELSE ly END AS crop_y,
    CASE WHEN wide THEN greatest(sy, y2 - y1) - 1 - ly ELSE lx END AS crop_x, v FROM (
    SELECT *, y - y1 + greatest(sy - (y2 - y1), 0) // 2 AS ly,
    x - x1 + greatest(sx - (x2 - x1), 0) // 2 AS lx FROM (
    SELECT p.image_id, p.obj, p.y, p.x, p.{channel} AS v, wide, sx, sy,
    greatest(CAST(trunc(cx - sx / 2.0) AS BIGINT), 0) AS x1, least(CAST(trunc(cx + sx / 2.0) AS BIGINT), 64) AS x2,
    greatest(CAST(trunc(cy - sy / 2.0) AS BIGINT), 0) AS y1, least(CAST(trunc(cy + sy / 2.0) AS BIGINT), 64) AS y2
    FROM cutpix p JOIN framed f ON f.image_id = p.image_id AND f.obj = p.obj)
    WHERE y >= y1 AND y < y2 AND x >= x1 AND x < x2) WHERE v <> 0"""
_FRAMED = """SELECT *, CASE WHEN wide THEN max(greatest(w, h)) OVER () ELSE max(least(w, h)) OVER () END AS sx,
    CASE WHEN wide THEN max(least(w, h)) OVER () ELSE max(greatest(w, h)) OVER () END AS sy FROM (
    SELECT *, w > h AS wide FROM (SELECT image_id, obj, (min(x) + max(x) + 1) / 2.0 AS cx,
    (min(y) + max(y) + 1) / 2.0 AS cy, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h
    FROM (SELECT image_id, y, x, obj FROM cutpix WHERE obj > 0) GROUP BY image_id, obj))"""
_CROP_CHANNELS = ["green", "red", "grayscale"]


@query(
    "object_crop",
    check(
        ["pix"],
        f"SELECT * FROM ({_CROPPED.format(channel='grayscale')})",
        (  # every third disk loses its right columns, so that boxes differ and some are wide
            "cutpix",
            """SELECT image_id, y, x, grayscale, CASE WHEN obj % 3 = 0 AND x % 16 >= 10 THEN 0
            WHEN obj % 3 = 1 AND y % 16 >= 10 THEN 0 ELSE obj END AS obj FROM pix""",
        ),
        ("framed", _FRAMED),
    ),
)
def _(spark, sf):
    cut = """CASE WHEN obj % 3 = 0 AND x % 16 >= 10 THEN 0 WHEN obj % 3 = 1 AND y % 16 >= 10 THEN 0
        ELSE obj END as obj"""
    base = derived.pixels(spark, sf).selectExpr("image_id", cut, "y", "x", "grayscale as v")
    own = base.filter("obj > 0")
    windows = own.groupBy("image_id", "obj").agg(
        ((F.min("x") + F.max("x") + 1) / 2).alias("cx"),
        ((F.min("y") + F.max("y") + 1) / 2).alias("cy"),
        (F.max("x") - F.min("x") + 1).alias("w"),
        (F.max("y") - F.min("y") + 1).alias("h"),
    )
    return px.object_crop(own, windows, px.image_sizes(base), px.crop_window_size(windows))


@query(
    "crop_chain",
    check(
        ["pix", "disk_v", "disk_e"],
        " UNION ALL ".join(
            f"""SELECT '{c}' AS channel, concat('img_img', image_id, '_crop_', obj, '.tif') AS crop_name,
            crop_y, crop_x, v FROM ({_CROPPED.format(channel=c)})"""
            for c in _CROP_CHANNELS
        ),
        *fill_parts("disk_v", "disk_e"),
        (
            "cutpix",
            """SELECT p.image_id, p.y, p.x, green, red, grayscale, vec_id % 16 + 1 AS obj FROM covered f
            JOIN pix p ON p.image_id = f.vec_id // 16 AND p.y = f.y AND p.x = f.x""",
        ),
        ("framed", _FRAMED),
    ),
)
def _(spark, sf):
    """Object table to crops: one window for all, filled contours, three images, one name."""
    return pipeline.crop_chain(
        derived.pixels(spark, sf),
        derived.disk_contours(spark, sf),
        _CROP_CHANNELS,
    )
