"""The whole pipelines as lazy plans: object table, labelled cells, class profile."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmetry.functions import names
from cellmetry.functions.names import CHANNELS, SHAPE_COLUMNS
from cellmetry.operators import geometry, pixels as px, relational as rel, spatial, texture, tiles
from cellmetry.plans.registry import check, query, r6, sq
from cellmetry.plans.shapes import (
    _BOXES,
    _ECCENTRICITY,
    _ELLIPSE,
    _HULL,
    _INDEX,
    _PARENT_POINTS,
    _PARENTS,
    _RADII,
    _side,
)
from cellmetry.session import cut_lineage
from cellmetry.sources import derived


def objects_table(
    pixels: DataFrame, contours: DataFrame, image: str = "image_id", obj: str = "obj"
) -> DataFrame:
    """One wide row per object: key, centre, shape, contour, intensity and texture.

    ``contours`` has (image, obj, contour).  Intensity and level pairs are those of the
    label, local patterns those within the contour.  The pixels are shuffled once, all
    joins are over objects.
    """
    shapes = rel.min_area_filter(geometry.morpho_features(contours))
    filled = spatial.polygon_rasterize(contours, image, obj)
    levels, patterns, pairs = tiles.object_counts(
        pixels, filled, CHANNELS, texture.DISTANCES, texture.ANGLES, texture.LEVELS, obj, image
    )
    entries = levels.count() // len(CHANNELS)  # a pixel has one level in each channel at most
    intensity = texture.intensity_of_counts(levels, shapes, CHANNELS, obj, image, entries)
    textures = texture.texture_of_counts(patterns, pairs, CHANNELS, image, obj)
    return shapes.join(intensity.hint("merge"), [image, obj]).join(textures.hint("merge"), [image, obj])


def crop_chain(
    pixels: DataFrame, contours: DataFrame, channels: list[str], image: str = "image_id", obj: str = "obj"
) -> DataFrame:
    """Crops (channel, crop_name, crop_y, crop_x, v) of every object from all channels.

    ``contours`` has (image, image_name, obj, contour).  The window is the largest of all
    boxes, an object is what its contour encloses, and its crops share one name.
    """
    boxes = geometry.bounding_boxes(contours.select(image, "image_name", obj, "contour"))
    windows = boxes.select(
        image, obj, "w", "h", (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy")
    )
    enclosed = spatial.polygon_rasterize(contours, image, obj).join(
        pixels.select(image, "y", "x", *channels).hint("merge"), [image, "y", "x"]
    )
    sizes, limits = px.image_sizes(pixels, image), px.crop_window_size(windows)
    named = boxes.select(
        image, obj, names.crop_name(names.normalize_image_name(F.col("image_name")), F.col(obj)).alias("crop_name")
    )
    crops = None
    for c in channels:
        own = enclosed.select(image, obj, "y", "x", F.col(c).alias("v"))
        part = px.object_crop(own, windows, sizes, limits, image, obj).withColumn("channel", F.lit(c))
        crops = part if crops is None else crops.unionByName(part)
    return crops.join(named.hint("merge"), [image, obj]).select("channel", "crop_name", "crop_y", "crop_x", "v")


def labelled_cells(cytoplasms: DataFrame, nuclei: DataFrame, votes: DataFrame) -> DataFrame:
    """Shapes, parent join, annotator consensus and class.

    Both object tables feed the containment test and the linked row, so their shape
    features are worked out once and written to the shared folder.
    """
    cells = rel.min_area_filter(cut_lineage(geometry.morpho_features(cytoplasms.drop("label"))))
    cores = rel.min_area_filter(cut_lineage(geometry.morpho_features(nuclei)))
    linked = spatial.link_objects(cores, cells, point=("cx_coords", "cy_coords"))
    keyed = linked.withColumnsRenamed(
        {"cyto_image_name": "image_name", "cyto_object_id": "cyto_id"}
    )
    return rel.annotator_join(keyed, votes)


def class_profile(labelled: DataFrame) -> DataFrame:
    """Cells and mean shape features per class."""
    wanted = [f"{p}_{c}" for p in ("cyto", "nuc") for c in SHAPE_COLUMNS]
    return labelled.groupBy("label").agg(
        F.count("*").alias("n_cells"), *[r6(F.avg(c)).alias(c) for c in wanted]
    )


def flagship(spark, sf: str) -> DataFrame:
    return class_profile(
        labelled_cells(
            derived.cytoplasms(spark, sf),
            derived.nuclei(spark, sf),
            derived.votes(spark, sf).drop("vec_id"),
        )
    )


_CENTRE_POINTS = _PARENT_POINTS.replace("px, py, e.*", "q.cx AS px, q.cy AS py, e.*").replace(
    "FROM nuc n", "FROM nuc n JOIN nucl_p q ON q.vec_id = n.nucleus_id"
)


@query(
    "labelled_cells",
    check(
        ["nuc", "cyto_v", "cyto_e", "cyto_p", "nucl_p", "majority"],
        f"""SELECT p.nucleus_id, m.image_name, m.cyto_id,
        CAST(CASE WHEN maj_xgal + maj_sstatus = 1 AND maj_sstatus = 1 THEN 3
        ELSE maj_xgal + maj_sstatus END AS BIGINT) AS label, {sq('c.area')} AS cyto_area,
        {sq('c.area / b.box')} AS cyto_area_box, {sq('f.major / f.minor')} AS cyto_aspect,
        {sq('q.area')} AS nuc_area
        FROM parents p JOIN majority m ON m.vec_id = p.parent
        JOIN cyto_p c ON c.vec_id = p.parent JOIN nucl_p q ON q.vec_id = p.nucleus_id
        JOIN boxes b ON b.vec_id = p.parent JOIN fitted f ON f.vec_id = p.parent""",
        ("sides", _side("cyto_e", _CENTRE_POINTS)),
        ("parents", _PARENTS),
        *_ELLIPSE,
        ("hull", _HULL),
        ("boxes", _BOXES),
    ),
)
def _(spark, sf):
    cells = labelled_cells(
        derived.cytoplasms(spark, sf),
        derived.nuclei(spark, sf),
        derived.votes(spark, sf).drop("vec_id"),
    )
    return cells.select(
        F.col("nuc_nucleus_id").alias("nucleus_id"),
        "image_name",
        "cyto_id",
        "label",
        r6("cyto_area").alias("cyto_area"),
        r6("cyto_area_box").alias("cyto_area_box"),
        r6("cyto_aspect").alias("cyto_aspect"),
        r6("nuc_area").alias("nuc_area"),
    )


_RAW_SHAPE = f"""SELECT p.vec_id, area, area / box AS area_box, radius_ratio, major / minor AS aspect,
    {_ECCENTRICITY} AS eccentricity, perimeter * perimeter / (4.0 * pi() * area) AS roundness, {_INDEX} AS ii
    FROM cyto_p p JOIN boxes b ON p.vec_id = b.vec_id
    JOIN fitted f ON f.vec_id = p.vec_id JOIN radii r ON r.vec_id = p.vec_id"""


def _shape_parts(tag: str, rings: str, sums: str) -> list[tuple[str, str]]:
    """The named parts behind the shape features of any ring view."""
    parts = [*_ELLIPSE, ("hull", _HULL), ("boxes", _BOXES), ("radii", _RADII), ("shape", _RAW_SHAPE)]
    names = {n: f"{tag}_{n}" for n, _ in parts} | {"cyto_v": rings, "cyto_p": sums}
    known = re.compile(r"\b(" + "|".join(names) + r")\b(?! AS )")
    return [(names[n], known.sub(lambda m: names[m[1]], text)) for n, text in parts]


query(
    "class_profile",
    check(
        ["nuc", "nuc_v", "cyto_v", "cyto_e", "cyto_p", "nucl_p", "majority"],
        "SELECT label, count(*) AS n_cells, "
        + ", ".join(
            f"{sq(f'avg({t}.{c})')} AS {name}_{c}"
            for t, name in (("c", "cyto"), ("n", "nuc"))
            for c in SHAPE_COLUMNS
        )
        + """ FROM (SELECT p.parent, p.nucleus_id,
        CAST(CASE WHEN maj_xgal + maj_sstatus = 1 AND maj_sstatus = 1 THEN 3
        ELSE maj_xgal + maj_sstatus END AS BIGINT) AS label
        FROM parents p JOIN majority m ON m.vec_id = p.parent) l
        JOIN c_shape c ON c.vec_id = l.parent JOIN n_shape n ON n.vec_id = l.nucleus_id GROUP BY label""",
        ("sides", _side("cyto_e", _CENTRE_POINTS)),
        ("parents", _PARENTS),
        *_shape_parts("c", "cyto_v", "cyto_p"),
        *_shape_parts("n", "nuc_v", "nucl_p"),
    ),
)(flagship)


@query("objects_table")
def _(spark, sf):
    """The full object table of the pixel images, contour left out of the output."""
    table = objects_table(derived.pixels(spark, sf), derived.disk_contours(spark, sf))
    return table.drop("contour")
