"""Names: image names, crop names, labels and column aliases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Feature columns, label names and column aliases of the data set.
SHAPE_COLUMNS = ["area", "area_box", "radius_ratio", "aspect", "eccentricity", "roundness", "ii"]
CYTO_FEATURES = [f"cyto_{c}" for c in SHAPE_COLUMNS]
NUC_FEATURES = [f"nuc_{c}" for c in SHAPE_COLUMNS]
BASE_FEATURES = CYTO_FEATURES + NUC_FEATURES
CIRCULARITY_FEATURES = ["cyto_circularity", "nuc_circularity"]
CHANNELS = ["grayscale", "red", "green", "blue"]
CHANNEL_WORDS = ["green", "red", "phase"]
LABEL_TITLES = {0: "Normal", 1: "Quiescent", 2: "Fully Senescent", 3: "Senescent-like"}
LABEL_FOLDERS = {0: "normal", 1: "quiescent", 2: "fully_senescent", 3: "senescent_like"}
COLUMN_ALIASES = {
    "cyto_image": "cyto_image_name",
    "cyto_id": "cyto_index",
    "cyto_cx": "cyto_cx_coords",
    "cyto_cy": "cyto_cy_coords",
    "cyto_arbox": "cyto_area_box",
    "cyto_radra": "cyto_radius_ratio",
    "cyto_asp": "cyto_aspect",
    "cyto_ecc": "cyto_eccentricity",
    "cyto_rou": "cyto_roundness",
    "cyto_circ": "cyto_circularity",
    "cii": "cyto_ii",
    "nuc_arbox": "nuc_area_box",
    "nuc_radra": "nuc_radius_ratio",
    "nuc_asp": "nuc_aspect",
    "nuc_ecc": "nuc_eccentricity",
    "nuc_rou": "nuc_roundness",
    "nuc_circ": "nuc_circularity",
    "nii": "nuc_ii",
}


def normalize_image_name(name: Column) -> Column:
    """Drop the channel words wherever they stand in the name."""
    return F.regexp_replace(name, "|".join(CHANNEL_WORDS), "")


def derive_channel_name(name: Column, target: str) -> Column:
    """Name of the sibling file of a red-channel image (``green`` or ``joined``)."""
    return F.replace(name, F.lit("red"), F.lit(target))


def crop_name(image_name: Column, object_id: Column) -> Column:
    """``img_<stem>_crop_<id>.<ext>`` from the first two dot parts of the image name."""
    parts = F.split(image_name, r"\.")
    return F.concat(
        F.lit("img_"), parts[0], F.lit("_crop_"), object_id.cast("string"), F.lit("."), parts[1]
    )


def parse_crop_name(name: Column) -> Column:
    """Struct (image_name, object_id) by position of the ``_`` and ``.`` parts."""
    parts = F.split(name, "[_.]")
    return F.struct(
        F.concat(F.get(parts, F.lit(1)), F.lit("."), F.get(parts, F.lit(4))).alias("image_name"),
        F.get(parts, F.lit(3)).try_cast("bigint").alias("object_id"),
    )


def parse_crop_name_robust(name: Column) -> Column:
    """The same by pattern, so that an image stem may hold ``_`` and dots."""
    pattern = r"^img_(.+)_crop_(\d+)\.([^.]+)$"
    return F.when(
        name.rlike(pattern),
        F.struct(
            F.concat(
                F.regexp_extract(name, pattern, 1), F.lit("."), F.regexp_extract(name, pattern, 3)
            ).alias("image_name"),
            F.regexp_extract(name, pattern, 2).try_cast("bigint").alias("object_id"),
        ),
    )


def decode_label(label: Column, names: dict[int, str] | None = None) -> Column:
    pairs = [F.lit(v) for item in (names or LABEL_TITLES).items() for v in item]
    return F.create_map(*pairs)[label.cast("int")]


def phenotype_label(stain: Column, shape: Column) -> Column:
    """(0,0)=0, (1,0)=1, (1,1)=2, (0,1)=3; a missing trait gives a missing label."""
    total = stain + shape
    return F.when((total == 1) & (shape == 1), F.lit(3)).otherwise(total).cast("bigint")


def majority_vote(*votes: Column) -> Column:
    """1 when more than one of the votes is 1; any missing vote gives null."""
    total = sum(votes[1:], votes[0])
    return F.when(total > 1, F.lit(1)).when(total < 2, F.lit(0)).cast("bigint")


def argmax_class(scores: Column) -> Column:
    """0-based position of the first largest score."""
    return F.array_position(scores, F.array_max(scores)) - 1


def circularity(roundness: Column) -> Column:
    return F.try_divide(F.lit(1.0), roundness)
