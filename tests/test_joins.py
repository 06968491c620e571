"""Tables of pixels are never broadcast, whatever Spark estimates their size to be."""

import pytest

from cellmetry.plans import images, models  # noqa: F401
from cellmetry.plans.registry import QUERIES
from conftest import SF


def executed(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    [
        "crop_chain",
        "scored_pairs",
        "greedy_match",
        "segmentation_metrics",
        "segmentation_summary",
    ],
)
def test_masks_are_merged(spark, name):
    assert "BroadcastHashJoin" not in executed(QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", ["minmax_image", "zscore_rescale", "enhancement_chain"])
def test_pixels_are_the_outer_side(spark, name):
    joins = [l for l in executed(QUERIES[name](spark, SF)).splitlines() if "BroadcastHashJoin" in l]
    assert all("LeftOuter, BuildRight" in l for l in joins)


@pytest.mark.parametrize("name", ["contour_areas", "outline_features"])
def test_outlines_are_merged(spark, name):
    joins = [l for l in executed(QUERIES[name](spark, SF)).splitlines() if "BroadcastHashJoin" in l]
    assert not [l for l in joins if "Inner" in l]
