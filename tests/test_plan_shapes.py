"""The physical plans that the design promises."""

import pytest

from pixelmill.operators import analysis, pixels, resample
from pixelmill.plans import queries
from pixelmill.plans.fixtures import doc_pixels, emb_pixels
from pixelmill.plans.storage import bucketed
from pixelmill.sources import files

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return plan(df).count("Exchange hashpartitioning")


def test_row_local_operators_do_not_shuffle(spark):
    px = emb_pixels(spark, FOLDER)
    for df in (pixels.to_rgb8(px), pixels.to_gray8(px), pixels.remove_color(px, "#808080", 9)):
        assert "Exchange" not in plan(df) and "Python" not in plan(df)


def test_pixels_of_an_image_meet_without_moving_again(spark):
    px = doc_pixels(spark, FOLDER)
    for df in (analysis.palette_count(px), analysis.flatness(px), analysis.image_profile(px)):
        assert exchanges(df) == 1 and "REPARTITION_BY_COL" in plan(df)


def test_resizing_makes_no_grid(spark):
    images, px = queries.both(spark, FOLDER)
    spread = resample.resize_nearest(images, px, 19, 5)[1]
    assert exchanges(spread) == 0 and "BroadcastHashJoin" in plan(spread)


def test_listings_read_no_content(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"x")
    (tmp_path / "v.mp4").write_bytes(b"x")
    text = plan(files.scan_media(spark, f"file://{tmp_path}"))
    assert "content" not in text.split("ReadSchema")[-1] and "length" in text


@pytest.mark.parametrize("name", ["x_arithmetic", "l_fold", "a_palette_count"])
def test_scans_are_pruned(spark, name):
    schema = plan(queries.QUERIES[name](spark, FOLDER)).split("ReadSchema: ")[-1]
    assert {"x_arithmetic": "l_extendedprice", "l_fold": "o_orderpriority", "a_palette_count": "n_chars"}[name] not in schema


def test_bucketed_tables_join_without_moving(spark):
    images, px = queries.both(spark, FOLDER)
    kept_images, kept = bucketed(images, "bucketed_images", 4), bucketed(px, "bucketed_pixels", 4)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = pixels.flip_rotate(kept_images, kept, rotate=90)[1]
        assert "SortMergeJoin" in plan(moved) and "Exchange" not in plan(moved) and moved.count() == px.count()
        assert "Exchange" in plan(pixels.flip_rotate(images, px, rotate=90)[1])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        for name in ("bucketed_images", "bucketed_pixels"):
            spark.sql(f"DROP TABLE {name}")
