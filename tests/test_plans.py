"""What the plans are made of: shuffles, columns read, Python."""

from __future__ import annotations

import re

import pytest

from pixelframe.queries import queries

SF = "/root/testdata/sf0.001"


def plan(spark, name: str) -> str:
    return queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, shuffles", [("pixels_grey", 0), ("crop", 0), ("flip_both", 0), ("rotate90_90", 0), ("exif_orientation_5", 0), ("premultiply", 0), ("resize_nearest_up", 0), ("rgb_to_ycbcr", 0), ("palette_nearest", 0), ("palette_lookup", 0), ("sniff", 0), ("probe_png", 0), ("size_guard", 0), ("option_whitelist", 0), ("dct_block_size", 0), ("rotate_nearest", 1), ("rotate_bilinear", 1), ("gif_histogram", 1), ("has_alpha", 1), ("resize_bilinear_up", 2), ("resize_lanczos3_down", 2), ("fit_cover", 2), ("fit_contain", 3)])
def test_shuffles(spark, name, shuffles):
    text = plan(spark, name)
    assert len(re.findall(r"\bExchange\b", text)) == shuffles
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|SortMergeJoin", text)


def test_columns_read(spark):
    assert re.search(r"ReadSchema: struct<vec_id:bigint,embedding:array<float>>", plan(spark, "crop"))
    assert re.search(r"ReadSchema: struct<p_partkey:bigint>", plan(spark, "sniff"))


def test_only_headers_leave_the_table(spark, tmp_path):
    from pixelframe.sources import images

    (tmp_path / "a.png").write_bytes(b"x")
    text = images.read_images(spark, str(tmp_path)).select("path", "length")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ReadSchema: struct<path:string,length:bigint>", text)


def test_one_python_stage(spark):
    """A recipe reads, works and writes in one pass between the JVM and Python."""
    from pixelframe.sources import images

    files = images.from_bytes(spark, [b""])
    text = images.run(files, {"crop": {"x": 0, "y": 0, "width": 1, "height": 1}, "rotate": {"angle": 5}, "format": {"format": "png"}})._jdf.queryExecution().executedPlan().toString()
    assert text.count("MapInArrow") == 1 and "Exchange" not in text
