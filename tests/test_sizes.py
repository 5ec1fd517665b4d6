"""What keeps queries over very many small files in proportion: tasks, workers, and files that are worked on together."""

from __future__ import annotations

import numpy as np
import pytest

from pixelframe import file_queries as files
from pixelframe.errors import ImageError
from pixelframe.queries import queries
from pixelframe.sources import images
from pixelframe.sources.codecs import gif, jpeg, png
from pixelframe.streaming.arrivals import run_arrivals

SF = "/root/testdata/sf0.01"
JPEG = ["jpeg_inks", "jpeg_two_thirds", "jpeg_ycck", "jpeg_restarts", "exif_upright", "jpeg_reduced_2", "jpeg_420", "jpeg_422", "jpeg_scans", "jpeg_444", "jpeg_rgb", "jpeg_fill_and_comments", "jpeg_wave", "jpeg_missing_scan", "jpeg_grey"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [*JPEG, "png_interlaced", "png_filters", "tiff_grey_16_bit", "tiff_palette"])
def test_files_of_a_table_are_spread(spark, name):
    """2,000 rows of one small file: four tasks, and one Python worker in each."""
    df = queries()[name](spark, SF)
    assert plan(df).count("MapInArrow") == 1
    assert df.rdd.getNumPartitions() == 4


@pytest.mark.parametrize("name", ["metadata_stripped", "exif_read", "tiff_refused", "error_rows", "probe_jpeg", "probe_tiff", "codec_load_failed", "sql_functions"])
def test_other_rows_for_python_are_spread(spark, name):
    assert queries()[name](spark, SF).rdd.getNumPartitions() == 4


def kinds() -> list[bytes]:
    """JPEG files of several kinds in turn, with broken ones among them."""
    makes = [files._coloured([(1, 1)] * 4, [0, 1, 2, 3], 8, 8, more=files._segment(0xEE, b"Adobe\0\x64\0\0\0\0\x02")), files._coloured([(3, 1), (2, 1), (2, 1)], [0, 0, 0, 1, 1, 2, 2], 24, 8), files._coloured([(2, 2), (1, 1), (1, 1)], [0, 0, 0, 0, 1, 2], 16, 16), files._coloured([(2, 1), (1, 1), (1, 1)], [0, 0, 1, 2], 13, 8), files._coloured([(1, 1)] * 3, [0, 1, 2], 8, 8, left_out=1), files._exif_file, files._grey_file]
    out = [make(k, k % 50) for k in range(30) for make in makes]
    out[3], out[10], out[20] = b"", b"\xff\xd8\xff", out[20][:-9]
    return out + [files.png(2, 1, 8, 0, b"\0ab"), b"GIF89a"]


@pytest.mark.parametrize("hint", [None, 11, 5, 2])
def test_many_files_give_what_each_gives(hint):
    def alone(content: bytes):
        try:
            return images.decode_bytes(content, hint=hint)
        except ImageError as e:
            return e

    given = kinds()
    for content, got in zip(given, images.decode_many(given, hint=hint), strict=True):
        want = alone(content)
        assert (type(got), str(got)) == (type(want), str(want)) if isinstance(want, ImageError) else np.array_equal(got, want)


def test_small_jpeg_files_are_transformed_together(monkeypatch):
    calls, whole = [], jpeg.inverse
    monkeypatch.setattr(jpeg, "inverse", lambda blocks: calls.append(len(blocks)) or whole(blocks))
    given = [files._coloured([(1, 1)] * 4, [0, 1, 2, 3], 8, 8)(k, 1 + k % 50) for k in range(300)]
    assert all(x.shape == (8, 8, 4) for x in images.decode_many(given))
    assert calls == [300] * 4


def test_steps_with_large_and_failed_rows(spark, monkeypatch):
    """Errors pass through steps in one worker as through steps apart; pictures of any size become pixels in order."""
    rows = images.from_bytes(spark, [images.encode_raster(np.arange(4 * w * h, dtype=np.uint32).astype(np.uint8).reshape(h, w, 4), "png") for w, h in ((3, 2), (300, 700), (1, 1))] + [b"no image", b""])
    together = images.decode(images.run(rows, {"flip": {"horizontal": True}}))
    apart = images.decode(images.run(rows, {"flip": {"horizontal": True}}).select("image_id", "content", "error"))
    assert (plan(together).count("MapInArrow"), plan(apart).count("MapInArrow")) == (1, 2)
    assert sorted(together.collect()) == sorted(apart.collect())
    assert [r.code for r in together.orderBy("image_id").select("error.code").collect()] == [None] * 3 + ["UNSUPPORTED_FORMAT"] * 2
    got = images.to_pixels(together).orderBy("image_id", "y", "x").toPandas()
    assert len(got) == 6 + 210_000 + 1
    large = got[got.image_id == 1][["r", "g", "b", "a"]].to_numpy().reshape(700, 300, 4)
    assert np.array_equal(large, np.arange(840_000, dtype=np.uint32).astype(np.uint8).reshape(700, 300, 4)[:, ::-1])


@pytest.mark.parametrize("shape", [(12, 20), (1, 1), (33, 17)])
def test_many_jpeg_files_are_written_as_each(shape):
    """Noise and flat pictures; the recipe that strips metadata writes files of one size together."""
    noise = np.random.default_rng(4).integers(0, 256, (30, *shape, 4), dtype=np.uint8)
    for given in (noise, np.broadcast_to(noise[:, :1, :1], noise.shape).copy()):
        alone = [jpeg.encode(x, 75) for x in given]
        assert jpeg.encode_many(given, 75) == alone
        assert images.encode_many(list(given), "jpeg", {"quality": 75}) == alone
    assert {e.code for e in images.encode_many(list(noise), "jpeg", {"quality": 0})} == {"INVALID_OPTION"}


def test_recipes_over_many_files_give_what_each_gives(monkeypatch):
    def alone(content: bytes, spec: dict):
        try:
            return images.run_bytes(content, spec)
        except ImageError as e:
            return e.code, str(e)

    given = kinds()
    for spec in ({"stripMetadata": True}, {"crop": {"x": 0, "y": 0, "width": 9, "height": 8}}, {"format": {"format": "jpeg", "options": {"quality": 40}}, "background": [1, 2, 3, 255]}):
        got = list(images.run_many(given, spec))
        assert [(x.code, str(x)) if isinstance(x, ImageError) else x for x in got] == [alone(c, spec) for c in given]
    calls, scans = [], jpeg._coded_many
    monkeypatch.setattr(jpeg, "_coded_many", lambda *a: calls.append(a[2]) or scans(*a))
    assert len(list(images.run_many([files._exif_file(10, s) for s in range(200)], {"stripMetadata": True}))) == 200
    assert calls == [200]


def test_pictures_to_write_are_spread(spark):
    assert queries()["jpeg_written"](spark, SF).rdd.getNumPartitions() == 4


def pngs() -> list[bytes]:
    makes = [files._png_interlaced, files._png_palette, files._png_grey, lambda k, s: files.png(7, 6, 8, 2, files.filtered([bytes(r) for r in files.grid(k, s, (0, 1, 2), 7, 6)], 3, k)), lambda k, s: files.png(5, 3, 16, 6, files.plain([b"".join(bytes([v, 3 * v % 256]) for v in r) for r in files.grid(k, s, (0, 1, 2, 3))]))]
    out = [make(k, k % 50) for k in range(40) for make in makes]
    out[5], out[11] = out[5][:-20], files.png(1, 2, 8, 0, b"\0a\x05b")
    return [*out, files.png(5, 3, 4, 3, bytes([0, 0x99, 0x99, 0x90]) * 3, more=b"\0\0\0\x03PLTEabc"), files.png(1, 2, 8, 0, b"\0a\0b")]


def test_many_png_files_give_what_each_gives(monkeypatch):
    def alone(content: bytes):
        try:
            return images.decode_bytes(content)
        except ImageError as e:
            return e

    given = pngs()
    want = [alone(c) for c in given]
    assert sum(isinstance(w, ImageError) for w in want) == 3
    for got, w in zip(images.decode_many(given), want, strict=True):
        assert (type(got), str(got)) == (type(w), str(w)) if isinstance(w, ImageError) else np.array_equal(got, w)
    calls, undone = [], png._diagonally
    monkeypatch.setattr(png, "_diagonally", lambda kinds, lines: calls.append(len(lines)) or undone(kinds, lines))
    assert len(list(images.decode_many([files._png_interlaced(k, 3) for k in range(300)]))) == 300
    assert calls == [300] * 7


@pytest.mark.parametrize("name", ["codec_bmp", "codec_tiff", "gif_dithered", "chain_to_buffer", "pipeline_object"])
def test_pictures_of_vectors_stay_in_one_worker(spark, name):
    """Writing, a recipe, reading and pixels of 500 pictures or more are one Python worker a task, and are spread."""
    df = queries()[name](spark, "/root/testdata/sf0.1")
    assert plan(df).count("MapInArrow") == 1
    assert df.rdd.getNumPartitions() == 4


def test_small_pictures_are_dithered_without_a_table_of_all_colours():
    assert gif._Places(np.zeros((2, 3), np.int64), 8).known is None
    noise = np.random.default_rng(5).integers(0, 256, (6, 9, 4), dtype=np.uint8)
    noise[..., 3] = 255
    want = gif.encode(noise, 8, True)
    before, gif.DISTANCES = gif.DISTANCES, 0
    try:
        assert gif.encode(noise, 8, True) == want
    finally:
        gif.DISTANCES = before


def test_arrived_files_are_read_many_to_a_task(spark, tmp_path):
    """3,000 files in one batch, looked up and read in a few tasks; the session keeps its settings and stays the active one."""
    for folder in ("in", "out"):
        (tmp_path / folder).mkdir()
    for k in range(3000):
        (tmp_path / "in" / f"{k}.png").write_bytes(files.png(2, 1, 8, 0, bytes([0, k % 256, k // 256])))
    names = ("spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.files.openCostInBytes", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(n, None) for n in names]
    query = run_arrivals(spark, str(tmp_path / "in"), {"flip": {"horizontal": True}}, str(tmp_path / "out/rows"), str(tmp_path / "out/log"))
    query.awaitTermination()
    assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [3000]
    assert len(list((tmp_path / "out/rows").glob("*.parquet"))) <= 3 * spark.sparkContext.defaultParallelism
    assert [spark.conf.get(n, None) for n in names] == before
    assert spark.getActiveSession()._jsparkSession.equals(spark._jsparkSession)
    rows = {int(r.path.rsplit("/", 1)[1][:-4]): bytes(r.content) for r in spark.read.parquet(str(tmp_path / "out/rows")).collect()}
    assert len(rows) == 3000 and all(png.decode(c)[0, :, 0].tolist() == [k // 256, k % 256] for k, c in rows.items())
