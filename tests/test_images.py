"""Tables of files: errors by row, recipes, sinks and streams."""

from __future__ import annotations

import numpy as np
import pytest

from pixelframe.errors import InvalidOption
from pixelframe.sources import images
from pixelframe.sources.codecs import bmp, jpeg, png
from pixelframe.streaming.arrivals import run_arrivals

A = np.random.default_rng(0).integers(0, 256, (6, 9, 4)).astype(np.uint8)
GOOD = png.encode(A)
CONTENTS = [GOOD, b"", b"hello", GOOD[:40], jpeg.encode(A), bmp.encode(A)]


def test_one_bad_file_fails_alone(spark):
    rows = images.run(images.from_bytes(spark, CONTENTS), {"crop": {"x": 1, "y": 1, "width": 4, "height": 3}}).orderBy("image_id").collect()
    assert [r.error and r.error.code for r in rows] == [None, "UNSUPPORTED_FORMAT", "UNSUPPORTED_FORMAT", "CORRUPT_IMAGE", None, None]
    assert (png.decode(bytes(rows[0].content)) == A[1:4, 1:5]).all()
    assert rows[1].error.message == "Not an image: the file is empty." and rows[2].error.detected_magic == "68 65 6c 6c 6f"
    assert bytes(rows[4].content[:2]) == b"\xff\xd8" and bytes(rows[5].content[:2]) == b"BM"
    with pytest.raises(Exception, match="UnsupportedFormat|CorruptImage"):
        images.run(images.from_bytes(spark, CONTENTS), {}, strict=True).collect()


def test_probe_and_decode(spark):
    rows = images.probe(images.from_bytes(spark, CONTENTS)).orderBy("image_id").collect()
    assert [(r.format, r.width, r.height) for r in rows] == [("png", 9, 6), (None,) * 3, (None,) * 3, ("png", 9, 6), ("jpeg", 9, 6), ("bmp", 9, 6)]
    rows = images.decode(images.from_bytes(spark, CONTENTS), format="png", max_pixels=54).orderBy("image_id").collect()
    assert bytes(rows[0].image.data) == A.tobytes() and [r.error and r.error.code for r in rows][1:3] == ["FORMAT_MISMATCH"] * 2
    (row,) = images.decode(images.from_bytes(spark, [GOOD]), max_pixels=53).collect()
    assert row.image is None and (row.error.pixels, row.error.limit) == (54, 53)
    again = images.encode(images.transform(images.decode(images.from_bytes(spark, [GOOD, b"x"])), {"flip": {"horizontal": True}}), "tiff").orderBy("image_id").collect()
    assert again[1].error.code == "UNSUPPORTED_FORMAT" and images.decode_bytes(bytes(again[0].content)).tobytes() == A[:, ::-1].tobytes()


def test_checks_before_any_job(spark):
    files = images.from_bytes(spark, [GOOD])
    for bad in (lambda: images.encode(files, "png", quality=3), lambda: images.run(files, {"blur": 1}), lambda: images.decode(files, hint=0), lambda: images.run(files, '{"version":2}')):
        with pytest.raises(InvalidOption):
            bad()
    (row,) = images.run(files, {"format": {"format": "png", "options": {"quality": 80}}}).collect()
    assert row.error.option == "encode.quality"


def test_background(spark):
    clear = png.encode(np.zeros((1, 1, 4), np.uint8))
    spec = {"background": [7, 8, 9, 255], "format": {"format": "bmp", "options": {}}}
    (row,) = images.run(images.from_bytes(spark, [clear]), spec).collect()
    assert bmp.decode(bytes(row.content))[0, 0].tolist() == [7, 8, 9, 255]


def test_files_in_and_out(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    (source / "deep").mkdir(parents=True)
    (source / "a.png").write_bytes(GOOD)
    (source / "deep" / "b.bin").write_bytes(jpeg.encode(A))
    (source / "c.png").write_bytes(b"not one")
    files = images.read_images(spark, str(source))
    assert files.select("path", "length").count() == 3
    done = images.run(files, {"resize": {"maxLongEdge": 3}, "format": {"format": "png"}}).selectExpr("*", "concat(element_at(split(path, '/'), -1), '.png') AS name")
    for _ in range(2):  # again, as after a lost executor
        images.write_images(done, f"file://{out}", "name")
    assert sorted(p.name for p in out.iterdir()) == ["a.png.png", "b.bin.png"]
    assert png.probe((out / "a.png.png").read_bytes()) == (3, 2)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        images.read_images(spark, str(tmp_path / "nowhere")).count()


def test_stream(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    (tmp_path / "in").mkdir()
    for n in range(2):
        (tmp_path / "in" / f"{n}.png").write_bytes(GOOD if n else b"junk")
        run_arrivals(spark, source, {"rotate": {"angle": 90}}, out, checkpoint).awaitTermination()
    rows = spark.read.parquet(out).orderBy("path").collect()
    assert [r.error is None for r in rows] == [False, True] and png.probe(bytes(rows[1].content)) == (6, 9)


def test_empty_table(spark):
    none = images.from_bytes(spark, [GOOD]).limit(0)
    assert images.run(none, {}).count() == 0 and images.probe(none).count() == 0 and images.to_pixels(images.decode(none)).count() == 0


def test_session_settings_stay(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    files = images.from_bytes(spark, [b"BM"] * 40)
    plans = [images.run(files, {}), images.decode(files), images.probe(files), images.check_specs(files.selectExpr("'{}' AS spec"))]
    assert spark.conf.get(name) == before
    assert [p.count() for p in plans] == [40] * 4 and spark.conf.get(name) == before
