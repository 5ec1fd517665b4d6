"""The names of the engine in one place, and its SQL functions."""

from __future__ import annotations

import numpy as np
import pytest

from pixelframe import api
from pixelframe.functions import udfs
from pixelframe.sources import images

A = np.random.default_rng(3).integers(0, 256, (4, 5, 4)).astype(np.uint8)
PNG = api.encode_png(A)


def test_chains(tmp_path, spark):
    chain = api.from_buffer(PNG).flip(horizontal=True).crop(0, 0, 3, 2).to_format("tiff")
    assert (api.decode(chain.to_buffer()) == A[:2, :3][:, ::-1]).all()  # the crop comes first
    (tmp_path / "in.png").write_bytes(PNG)
    api.from_file(str(tmp_path / "in.png")).rotate(90).to_file(str(tmp_path / "out.png"))
    assert api.probe((tmp_path / "out.png").read_bytes()) == (4, 5)
    with pytest.raises(FileNotFoundError):
        api.from_file(str(tmp_path / "none"))
    pipeline = api.Pipeline(chain.to_json())
    assert pipeline.run(PNG) == chain.to_buffer() and pipeline.spec == chain.spec
    files = images.from_bytes(spark, [PNG, b""])
    for done in (pipeline.run_table(files), api.from_table(files).flip(horizontal=True).crop(0, 0, 3, 2).to_format("tiff").to_table()):
        rows = done.orderBy("image_id").collect()
        assert bytes(rows[0].content) == chain.to_buffer() and rows[1].error.code == "UNSUPPORTED_FORMAT"
    with pytest.raises(api.InvalidOption):
        api.Pipeline('{"version": 3}')


def test_encode_refuses():
    for bad in (np.zeros((2, 2, 3), np.uint8), np.zeros((0, 2, 4), np.uint8)):
        with pytest.raises(api.ImageError) as e:
            api.encode(bad, "png")
        assert e.value.code == "ENCODE_FAILED"
    with pytest.raises(api.ImageError) as e:
        api.encode(A, "heic")
    assert e.value.code == "UNSUPPORTED_FORMAT"
    copied = api.copy_image(A)
    copied[0] = 0
    assert A[0].any()


def test_sql(spark):
    udfs.register(spark)
    images.from_bytes(spark, [PNG, b"x", b""]).createOrReplaceTempView("files")
    rows = spark.sql("""SELECT image_id, image_format(content) f, image_probe(content) p, image_run(content, '{"resize":{"width":2}}') c, image_error(content, '{"crop":{}}') e FROM files ORDER BY image_id""").collect()
    assert [r.f for r in rows] == ["png", None, None] and (rows[0].p.width, rows[0].p.height) == (5, 4) and rows[1].p.width is None
    assert api.probe(bytes(rows[0].c)) == (2, 2) and rows[1].c is None
    assert rows[0].e == "INVALID_OPTION: pipeline.crop.x must be a number, got undefined"
    pixels = spark.sql("SELECT image_id, t.* FROM files, LATERAL image_pixels(content) t").collect()
    assert len(pixels) == 20 and all((r.r, r.g, r.b, r.a) == tuple(A[r.y, r.x].tolist()) for r in pixels)
