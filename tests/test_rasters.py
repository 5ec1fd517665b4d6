"""Operators on rasters: identities, sizes, limits, and agreement with the pixel layout on sizes the queries don't have."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from pixelframe.errors import ImageError, ImageTooLarge, InvalidOption
from pixelframe.operators import rasters as R
from pixelframe.operators.pixels import Pixels
from pixelframe.plans import geometry as G
from pixelframe.sources import images


def noise(w: int, h: int, seed: int = 0, opaque: bool = False) -> np.ndarray:
    out = np.random.default_rng(seed).integers(0, 256, (h, w, 4)).astype(np.uint8)
    if opaque:
        out[..., 3] = 255
    return out


def test_identities():
    a = noise(7, 5)
    for options in ({"horizontal": True}, {"vertical": True}, {"horizontal": True, "vertical": True}):
        assert (R.flip(R.flip(a, **options), **options) == a).all()
    turned = a
    for _ in range(4):
        turned = R.rotate90(turned, 90)
    assert (turned == a).all()
    assert (R.flip(a, True, True) == R.rotate90(a, 180)).all()
    assert (R.rotate90(a, 450) == R.rotate90(a, 90)).all() and (R.rotate90(a, -270) == R.rotate90(a, 90)).all()
    assert (R.rotate(a, 90) == R.rotate90(a, 90)).all()
    assert R.rotate90(a, 90)[0, -1].tolist() == a[0, 0].tolist()
    assert R.max_long_edge(a, 7) is a and (R.resize(a, 7, 5) == a).all()


def test_crop_stays_inside():
    a = noise(6, 4)
    assert (R.crop(a, 2, 1, 3, 2) == a[1:3, 2:5]).all()
    for bad in ((5, 0, 2, 1), (0, 4, 1, 1), (-1, 0, 1, 1), (0, 0, 0, 1), (0.5, 0, 1, 1)):
        with pytest.raises(InvalidOption):
            R.crop(a, *bad)


def test_sizes():
    a = noise(40, 30)
    assert R.resize(a, width=20).shape[:2] == (15, 20)
    assert R.resize(a, height=1).shape[:2] == (1, 1)
    assert R.resize(a, 50, 20, upscale=False).shape[:2] == (30, 40)
    assert R.resize(a, 20, 20, fit="contain").shape[:2] == (20, 20) == R.resize(a, 20, 20, fit="cover").shape[:2]
    assert R.max_long_edge(a, 4).shape[:2] == (3, 4)
    for bad in (dict(), dict(width=0), dict(width=20001), dict(width=1.5), dict(width=3, resampling="cubic")):
        with pytest.raises(InvalidOption):
            R.resize(a, **bad)


@pytest.mark.parametrize("kernel", G.KERNELS)
def test_flat_colours_stay_flat(kernel):
    flat = R.create(9, 6, (10, 20, 30, 255))
    for w, h in ((4, 3), (20, 17), (1, 1)):
        assert (R.resample(flat, w, h, kernel) == [10, 20, 30, 255]).all()
    turned = R.rotate(flat, 20, kernel, (1, 2, 3, 4))
    assert turned[0, 0].tolist() == [1, 2, 3, 4] and turned[len(turned) // 2, turned.shape[1] // 2].tolist() == [10, 20, 30, 255]


def test_taps_add_up():
    for n, out, kernel in itertools.product((1, 2, 7, 50), (1, 3, 8, 51), ("bilinear", "lanczos3")):
        for taps in G.taps(n, out, kernel):
            assert abs(sum(w for _, w in taps) - 1) < 1e-9 and [i for i, _ in taps] == sorted({i for i, _ in taps}) and 0 <= taps[0][0] <= taps[-1][0] < n


def test_rotation_guard():
    with pytest.raises(ImageTooLarge) as e:
        R.rotate(noise(10, 10), 45, max_pixels=200)
    assert e.value.pixels == 225 and e.value.limit == 200
    for angle in (float("nan"), float("inf"), "5", True):
        with pytest.raises(InvalidOption):
            R.rotate(noise(2, 2), angle)


def test_alpha():
    a = noise(5, 5)
    a[0, 0] = (200, 100, 50, 0)
    assert (R.premultiply(a)[..., :3] <= a[..., 3:]).all()
    assert R.unpremultiply(R.premultiply(a))[0, 0].tolist() == [0, 0, 0, 0]
    assert R.has_alpha(a) and not R.has_alpha(noise(3, 3, opaque=True))
    with pytest.raises(ImageError):
        R.from_bytes(2, 2, b"123")


def test_orientations():
    a = noise(3, 2)
    want = {1: a, 2: a[:, ::-1], 3: a[::-1, ::-1], 4: a[::-1], 5: a.swapaxes(0, 1), 6: np.rot90(a, -1), 7: a[::-1, ::-1].swapaxes(0, 1), 8: np.rot90(a), 9: a}
    for k, image in want.items():
        assert (R.oriented(a, k) == image).all(), k


@pytest.mark.parametrize("step", [lambda p: p.crop(1, 2, 4, 3), lambda p: p.rotate90(270), lambda p: p.flip(vertical=True), lambda p: p.resize(4, 9), lambda p: p.resize(11, 2, resampling="lanczos3"), lambda p: p.resize(3, 8, resampling="nearest"), lambda p: p.resize(12, 12, fit="contain", background=(5, 6, 7, 8)), lambda p: p.resize(3, 8, fit="cover"), lambda p: p.max_long_edge(4), lambda p: p.rotate(-33), lambda p: p.rotate(10, "nearest", (9, 9, 9, 9)), lambda p: p.premultiply().unpremultiply()])
def test_layouts_agree(spark, step):
    class Packed:
        def __init__(self, a):
            self.a = a

        def __getattr__(self, name):
            return lambda *args, **options: Packed(getattr(R, name)(self.a, *args, **options))

    pictures = [noise(7, 6, seed, opaque=seed == 1) for seed in range(3)]
    rows = [(i, y, x, *map(int, a[y, x])) for i, a in enumerate(pictures) for y in range(6) for x in range(7)]
    out = step(Pixels(spark.createDataFrame(rows, "image_id int, y int, x int, r int, g int, b int, a int"), 7, 6))
    got = {(r.image_id, r.y, r.x): (r.r, r.g, r.b, r.a) for r in out.df.collect()}
    for i, a in enumerate(pictures):
        want = step(Packed(a)).a
        assert want.shape == (out.height, out.width, 4)
        assert all(got[i, y, x] == tuple(want[y, x].tolist()) for y in range(out.height) for x in range(out.width))
    assert len(got) == 3 * out.width * out.height


def test_pixels_and_rasters(spark):
    a = noise(5, 4)
    df = spark.createDataFrame([(1, (5, 4, bytearray(a.tobytes())))], "image_id int, image struct<width:int,height:int,data:binary>")
    back = images.from_pixels(images.to_pixels(df)).collect()
    assert [(r.image.width, r.image.height, bytes(r.image.data)) for r in back] == [(5, 4, a.tobytes())]
    missing = images.to_pixels(df).where("x <> 2 or y <> 1")
    assert images.from_pixels(missing).collect()[0].image is None
