"""Codecs against the JVM's own, byte for byte, against files put together by hand, and against hostile ones."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from pixelframe.errors import CorruptImage, ImageError, ImageTooLarge, InvalidOption, UnsupportedFormat
from pixelframe.sources.codecs import bmp, codec, gif, jpeg, png, sniff, tiff, vp8l, webp
from pixelframe.sources.images import decode_bytes

Y, X = np.mgrid[0:21, 0:27]
OPAQUE = np.stack([X * 9, Y * 12, (X // 4 + Y // 3) % 2 * 150 + 40, np.full(X.shape, 255)], -1).astype(np.uint8)
CLEAR = OPAQUE.copy()
CLEAR[..., 3] = X * 9
NOISE = np.random.default_rng(4).integers(0, 256, (40, 33, 4)).astype(np.uint8)


@pytest.fixture(scope="module")
def jvm(spark):
    java = spark._jvm

    class Jvm:
        def read(self, content):
            image = java.javax.imageio.ImageIO.read(java.java.io.ByteArrayInputStream(bytearray(content)))
            raw = np.array([[image.getRGB(x, y) for x in range(image.getWidth())] for y in range(image.getHeight())], np.int64)
            return np.stack([raw >> s & 255 for s in (16, 8, 0, 24)], -1).astype(np.uint8)

        def write(self, a, format):
            image = java.java.awt.image.BufferedImage(a.shape[1], a.shape[0], 2 if format in ("png", "tiff") else 1)
            for y in range(a.shape[0]):
                for x in range(a.shape[1]):
                    r, g, b, alpha = map(int, a[y, x])
                    image.setRGB(x, y, struct.unpack("<i", bytes((b, g, r, alpha)))[0])
            out = java.java.io.ByteArrayOutputStream()
            assert java.javax.imageio.ImageIO.write(image, format, out)
            return bytes(out.toByteArray())

    return Jvm()


@pytest.mark.parametrize("name, image", [("png", CLEAR), ("png", OPAQUE), ("bmp", OPAQUE), ("tiff", CLEAR), ("gif", OPAQUE), ("jpeg", OPAQUE)])
def test_against_the_jvm(jvm, name, image):
    theirs = jvm.write(image, name)
    assert sniff(theirs) == name and codec(name).probe(theirs) == (27, 21)
    assert (codec(name).decode(theirs) == jvm.read(theirs)).all()
    ours = codec(name).encode(image)
    assert (codec(name).decode(ours) == jvm.read(ours)).all()


@pytest.mark.parametrize("w, h", [(1, 1), (2, 3), (17, 13), (33, 40)])
def test_lossless(w, h):
    a = NOISE[:h, :w]
    assert (png.decode(png.encode(a)) == a).all()
    for compression in ("lzw", "none"):
        assert (tiff.decode(tiff.encode(a, compression)) == a).all()
    solid = a.copy()
    solid[..., 3] = 255
    assert (bmp.decode(bmp.encode(solid)) == solid).all() and (tiff.decode(tiff.encode(solid)) == solid).all()


def test_long_lzw_runs():
    a = np.random.default_rng(1).integers(0, 256, (150, 200, 4)).astype(np.uint8)
    assert (tiff.decode(tiff.encode(a)) == a).all()
    palette = a[0, :200].copy()
    palette[:, 3] = 255
    b = palette[np.random.default_rng(2).integers(0, 200, (150, 200))]
    assert (gif.decode(gif.encode(b)) == b).all()


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def build_png(w: int, h: int, depth: int, colour: int, lines: bytes, extra: bytes = b"", interlace: int = 0) -> bytes:
    packed = zlib.compress(lines)
    return png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, interlace)) + extra + chunk(b"IDAT", packed[:3]) + chunk(b"IDAT", packed[3:]) + chunk(b"IEND", b"")


def test_png_kinds():
    assert png.decode(build_png(3, 1, 1, 0, b"\0\xa0"))[0, :, 0].tolist() == [255, 0, 255]
    assert png.decode(build_png(3, 1, 2, 0, b"\0\x1b"))[0, :, 0].tolist() == [0, 85, 170]
    assert png.decode(build_png(2, 1, 16, 0, b"\0\x12\xff\xfe\x01"))[0, :, 0].tolist() == [0x12, 0xFE]
    assert png.decode(build_png(1, 1, 8, 4, b"\0\x07\x09"))[0, 0].tolist() == [7, 7, 7, 9]
    palette = chunk(b"PLTE", bytes(range(9))) + chunk(b"tRNS", b"\x10")
    assert png.decode(build_png(3, 1, 4, 3, b"\0\x01\x20", palette))[0].tolist() == [[0, 1, 2, 16], [3, 4, 5, 255], [6, 7, 8, 255]]
    grey_with_key = build_png(1, 1, 8, 0, b"\0\x05", chunk(b"tRNS", b"\0\x05"))
    assert png.decode(grey_with_key)[0, 0].tolist() == [5, 5, 5, 255]


def test_png_filters_and_interlace():
    a = NOISE[:9, :11]
    lines, before = bytearray(), np.zeros((11, 4), np.int16)
    for y, row in enumerate(a.astype(np.int16)):
        left, corner = np.vstack([np.zeros((1, 4), np.int16), row[:-1]]), np.vstack([np.zeros((1, 4), np.int16), before[:-1]])
        guess = left + before - corner
        pa, pb, pc = abs(guess - left), abs(guess - before), abs(guess - corner)
        paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, before, corner))
        kind = y % 5
        lines += bytes([kind]) + (row - [0 * left, left, before, (left + before) // 2, paeth][kind]).astype(np.uint8).tobytes()
        before = row
    assert (png.decode(build_png(11, 9, 8, 6, bytes(lines))) == a).all()
    passes = b"".join(b"\0" + part.tobytes() for x, y, dx, dy in png.PASSES for part in a[y::dy, x::dx] if part.size)
    assert (png.decode(build_png(11, 9, 8, 6, passes, interlace=1)) == a).all()


def test_png_refuses():
    good = png.encode(NOISE[:4, :4])
    broken = bytearray(good)
    broken[50] ^= 1
    for bad in (bytes(broken), good[:40], good[:20], build_png(2, 1, 8, 3, b"\0\0\0"), build_png(1, 1, 8, 3, b"\0\5", chunk(b"PLTE", b"\0" * 6)), build_png(1, 1, 8, 0, b"\7\0"), build_png(1, 1, 8, 0, b"\0"), build_png(1, 1, 3, 0, b"\0\0"), build_png(0, 1, 8, 0, b"\0\0")):
        with pytest.raises(CorruptImage):
            png.decode(bad)


def test_bmp_kinds():
    head = lambda w, h, bits, kind, more: struct.pack("<2sIHHI", b"BM", 0, 0, 0, 54 + len(more)) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, bits, kind, 0, 0, 0, 0, 0) + more
    four = b"".join(bytes((i, 2 * i, 3 * i, 0)) for i in range(16))
    assert bmp.decode(head(3, 1, 4, 0, four) + b"\x12\x30\0\0")[0, :, :3].tolist() == [[3, 2, 1], [6, 4, 2], [9, 6, 3]]
    masks = struct.pack("<III", 0xF800, 0x7E0, 0x1F)
    assert bmp.decode(head(1, 1, 16, 3, masks) + struct.pack("<HH", 0xF81F, 0))[0, 0].tolist() == [255, 0, 255, 255]
    assert bmp.decode(head(1, 1, 16, 0, b"") + struct.pack("<HH", 0x7C00, 0))[0, 0].tolist() == [255, 0, 0, 255]
    assert bmp.decode(head(1, 1, 32, 0, b"") + bytes((1, 2, 3, 0)))[0, 0].tolist() == [3, 2, 1, 255]
    assert bmp.decode(head(2, 1, 32, 0, b"") + bytes((1, 2, 3, 0, 4, 5, 6, 7)))[0].tolist() == [[3, 2, 1, 0], [6, 5, 4, 7]]
    down = bmp.decode(head(1, -2, 24, 0, b"") + bytes((1, 2, 3, 0, 4, 5, 6, 0)))
    up = bmp.decode(head(1, 2, 24, 0, b"") + bytes((1, 2, 3, 0, 4, 5, 6, 0)))
    assert (down == up[::-1]).all()
    for bad in (head(1, 1, 24, 1, b"") + b"\0" * 4, head(0, 1, 24, 0, b"") + b"\0" * 4, head(9, 9, 24, 0, b""), head(1, 1, 4, 0, b"")):
        with pytest.raises(CorruptImage):
            bmp.decode(bad)
    half = np.array([[[100, 100, 100, 128]]], np.uint8)
    assert bmp.decode(bmp.encode(half))[0, 0, 0] == int(100 * (128 / 255) + 255 * (1 - 128 / 255))


def build_tiff(order: str, fields: list[tuple[int, int, tuple]], data: bytes) -> bytes:
    out, more, after = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", len(fields) + 1), b"", 8 + 2 + 12 * (len(fields) + 1) + 4
    extra = {tag: struct.pack(f"{order}{len(v)}{tiff.TYPES[k]}", *v) for tag, k, v in fields}
    begin = after + sum(len(v) for v in extra.values() if len(v) > 4)
    for tag, kind, v in sorted([*fields, (tiff.OFFSETS, 4, (begin,))]):
        raw = extra.get(tag) or struct.pack(order + "I", begin)
        if len(raw) > 4:
            raw, more = struct.pack(order + "I", after + len(more)), more + raw
        out += struct.pack(order + "HHI", tag, kind, len(v)) + raw.ljust(4, b"\0")
    return out + b"\0" * 4 + more + data


def tiff_fields(w, h, bits, photometric, n=1, compression=1, size=0, **more):
    return [(tiff.WIDTH, 3, (w,)), (tiff.HEIGHT, 3, (h,)), (tiff.BITS, 3, (bits,) * n), (tiff.COMPRESSION, 3, (compression,)), (tiff.PHOTOMETRIC, 3, (photometric,)), (tiff.SAMPLES, 3, (n,)), (tiff.ROWS, 3, (h,)), (tiff.COUNTS, 4, (size,)), *((getattr(tiff, k), 3, v) for k, v in more.items())]


@pytest.mark.parametrize("order", "<>")
def test_tiff_kinds(order):
    one = lambda data, *a, **k: tiff.decode(build_tiff(order, tiff_fields(*a, size=len(data), **k), data))
    assert one(b"\x40", 2, 1, 1, 0)[0, :, 0].tolist() == [255, 0]
    assert one(b"\x0f", 2, 1, 4, 1)[0, :, 0].tolist() == [0, 255]
    assert one(struct.pack(order + "HH", 0x1280, 65535), 2, 1, 16, 1)[0, :, 0].tolist() == [int(0x1280 / 65535 * 255 + 0.5), 255]
    colours = tuple(v * 257 for v in (*range(16), *range(16, 32), *range(32, 48)))
    assert one(b"\x5a", 2, 1, 4, 3, COLOUR_MAP=colours)[0].tolist() == [[5, 21, 37, 255], [10, 26, 42, 255]]
    assert one(bytes((50, 100, 128, 128)), 1, 1, 8, 2, n=4, EXTRA=(1,))[0, 0].tolist() == [100, 199, 255, 128]
    assert one(bytes((50, 100, 128, 128)), 1, 1, 8, 2, n=4, EXTRA=(2,))[0, 0].tolist() == [50, 100, 128, 128]
    assert one(bytes((10, 5, 250, 255, 1, 3)), 2, 1, 8, 2, n=3, PREDICTOR=(2,))[0, :, :3].tolist() == [[10, 5, 250], [9, 6, 253]]
    assert one(b"\xfe\x07\x80\x01\x01\x02", 5, 1, 8, 1, compression=32773)[0, :, 0].tolist() == [7, 7, 7, 1, 2]
    for kind in (2, 7, 8):
        with pytest.raises(UnsupportedFormat):
            one(b"\0", 1, 1, 8, 1, compression=kind)
    with pytest.raises(UnsupportedFormat):
        one(b"\0", 1, 1, 8, 1, TILE_WIDTH=(16,))
    with pytest.raises(CorruptImage):
        one(b"\0", 9, 9, 8, 1)


def test_gif_frames():
    screen = b"GIF89a" + struct.pack("<HHBBB", 5, 4, 0x80, 0, 0) + bytes((1, 2, 3, 4, 5, 6))
    control = bytes((0x21, 0xF9, 4, 1, 0, 0, 1, 0))
    data = gif.pack(bytes((0, 1, 0, 0)), 2)
    frame = lambda flags, h: struct.pack("<BHHHHB", 0x2C, 4, 1, 4 // h, h, flags) + bytes([2, len(data)]) + data + b"\0"
    out = gif.decode(screen + control + frame(0, 2) + b"\x3b")
    assert out.shape == (4, 5, 4) and out[1, 4].tolist() == [1, 2, 3, 255] and out[2, 4].tolist() == [1, 2, 3, 255] and not out[:, :4].any()
    rows = gif.decode(screen + frame(0x40, 4) + b"\x3b")
    assert [rows[y, 4, 0] if y < 4 else None for y in range(1, 4)] == [1, 1, 4]
    for bad in (screen + b"\x3b", screen[:10], screen + b"\x99", screen + frame(0, 2)[:-4], screen + struct.pack("<BHHHHB", 0x2C, 0, 0, 3, 3, 0) + bytes([2, len(data)]) + data + b"\0"):
        with pytest.raises(CorruptImage):
            gif.decode(bad)


def test_gif_quantiser():
    ramp = np.zeros((32, 64, 4), np.uint8)
    ramp[..., :3], ramp[..., 3] = (np.arange(64) * 4)[None, :, None], 255
    few = gif.decode(gif.encode(ramp, 5))
    assert len(np.unique(few.reshape(-1, 4), axis=0)) <= 5
    block = lambda a: a[..., 0].astype(float).reshape(4, 8, 8, 8).mean((1, 3))
    plain = gif.decode(gif.encode(ramp, 5, dither=False))
    assert abs(block(few) - block(ramp)).mean() < 0.5 * abs(block(plain) - block(ramp)).mean()
    for bad in (1, 257, 2.5):
        with pytest.raises(InvalidOption):
            gif.encode(ramp, bad)


def test_jpeg_quality_and_hint(monkeypatch):
    sizes = [len(jpeg.encode(OPAQUE, q)) for q in (20, 50, 82, 95)]
    assert sizes == sorted(sizes)
    content = jpeg.encode(np.kron(OPAQUE[:20, :24], np.ones((8, 8, 1), np.uint8)), 90)
    full = decode_bytes(content)
    calls = []
    monkeypatch.setattr(jpeg, "inverse", lambda b: calls.append(b) or np.zeros(b.shape, np.uint8))
    half = decode_bytes(content, hint=96)
    assert half.shape == (80, 96, 4) and not calls  # the full transform never runs
    assert abs(half.astype(int) - full[::2, ::2].astype(int)).mean() < 12
    decode_bytes(content)
    assert calls  # the detector works
    assert decode_bytes(content, hint=5).shape[1] == 5
    for bad in (0, 101, 3.5):
        with pytest.raises(InvalidOption):
            jpeg.encode(OPAQUE, bad)


def exif(content: bytes, orientation: int, order: str = "<") -> bytes:
    data = b"Exif\0\0" + (b"II" if order == "<" else b"MM") + struct.pack(order + "HIHHHIHH", 42, 8, 1, 0x0112, 3, 1, orientation, 0)
    return content[:2] + struct.pack(">BBH", 255, 0xE1, len(data) + 2) + data + content[2:]


@pytest.mark.parametrize("order", "<>")
def test_exif(order):
    plain = jpeg.encode(OPAQUE, 95)
    for k in range(1, 9):
        got = decode_bytes(exif(plain, k, order))
        assert got.shape[:2] == ((21, 27) if k < 5 else (27, 21))
        assert jpeg.probe(exif(plain, k, order)) == (27, 21)
    assert (decode_bytes(exif(plain, 6, order)) == np.rot90(decode_bytes(plain), -1)).all()
    assert jpeg.orientation(exif(plain, 77, order)) == 1 == jpeg.orientation(b"\xff\xd8\xff")


def test_jpeg_refuses():
    good = jpeg.encode(OPAQUE)
    progressive = good.replace(b"\xff\xc0", b"\xff\xc2", 1)
    assert jpeg.probe(progressive) == (27, 21)
    with pytest.raises(UnsupportedFormat):
        jpeg.decode(progressive)
    for bad in (good[: len(good) // 2], good[:30], b"\xff\xd8\xff\xd9"):
        with pytest.raises(ImageError):
            decode_bytes(bad)


def test_sniff_and_guards():
    assert [sniff(c) for c in (b"", b"\x89PN", b"RIFF\0\0\0\0WAVE", b"RIFF\0\0\0\0WEBP", b"II*\0", b"MM\0*", b"BM", b"GIF87a", b"\xff\xd8\xff")] == [None, None, None, "webp", "tiff", "tiff", "bmp", "gif", "jpeg"]
    a = png.encode(NOISE[:4, :5])
    assert decode_bytes(a, max_pixels=20).shape == (4, 5, 4)
    with pytest.raises(ImageTooLarge):
        decode_bytes(a, max_pixels=19)
    with pytest.raises(ImageError) as e:
        decode_bytes(a, "jpeg")
    assert e.value.code == "FORMAT_MISMATCH"
    bomb = png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 60000, 60000, 8, 6, 0, 0, 0)) + chunk(b"IDAT", b"")
    with pytest.raises(ImageTooLarge):
        decode_bytes(bomb)


@pytest.mark.parametrize("name", ["png", "jpeg", "gif", "bmp", "tiff"])
def test_hostile_bytes(name):
    good = codec(name).encode(OPAQUE)
    rng = np.random.default_rng(7)
    for _ in range(60):
        bad = bytearray(good)
        for at in rng.integers(0, len(bad), 4):
            bad[at] = rng.integers(0, 256)
        try:
            decode_bytes(bytes(bad[: rng.integers(1, len(bad) + 1)]))
        except ImageError as e:
            assert e.code in ("CORRUPT_IMAGE", "UNSUPPORTED_FORMAT", "IMAGE_TOO_LARGE")


def test_webp_without_a_library(monkeypatch):
    from pixelframe import catalog

    monkeypatch.setattr(webp, "BACKENDS", ("no_such_codec",))
    webp._state.clear()
    assert catalog.supported_formats()["pending"] == ["webp"] and "webp" in catalog.supported_formats()["read"]
    content = b"RIFF\0\0\0\0WEBPVP8 " + b"\0" * 7 + b"\x9d\x01\x2a" + struct.pack("<HH", 7, 4) + b"\0" * 8
    assert webp.probe(content) == (7, 4)
    for _ in range(2):
        with pytest.raises(ImageError) as e:
            decode_bytes(content)
        assert e.value.code == "CODEC_LOAD_FAILED"
    assert catalog.supported_formats()["pending"] == [] and "webp" not in catalog.supported_formats()["write"] and catalog.supported_formats()["unavailable"][0]["format"] == "webp"
    webp._state.clear()


def _text(image) -> str:
    """The bits of a picture's lossless chunk, the lowest of each number first."""
    return "".join(_low(v, n) for v, n in vp8l._numbers(image).T.tolist())


def _bytes(text: str) -> bytes:
    return b"".join(bytes([int(text[k : k + 8].ljust(8, "0")[::-1], 2)]) for k in range(0, len(text), 8))


def _low(value: int, n: int) -> str:
    return f"{value:0{n}b}"[::-1] if n else ""


@pytest.mark.parametrize("colours", [1, 2, 3, 40, 256])
def test_webp_lossless(colours):
    rng = np.random.default_rng(colours)
    for h, w in ((1, 1), (3, 7), (20, 33)):
        image = rng.choice(rng.integers(0, 256, colours), (h, w, 4)).astype(np.uint8)
        content = webp.encode(image, lossless=True)
        assert webp.probe(content) == (w, h) and (decode_bytes(content) == image).all()
        extended = b"RIFF" + struct.pack("<I", 0) + b"WEBPVP8X" + struct.pack("<II", 10, 16) + (w - 1).to_bytes(3, "little") + (h - 1).to_bytes(3, "little") + content[12:]
        assert (decode_bytes(extended) == image).all()
        for cut in range(20, len(content), 7):
            with pytest.raises(ImageError):
                decode_bytes(content[:cut] if cut < 30 else content[: cut // 2 + 10])


def test_webp_transforms():
    """Green added, colours shared, an index, and all predictors, each applied here and undone there."""
    rng = np.random.default_rng(3)
    h, w = 9, 13
    image = rng.integers(0, 256, (h, w, 4)).astype(np.uint8)
    plain = _text(image)
    head, sub = plain[:40], lambda part: (lambda t: t[41] + t[43:])(_text(part))
    rest = lambda part: _text(part)[40:]

    def read(text):
        return vp8l.decode(_bytes(text))

    green = image.copy()
    green[..., 0] -= image[..., 1]
    green[..., 2] -= image[..., 1]
    assert (read(head + "1" + _low(2, 2) + rest(green)) == image).all()
    # shares of red and green, for blocks of 4 x 4
    share = rng.integers(0, 256, (3, 4, 4)).astype(np.uint8)
    signed = lambda v: int(v) - 256 if v > 127 else int(v)
    other = image.copy()
    for y in range(h):
        for x in range(w):
            red_to_blue, green_to_blue, green_to_red = map(signed, share[y // 4, x // 4, :3])
            r, g, b = map(int, image[y, x, :3])
            other[y, x, 0] = (r - (green_to_red * signed(g) >> 5)) % 256
            other[y, x, 2] = (b - (green_to_blue * signed(g) >> 5) - (red_to_blue * signed(r) >> 5)) % 256
    assert (read(head + "1" + _low(1, 2) + _low(0, 3) + sub(share) + rest(other)) == image).all()
    for n, packed in ((2, 3), (4, 2), (11, 1), (200, 0)):
        colours = rng.integers(0, 256, (n, 4)).astype(np.uint8)
        index = rng.integers(0, n, (h, w))
        each, columns = 8 >> packed, (w + (1 << packed) - 1) >> packed
        small = np.zeros((h, columns, 4), np.uint8)
        for x in range(w):
            small[:, x >> packed, 1] |= (index[:, x] << (each * (x & ((1 << packed) - 1)))).astype(np.uint8)
        steps = np.diff(colours.astype(int), axis=0, prepend=0).astype(np.uint8)[None]
        assert (read(head + "1" + _low(3, 2) + _low(n - 1, 8) + sub(steps) + rest(small)) == colours[index]).all()
    modes = np.zeros((3, 4, 4), np.uint8)
    modes[..., 1] = rng.permutation(np.arange(14))[:12].reshape(3, 4)
    for extra in (modes, np.full((3, 4, 4), 12, np.uint8), np.full((3, 4, 4), 13, np.uint8), np.full((3, 4, 4), 11, np.uint8)):
        left = image.copy()
        for y in range(h):
            for x in range(w):
                flat = image.reshape(-1, 4).astype(int)
                at = y * w + x
                L, T, TL, TR = (flat[at - k] if at >= k else None for k in (1, w, w + 1, w - 1))
                half = lambda a, b: (a + b) // 2
                if not y:
                    guess = L if x else np.array([0, 0, 0, 255])
                elif not x:
                    guess = T
                else:
                    guess = [lambda: np.array([0, 0, 0, 255]), lambda: L, lambda: T, lambda: TR, lambda: TL, lambda: half(half(L, TR), T), lambda: half(L, TL), lambda: half(L, T), lambda: half(TL, T), lambda: half(T, TR), lambda: half(half(L, TL), half(T, TR)), lambda: L if abs(L + T - TL - L).sum() < abs(L + T - TL - T).sum() else T, lambda: np.clip(L + T - TL, 0, 255), lambda: np.clip(half(L, T) + np.trunc((half(L, T) - TL) / 2).astype(int), 0, 255)][extra[y // 4, x // 4, 1]]()
                left[y, x] = (image[y, x].astype(int) - guess) % 256
        assert (read(head + "1" + _low(0, 2) + _low(0, 3) + sub(extra) + rest(left)) == image).all()
    # two transforms: the last one read is undone first
    assert (read(head + "1" + _low(2, 2) + "1" + _low(0, 2) + _low(0, 3) + sub(modes * 0 + np.array([0, 2, 0, 0], np.uint8)) + rest(_up(green))) == image).all()


def _up(image):
    """Less the pixel above, or in the first row the one to the left."""
    out = image.copy()
    out[1:] -= image[:-1]
    out[0, 1:] -= image[0, :-1]
    out[0, 0] -= np.array([0, 0, 0, 255], np.uint8)
    return out


def test_webp_copies_and_cache():
    """Two colours, four pixels from two back, one from the cache, and the row above it."""
    a, b = (1, 10, 3, 255), next((1, g, 3, 255) for g in range(20, 99) if (255 << 24 | 1 << 16 | g << 8 | 3) * 0x1E35A7BD % 2**32 >> 30 != (255 << 24 | 1 << 16 | 10 << 8 | 3) * 0x1E35A7BD % 2**32 >> 30)
    number = lambda p: p[3] << 24 | p[0] << 16 | p[1] << 8 | p[2]
    place = number(a) * 0x1E35A7BD % 2**32 >> 30
    assert place != number(b) * 0x1E35A7BD % 2**32 >> 30
    symbols = [10, b[1], 256 + 3, 256 + 4, 280 + place]
    size = 280 + 4
    lengths = [0] * size
    for s, n in zip(symbols, (2, 2, 2, 3, 3), strict=True):
        lengths[s] = n
    codes = dict(zip(symbols, ("00", "01", "10", "110", "111"), strict=True))
    green = "0" + _low(15, 4) + "".join(_low(0 if k > 15 else 4, 3) for k in vp8l.ORDER) + "0" + "".join(f"{n:04b}" for n in lengths)
    single = lambda v: "1" + "0" + "1" + _low(v, 8)
    distances = "1" + "1" + "1" + _low(0, 8) + _low(4, 8)  # prefixes 0 and 4, as bits 0 and 1
    # width 7, height 2: a b (a b a b) a, then seven of the row above
    data = codes[10] + codes[b[1]] + codes[259] + "1" + _low(1, 1) + codes[280 + place] + codes[260] + _low(1, 1) + "0" + codes[10]
    text = _low(0x2F, 8) + _low(6, 14) + _low(1, 14) + "0" + "000" + "0" + "1" + _low(2, 4) + "0" + green + single(1) + single(3) + single(255) + distances + data
    got = vp8l.decode(_bytes(text))
    assert got[..., 1].tolist() == [[10, b[1]] * 3 + [10]] * 2


def test_dithering_is_a_scan():
    """Line by slanted line gives what pixel after pixel does."""
    rng = np.random.default_rng(7)
    for h, w in ((1, 1), (1, 9), (9, 1), (2, 3), (13, 8), (8, 13)):
        image = rng.integers(0, 256, (h, w, 4)).astype(np.uint8)
        clear, palette = image[..., 3] < 60, rng.integers(0, 256, (5, 3))
        work, want = np.zeros((h + 1, w + 2, 3), np.float32), np.zeros((h, w), np.int64)
        work[:h, 1:-1] = image[..., :3]
        for y in range(h):
            for x in range(w):
                if not clear[y, x]:
                    value = np.floor(np.clip(work[y, x + 1], 0, 255).astype(float) + 0.5)
                    want[y, x] = k = ((palette - value) ** 2).sum(1).argmin()
                    for dy, dx, n in ((0, 1, 7), (1, -1, 3), (1, 0, 5), (1, 1, 1)):
                        work[y + dy, x + 1 + dx] += (value - palette[k]) * (n / 16)
        assert (gif._dithered(image, palette, clear) == want).all()


def test_jpeg_symbols_survive():
    """Long runs of zeros, full blocks and all sizes: coefficients read back as written."""
    rng = np.random.default_rng(8)
    blocks = np.zeros((6 * 4, 64), np.int64)
    for b in range(len(blocks)):
        places = rng.choice(64, rng.integers(0, 64), replace=False) if b % 3 else [63] * (b % 2)
        blocks[b, places] = rng.integers(-900, 900, len(places))
    blocks[:, 0] = rng.integers(-1000, 1000, len(blocks))
    blocks[5, 1:] = 1
    data = jpeg._coded(blocks, np.tile([0, 0, 0, 0, 1, 2], 4))
    whole = jpeg.encode(np.full((16, 64, 4), 255, np.uint8), 100)
    at = whole.index(b"\xff\xda") + 14
    frame = jpeg.read(whole[:at] + data + b"\xff\xd9")
    got = [c.blocks for c in frame.components.values()]
    want = blocks.reshape(4, 6, 64)
    assert (got[0].reshape(2, 4, 2, 64).swapaxes(0, 1).reshape(4, 4, 64) == want[:, :4]).all()
    assert (got[1].reshape(4, 64) == want[:, 4]).all() and (got[2].reshape(4, 64) == want[:, 5]).all()
