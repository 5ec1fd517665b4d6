"""BMP: palettes of 1, 4 and 8 bits, 16, 24 and 32 bits with or without masks; writes 24 bits from the bottom up."""

from __future__ import annotations

import struct

import numpy as np

from ...errors import CorruptImage
from ...operators.rasters import Raster, composite
from ...plans.geometry import WHITE


def _header(content: bytes) -> dict:
    if content[:2] != b"BM":
        raise CorruptImage("BMP signature missing")
    if len(content) < 54:
        raise CorruptImage("BMP header truncated")
    (offset,), (size,) = struct.unpack_from("<I", content, 10), struct.unpack_from("<I", content, 14)
    width, height = struct.unpack_from("<ii", content, 18)
    bits, compression = struct.unpack_from("<HI", content, 28)
    (colours,) = struct.unpack_from("<I", content, 46)
    if size < 40:
        raise CorruptImage(f"BMP header of {size} bytes is not read")
    if width < 1 or not height:
        raise CorruptImage(f"BMP size {width}x{height} is not valid")
    if bits not in (1, 4, 8, 16, 24, 32):
        raise CorruptImage(f"BMP depth {bits} is not valid")
    if compression not in (0, 3, 6):
        raise CorruptImage(f"BMP compression {compression} is not read")
    masks = None
    if compression:
        n = 4 if compression == 6 or size >= 56 else 3
        if len(content) < 54 + 4 * n or bits not in (16, 32):
            raise CorruptImage("BMP masks are missing or do not go with the depth")
        masks = (*struct.unpack_from(f"<{n}I", content, 54), 0)[:4]
    elif bits == 16:
        masks = (0x7C00, 0x3E0, 0x1F, 0)
    elif bits == 32:
        masks = (0xFF0000, 0xFF00, 0xFF, 0xFF000000)
    return {"offset": offset, "dib": size, "width": width, "height": abs(height), "down": height < 0, "bits": bits, "colours": colours, "masks": masks, "bare": compression == 0, "after": 14 + size + (4 * (4 if compression == 6 else 3) if compression and size == 40 else 0)}


def probe(content: bytes) -> tuple[int, int]:
    h = _header(content)
    return h["width"], h["height"]


def _channel(raw: np.ndarray, mask: int) -> np.ndarray:
    """A masked part of each number, spread over 0..255."""
    if not mask:
        return np.full(raw.shape, 255, np.uint8)
    shift = (mask & -mask).bit_length() - 1
    top = mask >> shift
    values = (raw & np.uint32(mask)) >> np.uint32(shift)
    return np.floor(values / top * 255 + 0.5).astype(np.uint8)


def decode(content: bytes) -> Raster:
    h = _header(content)
    width, height, bits = h["width"], h["height"], h["bits"]
    row = (width * bits + 31) // 32 * 4
    if h["offset"] + row * height > len(content):
        raise CorruptImage("BMP pixel data is short")
    lines = np.frombuffer(content, np.uint8, row * height, h["offset"]).reshape(height, row)
    if not h["down"]:
        lines = lines[::-1]
    out = np.full((height, width, 4), 255, np.uint8)
    if bits <= 8:
        n = h["colours"] or 1 << bits
        if h["after"] + 4 * n > len(content):
            raise CorruptImage("BMP palette is short")
        palette = np.frombuffer(content, np.uint8, 4 * n, h["after"]).reshape(-1, 4)[:, 2::-1]
        index = np.unpackbits(lines, axis=1).reshape(height, -1, bits) @ (1 << np.arange(bits)[::-1])
        index = index[:, :width]
        if index.max() >= n:
            raise CorruptImage("BMP palette index out of range")
        out[..., :3] = palette[index]
    elif bits == 24:
        out[..., :3] = lines[:, : 3 * width].reshape(height, width, 3)[..., ::-1]
    else:
        raw = np.ascontiguousarray(lines[:, : width * bits // 8]).view("<u2" if bits == 16 else "<u4").astype(np.uint32)
        for k, mask in enumerate(h["masks"]):
            out[..., k] = _channel(raw, mask)
        if bits == 32 and not out[..., 3].any():  # a fourth byte that nobody filled
            out[..., 3] = 255
    return out


def encode(image: Raster, background: tuple[int, ...] = WHITE) -> bytes:
    height, width = image.shape[:2]
    row = (3 * width + 3) // 4 * 4
    lines = np.zeros((height, row), np.uint8)
    lines[:, : 3 * width] = np.floor(composite(image, background)).astype(np.uint8)[::-1, :, ::-1].reshape(height, -1)
    size = row * height
    return struct.pack("<2sIHHI", b"BM", 54 + size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, size, 2835, 2835, 0, 0) + lines.tobytes()


