"""PNG: all depths and colour types, both interlace methods; writes 8-bit RGBA with the Paeth filter."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from ...errors import CorruptImage
from ...operators.rasters import Raster

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Pixels of small files that are worked on together.
GROUP_PIXELS = 1 << 18
# Channels of each colour type with the depths it may have; first column and row of each interlace pass, and steps.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def chunks(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(type, data) up to IEND, each against its checksum."""
    if not content.startswith(SIGNATURE):
        raise CorruptImage("PNG signature missing")
    at = len(SIGNATURE)
    while at < len(content):
        if at + 12 > len(content):
            raise CorruptImage("PNG chunk header truncated")
        (length,), kind = struct.unpack_from(">I", content, at), content[at + 4 : at + 8]
        if at + 12 + length > len(content):
            raise CorruptImage(f"PNG chunk {kind!r} runs past the end of the file")
        if zlib.crc32(content[at + 4 : at + 8 + length]) != struct.unpack_from(">I", content, at + 8 + length)[0]:
            raise CorruptImage(f"PNG chunk {kind!r} fails its checksum")
        yield kind, content[at + 8 : at + 8 + length]
        if kind == b"IEND":
            return
        at += 12 + length


def _header(kind: bytes, data: bytes) -> tuple[int, ...]:
    if kind != b"IHDR" or len(data) != 13:
        raise CorruptImage("PNG does not begin with a header")
    width, height, depth, colour, compression, filtering, interlace = struct.unpack(">IIBBBBB", data)
    if width < 1 or height < 1:
        raise CorruptImage(f"PNG size {width}x{height} is not valid")
    if depth not in DEPTHS.get(colour, ()):
        raise CorruptImage(f"PNG depth {depth} does not go with colour type {colour}")
    if compression or filtering or interlace > 1:
        raise CorruptImage("PNG compression, filter or interlace method is not known")
    return width, height, depth, colour, interlace


def probe(content: bytes) -> tuple[int, int]:
    return _header(*next(chunks(content), (b"", b"")))[:2]


def _unfiltered(data: np.ndarray, rows: int, row_bytes: int, step: int) -> np.ndarray:
    """Rows of bytes without their filters; `step` bytes make a whole pixel."""
    lines = data[: rows * (row_bytes + 1)].reshape(rows, row_bytes + 1)
    if lines[:, 0].max() > 4:
        raise CorruptImage(f"PNG filter {lines[:, 0].max()} is not known")
    if (lines[:, 0] >= 3).any():
        return _diagonally(lines[:, 0], lines[:, 1:].reshape(rows, -1, step)).reshape(rows, row_bytes)
    out = np.zeros((rows + 1, row_bytes + step), np.uint8)  # a row above and a pixel to the left, of zeros
    for y in range(rows):
        kind, line, up = lines[y, 0], lines[y, 1:], out[y]
        here = out[y + 1]
        if kind == 0:
            here[step:] = line
        elif kind == 1:
            for k in range(step):
                here[step + k :: step] = np.cumsum(line[k::step], dtype=np.uint8)
        else:
            here[step:] = line + up[step:]
    return out[1:, step:]


def _diagonally(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Rows under any filters, (rows, columns, step), or a stack of them. A pixel needs those to its left, above, and above left,
    which lie on the two diagonals before its own, so a whole diagonal is one step."""
    rows, columns, step = lines.shape[-3:]
    source = np.ascontiguousarray(lines).reshape(-1, rows * columns, step)
    flat = np.empty(source.shape, np.uint8)
    last, older = (np.zeros((len(source), rows + 1, step), np.int16) for _ in range(2))  # entry y + 1 is row y's
    sub, up, mean, paeth = ((kinds == k).reshape(-1, rows, 1) for k in (1, 2, 3, 4))
    for t in range(rows + columns - 1):
        begin, end = max(0, t - columns + 1), min(rows, t + 1)
        at = np.arange(begin, end) * (columns - 1) + t
        a, b, c = last[:, begin + 1 : end + 1], last[:, begin:end], older[:, begin:end]
        guess = np.where(sub[:, begin:end], a, 0) + np.where(up[:, begin:end], b, 0) + np.where(mean[:, begin:end], (a + b) >> 1, 0)
        pa, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
        near = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
        here = (source[:, at] + np.where(paeth[:, begin:end], near, guess)) & 255
        flat[:, at] = here
        older, last = last, older
        last[:, begin + 1 : end + 1] = here
        last[:, end + 1 :] = 0
    return flat.reshape(lines.shape)


def _samples(lines: np.ndarray, width: int, depth: int, channels: int) -> np.ndarray:
    """(rows, width, channels) of sample values."""
    if depth == 8:
        return lines.reshape(len(lines), width, channels)
    if depth == 16:
        return lines.reshape(len(lines), width, channels, 2).view(">u2")[..., 0]
    bits = np.unpackbits(lines, axis=1).reshape(len(lines), -1, depth)[:, :width]
    return (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[..., None]


class _File(NamedTuple):
    width: int
    height: int
    depth: int
    colour: int
    interlace: int
    palette: np.ndarray | None
    transparency: bytes
    data: np.ndarray  # inflated


def _passes(width: int, height: int, interlace: int) -> list[tuple[int, ...]]:
    """First column and row, steps, width and height of each."""
    return [(x, y, dx, dy, max(0, -(-(width - x) // dx)), max(0, -(-(height - y) // dy))) for x, y, dx, dy in (PASSES if interlace else [(0, 0, 1, 1)])]


def _read(content: bytes) -> _File:
    walk = chunks(content)
    width, height, depth, colour, interlace = _header(*next(walk, (b"", b"")))
    palette, transparency, packed = None, b"", []
    for kind, data in walk:
        if kind == b"PLTE":
            if not data or len(data) % 3 or len(data) > 768:
                raise CorruptImage("PNG palette has a bad length")
            palette = np.frombuffer(data, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            transparency = data
        elif kind == b"IDAT":
            packed.append(data)
    if not packed:
        raise CorruptImage("PNG has no image data")
    if colour == 3 and palette is None:
        raise CorruptImage("PNG of palette colours has no palette")
    bits = CHANNELS[colour] * depth
    need = sum(h * (1 + (w * bits + 7) // 8) for *_, w, h in _passes(width, height, interlace) if w)
    try:  # no more than the header announces, whatever the stream would hold
        raw = zlib.decompressobj().decompress(b"".join(packed), need)
    except zlib.error as e:
        raise CorruptImage(f"PNG data does not inflate: {e}") from e
    if len(raw) < need:
        raise CorruptImage("PNG data is short")
    return _File(width, height, depth, colour, interlace, palette, transparency, np.frombuffer(raw, np.uint8))


def _pictures(files: list[_File]) -> list[Raster]:
    """Of files that are alike in all but their numbers. Of one alone, each row is undone at once where its filter lets it."""
    width, height, depth, colour, interlace = files[0][:5]
    channels = CHANNELS[colour]
    bits, at = channels * depth, 0
    data = np.stack([f.data for f in files]) if len(files) > 1 else files[0].data[None]
    out = np.zeros((len(files), height, width, channels), np.uint16)
    for x, y, dx, dy, w, h in _passes(width, height, interlace):
        if w and h:
            row, step = (w * bits + 7) // 8, max(1, bits // 8)
            if len(files) == 1:
                lines = _unfiltered(data[0, at:], h, row, step)
            else:
                lines = data[:, at : at + h * (row + 1)].reshape(len(files), h, row + 1)
                lines = _diagonally(lines[..., 0], lines[..., 1:].reshape(len(files), h, -1, step)).reshape(-1, row)
            at += h * (row + 1)
            out[:, y::dy, x::dx] = _samples(np.ascontiguousarray(lines), w, depth, channels).reshape(len(files), h, w, channels)
    if colour == 3:
        return [_rgba(o, depth, colour, f.palette, f.transparency) for o, f in zip(out, files, strict=True)]
    return list(_rgba(out, depth, colour, None, b""))


def decode(content: bytes) -> Raster:
    return _pictures([_read(content)])[0]


def decode_many(contents: list[bytes]) -> list[Raster | Exception]:
    """As decode, for many small files: a picture or what went wrong for each. Files of the same header have their filters undone
    together, at most GROUP_PIXELS at a time."""
    out: list = [None] * len(contents)
    groups: dict[tuple[int, ...], list[tuple[int, _File]]] = {}
    for i, content in enumerate(contents):
        try:
            file = _read(content)
        except Exception as e:  # the caller tells its own errors from others
            out[i] = e
            continue
        groups.setdefault(file[:5], []).append((i, file))
    for alike, found in groups.items():
        step = max(1, GROUP_PIXELS // (alike[0] * alike[1]))
        for part in (found[at : at + step] for at in range(0, len(found), step)):
            try:
                if any(_filters(f).max() > 4 for _, f in part):
                    raise CorruptImage("PNG filter is not known")
                pictures = _pictures([f for _, f in part])
            except Exception:  # each is asked by itself what goes wrong
                pictures = [_alone(f) for _, f in part]
            for (i, _), picture in zip(part, pictures, strict=True):
                out[i] = picture
    return out


def _filters(file: _File) -> np.ndarray:
    """Those of all rows."""
    rows = [(h, 1 + (w * CHANNELS[file.colour] * file.depth + 7) // 8) for *_, w, h in _passes(file.width, file.height, file.interlace) if w and h]
    ends = np.cumsum([h * row for h, row in rows])
    return np.concatenate([file.data[end - h * row : end : row] for (h, row), end in zip(rows, ends, strict=True)])


def _alone(file: _File) -> Raster | Exception:
    try:
        return _pictures([file])[0]
    except Exception as e:
        return e


def _rgba(samples: np.ndarray, depth: int, colour: int, palette: np.ndarray | None, transparency: bytes) -> Raster:
    out = np.full((*samples.shape[:-1], 4), 255, np.uint8)
    if colour == 3:
        if samples.max() >= len(palette):
            raise CorruptImage("PNG palette index out of range")
        alpha = np.full(len(palette), 255, np.uint8)
        given = np.frombuffer(transparency[: len(palette)], np.uint8)
        alpha[: len(given)] = given
        return np.hstack([palette, alpha[:, None]])[samples[..., 0]]
    if depth == 16:
        samples = samples >> 8
    elif depth < 8:
        samples = np.floor(samples * 255 / ((1 << depth) - 1) + 0.5)
    if colour in (0, 4):
        out[..., :3] = samples[..., :1]
    else:
        out[..., :3] = samples[..., :3]
    if colour in (4, 6):
        out[..., 3] = samples[..., -1]
    return out


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(image: Raster) -> bytes:
    height, width = image.shape[:2]
    padded = np.zeros((height + 1, width + 1, 4), np.int16)
    padded[1:, 1:] = image
    a, b, c = padded[1:, :-1], padded[:-1, 1:], padded[:-1, :-1]
    pa, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    guess = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
    lines = np.empty((height, 1 + 4 * width), np.uint8)
    lines[:, 0] = 4
    lines[:, 1:] = (image - guess).astype(np.uint8).reshape(height, -1)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 9)) + _chunk(b"IEND", b"")
