"""Baseline JPEG: reading with exact integer transforms and smooth chroma, at full or reduced size; writing 4:2:0."""

from __future__ import annotations

import struct
from array import array
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import numpy as np

from ...errors import CorruptImage, ImageTooLarge, InvalidOption, UnsupportedFormat, is_integer
from ...operators.rasters import Raster, clamped, composite
from ...plans.geometry import MAX_PIXELS, WHITE
from .bits import high_first

#: Places of a block's coefficients in the order in which files hold them: along the diagonals, turning at each end.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8))))
#: Pixels of small files that are worked on together.
GROUP_PIXELS = 1 << 18
# The quantisation tables of Annex K, and its Huffman tables as counts of codes by length and symbols.
LUMINANCE = (16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99)
CHROMINANCE = (17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99, *(99,) * 32)
DC_LUMINANCE = ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), tuple(range(12)))
DC_CHROMINANCE = ((0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0), tuple(range(12)))
AC_LUMINANCE = ((0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), (
    0x01, 0x02, 0x03, 0x00, 0x04, 0x11, 0x05, 0x12, 0x21, 0x31, 0x41, 0x06, 0x13, 0x51, 0x61, 0x07, 0x22, 0x71, 0x14,
    0x32, 0x81, 0x91, 0xA1, 0x08, 0x23, 0x42, 0xB1, 0xC1, 0x15, 0x52, 0xD1, 0xF0, 0x24, 0x33, 0x62, 0x72, 0x82, 0x09,
    0x0A, 0x16, 0x17, 0x18, 0x19, 0x1A, 0x25, 0x26, 0x27, 0x28, 0x29, 0x2A, 0x34, 0x35, 0x36, 0x37, 0x38, 0x39, 0x3A,
    0x43, 0x44, 0x45, 0x46, 0x47, 0x48, 0x49, 0x4A, 0x53, 0x54, 0x55, 0x56, 0x57, 0x58, 0x59, 0x5A, 0x63, 0x64, 0x65,
    0x66, 0x67, 0x68, 0x69, 0x6A, 0x73, 0x74, 0x75, 0x76, 0x77, 0x78, 0x79, 0x7A, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88,
    0x89, 0x8A, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9A, 0xA2, 0xA3, 0xA4, 0xA5, 0xA6, 0xA7, 0xA8, 0xA9,
    0xAA, 0xB2, 0xB3, 0xB4, 0xB5, 0xB6, 0xB7, 0xB8, 0xB9, 0xBA, 0xC2, 0xC3, 0xC4, 0xC5, 0xC6, 0xC7, 0xC8, 0xC9, 0xCA,
    0xD2, 0xD3, 0xD4, 0xD5, 0xD6, 0xD7, 0xD8, 0xD9, 0xDA, 0xE1, 0xE2, 0xE3, 0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9, 0xEA,
    0xF1, 0xF2, 0xF3, 0xF4, 0xF5, 0xF6, 0xF7, 0xF8, 0xF9, 0xFA,
))
AC_CHROMINANCE = ((0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119), (
    0x00, 0x01, 0x02, 0x03, 0x11, 0x04, 0x05, 0x21, 0x31, 0x06, 0x12, 0x41, 0x51, 0x07, 0x61, 0x71, 0x13, 0x22, 0x32,
    0x81, 0x08, 0x14, 0x42, 0x91, 0xA1, 0xB1, 0xC1, 0x09, 0x23, 0x33, 0x52, 0xF0, 0x15, 0x62, 0x72, 0xD1, 0x0A, 0x16,
    0x24, 0x34, 0xE1, 0x25, 0xF1, 0x17, 0x18, 0x19, 0x1A, 0x26, 0x27, 0x28, 0x29, 0x2A, 0x35, 0x36, 0x37, 0x38, 0x39,
    0x3A, 0x43, 0x44, 0x45, 0x46, 0x47, 0x48, 0x49, 0x4A, 0x53, 0x54, 0x55, 0x56, 0x57, 0x58, 0x59, 0x5A, 0x63, 0x64,
    0x65, 0x66, 0x67, 0x68, 0x69, 0x6A, 0x73, 0x74, 0x75, 0x76, 0x77, 0x78, 0x79, 0x7A, 0x82, 0x83, 0x84, 0x85, 0x86,
    0x87, 0x88, 0x89, 0x8A, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9A, 0xA2, 0xA3, 0xA4, 0xA5, 0xA6, 0xA7,
    0xA8, 0xA9, 0xAA, 0xB2, 0xB3, 0xB4, 0xB5, 0xB6, 0xB7, 0xB8, 0xB9, 0xBA, 0xC2, 0xC3, 0xC4, 0xC5, 0xC6, 0xC7, 0xC8,
    0xC9, 0xCA, 0xD2, 0xD3, 0xD4, 0xD5, 0xD6, 0xD7, 0xD8, 0xD9, 0xDA, 0xE2, 0xE3, 0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9,
    0xEA, 0xF2, 0xF3, 0xF4, 0xF5, 0xF6, 0xF7, 0xF8, 0xF9, 0xFA,
))


def canonical(counts: tuple[int, ...], symbols: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """(code, length) of each symbol."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            out[symbol] = (code, length)
            code += 1
        at, code = at + n, code << 1
    return out


@dataclass
class Component:
    h: int
    v: int
    table: int
    width: int = 0
    height: int = 0
    blocks: np.ndarray | None = None  # (rows, columns, 64) in zigzag order
    scanned: bool = False


@dataclass
class Frame:
    width: int
    height: int
    components: dict[int, Component]
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    adobe: int | None = None


def _segments(content: bytes):
    """(marker, begin, end) of each segment's data; a scan's data follow its segment and are left to the caller through send."""
    if content[:2] != b"\xff\xd8":
        raise CorruptImage("JPEG does not begin with its marker")
    at = 2
    while at < len(content):
        if content[at] != 0xFF:
            raise CorruptImage("JPEG marker expected")
        while at < len(content) and content[at] == 0xFF:
            at += 1
        if at >= len(content):
            return
        marker = content[at]
        at += 1
        if marker == 0xD9:
            return
        if marker == 0x01 or 0xD0 <= marker <= 0xD7:
            continue
        if at + 2 > len(content):
            raise CorruptImage("JPEG segment truncated")
        (length,) = struct.unpack_from(">H", content, at)
        if length < 2 or at + length > len(content):
            raise CorruptImage("JPEG segment runs past the end of the file")
        moved = yield marker, at + 2, at + length
        at = moved if moved is not None else at + length


def _frame(content: bytes, marker: int, begin: int, end: int) -> Frame:
    if marker in (0xC9, 0xCA):
        raise UnsupportedFormat(content, "Arithmetic-coded JPEG is not supported.")
    if end - begin < 6:
        raise CorruptImage("JPEG frame header truncated")
    precision, height, width, n = struct.unpack_from(">BHHB", content, begin)
    if precision != 8:
        raise UnsupportedFormat(content, f"JPEG with {precision} bits a sample is not supported.")
    if not width or not height:
        raise CorruptImage(f"JPEG size {width}x{height} is not valid")
    if width * height > MAX_PIXELS:
        raise ImageTooLarge(width, height, MAX_PIXELS)
    if n not in (1, 3, 4):
        raise UnsupportedFormat(content, f"JPEG with {n} components is not supported.")
    if end - begin < 6 + 3 * n:
        raise CorruptImage("JPEG frame header truncated")
    parts = {}
    for k in range(n):
        name, sampling, table = content[begin + 6 + 3 * k : begin + 9 + 3 * k]
        h, v = sampling >> 4, sampling & 15
        if not (1 <= h <= 4 and 1 <= v <= 4) or name in parts:
            raise CorruptImage("JPEG sampling factors are not valid")
        parts[name] = Component(h, v, table)
    return Frame(width, height, parts)


def _is_frame(marker: int) -> bool:
    return 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC)


def probe(content: bytes) -> tuple[int, int]:
    for marker, begin, end in _segments(content):
        if _is_frame(marker):
            frame = _frame(content, marker, begin, end)
            return frame.width, frame.height
        if marker == 0xDA:
            break
    raise CorruptImage("JPEG has no frame")


def orientation(content: bytes) -> int:
    """1..8 from the first EXIF segment; 1 where there is none or it cannot be read."""
    try:
        for marker, begin, end in _segments(content):
            if marker == 0xE1 and content[begin : begin + 6] == b"Exif\0\0":
                data = content[begin + 6 : end]
                order = {b"II": "<", b"MM": ">"}[data[:2]]
                magic, at = struct.unpack_from(order + "HI", data, 2)
                (n,) = struct.unpack_from(order + "H", data, at)
                for k in range(n):
                    tag, _, _, value = struct.unpack_from(order + "HHIH", data, at + 2 + 12 * k)
                    if tag == 0x0112 and magic == 42:
                        return value if 1 <= value <= 8 else 1
                return 1
            if marker == 0xDA:
                break
    except (CorruptImage, KeyError, struct.error):
        pass
    return 1


def _windows(data: bytes) -> array:
    """The 40 bits from each byte on; zeros follow the end."""
    raw = np.frombuffer(data + b"\0" * 96, np.uint8).astype(np.int64)
    out = raw[: len(raw) - 4] << 32
    for k in range(1, 5):
        out |= raw[k : len(raw) - 4 + k] << (32 - 8 * k)
    return array("q", out.tobytes())


@lru_cache(32)
def _lookup(counts: tuple[int, ...], symbols: bytes) -> list[int]:
    """length << 8 | symbol for every 16 bits that may come. Most files have the same few tables."""
    table = [0] * 65536
    code = at = 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            begin, end = code << (16 - length), (code + 1) << (16 - length)
            if end > 65536:
                raise CorruptImage("JPEG Huffman table is not valid")
            table[begin:end] = [length << 8 | symbol] * (end - begin)
            code += 1
        at, code = at + n, code << 1
    return table


@lru_cache(32)
def _whole(counts: tuple[int, ...], symbols: bytes, first: bool) -> list[int]:
    """For every 16 bits that may come, where a code and the number after it fit into them: (number + 32768) << 16 | zeros before
    it << 8 | bits of both; 128 + bits for "no more"; else 0."""
    entry = np.array(_lookup(counts, symbols))
    length, symbol = entry >> 8, entry & 255
    run, size = (np.zeros_like(symbol), symbol) if first else (symbol >> 4, symbol & 15)
    total = length + size
    value = np.arange(65536) >> np.maximum(16 - total, 0) & ((1 << size) - 1)
    value = np.where(value >> np.maximum(size - 1, 0) != 0, value, value - (1 << size) + 1)
    out = np.where((length > 0) & (total <= 16) & (first | (size > 0)) & (size <= 11 if first else size <= 15), (np.where(size > 0, value, 0) + 32768) << 16 | run << 8 | total, 0)
    if not first:
        out[(length > 0) & (symbol == 0)] = 128 + length[(length > 0) & (symbol == 0)]
    return out.tolist()


def _scan(content: bytes, begin: int, end: int, frame: Frame, tables: dict, interval: int) -> int:
    """Decodes a scan into its components; gives the place of the marker after it."""
    n = content[begin]
    if end - begin < 4 + 2 * n or not 1 <= n <= 4:
        raise CorruptImage("JPEG scan header is not valid")
    chosen = []
    for k in range(n):
        name, which = content[begin + 1 + 2 * k : begin + 3 + 2 * k]
        if name not in frame.components:
            raise CorruptImage("JPEG scan names a component that the frame lacks")
        try:
            dc, ac = tables[0, which >> 4], tables[1, which & 15]
            chosen.append((frame.components[name], _lookup(*dc), _lookup(*ac), _whole(*dc, True), _whole(*ac, False)))
        except KeyError:
            raise CorruptImage("JPEG scan names a Huffman table that is missing") from None
    at, pieces, start = end, [], end
    while True:  # up to the next marker that is neither a stuffed zero nor a restart
        at = content.find(b"\xff", at)
        if at < 0 or at + 1 >= len(content):
            at = len(content)
            break
        if content[at + 1] == 0:
            at += 2
        elif 0xD0 <= content[at + 1] <= 0xD7:
            pieces.append(content[start:at])
            at = start = at + 2
        elif content[at + 1] == 0xFF:
            at += 1
        else:
            break
    pieces.append(content[start:at])
    pieces = [p.replace(b"\xff\0", b"\xff") for p in pieces]
    top_h, top_v = (max(getattr(c, k) for c in frame.components.values()) for k in "hv")
    if n == 1:
        c = chosen[0][0]
        rows, columns = -(-c.height // 8), -(-c.width // 8)
        units = [(0, 0, 0)]
    else:
        rows, columns = -(-frame.height // (8 * top_v)), -(-frame.width // (8 * top_h))
        units = [(i, y, x) for i, (c, *_) in enumerate(chosen) for y in range(c.v) for x in range(c.h)]
    total = rows * columns
    step = interval or total
    if len(pieces) < -(-total // step):
        raise CorruptImage("JPEG restart marker is missing")
    held = [array("i", c.blocks.tobytes()) for c, *_ in chosen]
    for piece, first in zip(pieces, range(0, total, step), strict=False):
        _interval(piece, chosen, held, units, columns, first, min(total, first + step))
    for (c, *_), values in zip(chosen, held, strict=True):
        c.blocks = np.frombuffer(values, np.int32).reshape(c.blocks.shape)
    for c, *_ in chosen:
        c.scanned = True
    return at


def _interval(piece: bytes, chosen: list, held: list[array], units: list, columns: int, first: int, end: int) -> None:
    """Decodes the blocks between two restart markers; `held` has each component's coefficients. A code and its value lie
    within 32 bits, which one look at the windows gives."""
    windows, at, limit = _windows(piece), 0, 8 * len(piece) + 64 * 8
    before = [0] * len(chosen)
    alone = len(chosen) == 1
    # each block of a unit: tables, coefficients, and where it begins: by row and column of units
    known = []
    for i, y, x in units:
        c, *codes = chosen[i]
        wide = c.blocks.shape[1]
        known.append((i, *codes, held[i], 64 * (1 if alone else c.v) * wide, 64 * (1 if alone else c.h), 64 * (0 if alone else y * wide + x)))
    for unit in range(first, end):
        row, column = divmod(unit, columns)
        for i, dc, ac, dc_whole, ac_whole, values, by_row, by_column, base in known:
            base += row * by_row + column * by_column
            if at > limit:
                raise CorruptImage("JPEG scan data is short")
            entry = dc_whole[windows[at >> 3] >> (24 - (at & 7)) & 0xFFFF]
            if entry:
                at += entry & 127
                before[i] += (entry >> 16) - 32768
            else:
                bits = windows[at >> 3] >> (8 - (at & 7)) & 0xFFFFFFFF
                entry = dc[bits >> 16]
                size = entry & 255
                if not entry or size > 11:
                    raise CorruptImage("JPEG difference has no code or is too large")
                at += (entry >> 8) + size
                value = bits >> (32 - (entry >> 8) - size) & ((1 << size) - 1)
                before[i] += value if value >> (size - 1) else value - (1 << size) + 1
            values[base] = before[i]
            k = 1
            while k < 64:
                entry = ac_whole[windows[at >> 3] >> (24 - (at & 7)) & 0xFFFF]
                if entry > 0xFFFF:
                    k += entry >> 8 & 15
                    if k > 63:
                        raise CorruptImage("JPEG run goes beyond its block")
                    at += entry & 127
                    values[base + k] = (entry >> 16) - 32768
                    k += 1
                elif entry:
                    at += entry & 127
                    break
                else:
                    bits = windows[at >> 3] >> (8 - (at & 7)) & 0xFFFFFFFF
                    entry = ac[bits >> 16]
                    if not entry:
                        raise CorruptImage("JPEG code is in no table")
                    size, length = entry & 15, entry >> 8
                    at += length + size
                    if size:
                        k += entry >> 4 & 15
                        if k > 63:
                            raise CorruptImage("JPEG run goes beyond its block")
                        value = bits >> (32 - length - size) & ((1 << size) - 1)
                        values[base + k] = value if value >> (size - 1) else value - (1 << size) + 1
                        k += 1
                    elif entry & 255 != 0xF0:
                        break
                    else:
                        k += 16
                if at > limit:
                    raise CorruptImage("JPEG scan data is short")


def read(content: bytes) -> Frame:
    """The whole file down to coefficients."""
    frame, tables, quant, interval, adobe = None, {}, {}, 0, None
    walk = _segments(content)
    item = next(walk, None)
    while item is not None:
        marker, begin, end = item
        moved = None
        if marker == 0xDB:
            while begin < end:
                wide, which = content[begin] >> 4, content[begin] & 15
                size = 64 * (1 + (wide > 0))
                if begin + 1 + size > end:
                    raise CorruptImage("JPEG quantisation table truncated")
                quant[which] = np.frombuffer(content, ">u2" if wide else np.uint8, 64, begin + 1).astype(np.int64)
                begin += 1 + size
        elif marker == 0xC4:
            while begin < end:
                counts = tuple(content[begin + 1 : begin + 17])
                if begin + 17 + sum(counts) > end:
                    raise CorruptImage("JPEG Huffman table truncated")
                tables[content[begin] >> 4, content[begin] & 15] = counts, bytes(content[begin + 17 : begin + 17 + sum(counts)])
                _lookup(*tables[content[begin] >> 4, content[begin] & 15])
                begin += 17 + sum(counts)
        elif marker == 0xDD:
            (interval,) = struct.unpack_from(">H", content, begin)
        elif marker == 0xEE and content[begin : begin + 5] == b"Adobe" and end - begin >= 12:
            adobe = content[begin + 11]
        elif _is_frame(marker):
            if marker not in (0xC0, 0xC1):
                _frame(content, marker, begin, end)
                raise UnsupportedFormat(content, "Progressive JPEG is not supported." if marker == 0xC2 else "This kind of JPEG is not supported.")
            if frame is not None:
                raise CorruptImage("JPEG has two frames")
            frame = _frame(content, marker, begin, end)
            top_h, top_v = (max(getattr(c, k) for c in frame.components.values()) for k in "hv")
            for c in frame.components.values():
                c.width, c.height = -(-frame.width * c.h // top_h), -(-frame.height * c.v // top_v)
                c.blocks = np.zeros((-(-frame.height // (8 * top_v)) * c.v, -(-frame.width // (8 * top_h)) * c.h, 64), np.int32)
        elif marker == 0xDA:
            if frame is None:
                raise CorruptImage("JPEG scan comes before its frame")
            moved = _scan(content, begin, end, frame, tables, interval)
        try:
            item = walk.send(moved)
        except StopIteration:
            item = None
    if frame is None or not all(c.scanned for c in frame.components.values()):
        raise CorruptImage("JPEG has no frame or a component without data")
    for c in frame.components.values():
        if c.table not in quant:
            raise CorruptImage("JPEG quantisation table is missing")
    frame.quant, frame.adobe = quant, adobe
    return frame


_NATURAL = np.argsort(ZIGZAG)


def _coefficients(blocks: np.ndarray, table: np.ndarray) -> np.ndarray:
    """(rows, columns, 8, 8), dequantised, in natural order. A table for all, or one for each row."""
    return (blocks[..., _NATURAL] * table[..., _NATURAL].astype(np.int32)).reshape(*blocks.shape[:2], 8, 8)


# The multipliers of the accurate integer transform, in 13 bits.
_F = {k: round(k * (1 << 13)) for k in (0.298631336, 0.390180644, 0.541196100, 0.765366865, 0.899976223, 1.175875602, 1.501321110, 1.847759065, 1.961570560, 2.053119869, 2.562915447, 3.072711026)}


def _pass(v: list[np.ndarray], shift: int) -> list[np.ndarray]:
    """One dimension of the inverse transform over eight arrays, scaled down by `shift` bits with rounding."""
    f = _F
    z = (v[2] + v[6]) * f[0.541196100]
    low, high = z - v[6] * f[1.847759065], z + v[2] * f[0.765366865]
    plus, minus = (v[0] + v[4]) << 13, (v[0] - v[4]) << 13
    even = [plus + high, minus + low, minus - low, plus - high]
    z1, z2, z3, z4 = v[7] + v[1], v[5] + v[3], v[7] + v[3], v[5] + v[1]
    z5 = (z3 + z4) * f[1.175875602]
    z1, z2 = -z1 * f[0.899976223], -z2 * f[2.562915447]
    z3, z4 = z5 - z3 * f[1.961570560], z5 - z4 * f[0.390180644]
    odd = [v[1] * f[1.501321110] + z1 + z4, v[3] * f[3.072711026] + z2 + z3, v[5] * f[2.053119869] + z2 + z4, v[7] * f[0.298631336] + z1 + z3]
    half = 1 << (shift - 1)
    return [(e + o + half) >> shift for e, o in zip(even, odd, strict=True)] + [(e - o + half) >> shift for e, o in zip(even[::-1], odd[::-1], strict=True)]


def inverse(blocks: np.ndarray) -> np.ndarray:
    """Samples 0..255 of blocks (..., 8, 8), by the integer transform that keeps 2 bits more between its passes."""
    flat, out = blocks.reshape(-1, 8, 8), np.empty(blocks.shape, np.uint8)
    done = out.reshape(-1, 8, 8)
    for a in range(0, len(flat), 2048):  # so many at a time stay in the cache
        part = np.ascontiguousarray(np.moveaxis(flat[a : a + 2048], 0, 2))
        columns = np.stack(_pass(list(part), 11))
        rows = np.stack(_pass([columns[:, k] for k in range(8)], 18))
        done[a : a + 2048] = np.clip(rows + 128, 0, 255).astype(np.uint8).transpose(2, 1, 0)
    return out


def reduced_inverse(blocks: np.ndarray, n: int) -> np.ndarray:
    """Samples of n x n from the lowest frequencies of each block, for n of 1, 2 and 4; for 1 a block's mean. One dimension
    after the other, from the lowest frequency on: halves are rounded as the sums of floats come."""
    if n == 1:
        return np.clip((blocks[..., :1, :1] + 4 >> 3) + 128, 0, 255).astype(np.uint8)
    share = np.where(np.arange(n) == 0, np.sqrt(0.5), 1.0)
    cosine = np.cos((2 * np.arange(n)[:, None] + 1) * np.arange(n) * np.pi / (2 * n))  # (place, frequency)
    low, rows, total = blocks[..., :n, :n].astype(float), 0.0, 0.0
    for u in range(n):
        rows = rows + (share[u] * low[..., u])[..., None] * cosine[:, u]
    for v in range(n):
        total = total + (share[v] * rows[..., v, :])[..., None, :] * cosine[:, v, None]
    return np.clip(np.floor(total / 4 + 0.5) + 128, 0, 255).astype(np.uint8)


def block_size(width: int, height: int, hint: int | None) -> int:
    """The largest of 8, 4, 2 and 1 at which the picture stays within the hint; 1 if none does."""
    if hint is None:
        return 8
    return next((n for n in (8, 4, 2) if -(-max(width, height) * n // 8) <= hint), 1)


def _smooth_columns(p: np.ndarray, near: int, bias: tuple[int, int], shift: int) -> np.ndarray:
    """Twice the columns: three parts of the nearer and one of the further; the ends have no further one."""
    out = np.empty((*p.shape[:-1], 2 * p.shape[-1]), np.int32)
    out[..., 2::2] = 3 * p[..., 1:] + p[..., :-1] + bias[0]
    out[..., 1:-1:2] = 3 * p[..., :-1] + p[..., 1:] + bias[1]
    out[..., 0], out[..., -1] = near * p[..., 0] + bias[0], near * p[..., -1] + bias[1]
    return out >> shift


def upsample(plane: np.ndarray, across: Fraction | int, down: Fraction | int) -> np.ndarray:
    """A plane, or a stack of them, at `across` times its width and `down` times its height. Twice the width, or both, is smooth;
    at other ratios, whole or not, samples repeat."""
    p = plane.astype(np.int32)
    if (across, down) == (1, 1):
        return p
    if (across, down) == (2, 1) and p.shape[-1] > 2:
        out = _smooth_columns(p, 4, (1, 2), 2)
        out[..., 0], out[..., -1] = p[..., 0], p[..., -1]
        return out
    if (across, down) == (2, 2) and p.shape[-1] > 2:
        above, below = (np.concatenate(x, -2) for x in ((p[..., :1, :], p[..., :-1, :]), (p[..., 1:, :], p[..., -1:, :])))
        sums = np.empty((*p.shape[:-2], 2 * p.shape[-2], p.shape[-1]), np.int32)
        sums[..., ::2, :], sums[..., 1::2, :] = 3 * p + above, 3 * p + below
        return _smooth_columns(sums, 4, (8, 7), 4)
    rows, columns = (np.minimum(np.arange(int(n * by)) * by.denominator // by.numerator, n - 1) for n, by in zip(p.shape[-2:], map(Fraction, (down, across)), strict=True))
    return p[..., rows[:, None], columns]


def _rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> tuple[np.ndarray, ...]:
    cb, cr = cb - 128, cr - 128
    return y + (91881 * cr + 32768 >> 16), y + (-22554 * cb - 46802 * cr + 32768 >> 16), y + (116130 * cb + 32768 >> 16)


def _plane(parts: list[Component], quant: list[dict], n: int) -> np.ndarray:
    """The samples of a component of files alike, n x n for each block: (files, height, width)."""
    c, files = parts[0], len(parts)
    rows, columns = c.blocks.shape[:2]
    blocks = c.blocks if files == 1 else np.concatenate([p.blocks for p in parts])
    table = quant[0][c.table] if files == 1 else np.repeat(np.stack([q[p.table] for p, q in zip(parts, quant, strict=True)]), rows, 0)[:, None]
    out = np.empty((files * rows * n, columns * n), np.uint8)
    step = max(1, 2048 // columns)  # so many blocks at a time stay in the cache
    for top in range(0, files * rows, step):
        values = _coefficients(blocks[top : top + step], table if files == 1 else table[top : top + step])
        samples = inverse(values) if n == 8 else reduced_inverse(values, n)
        out[top * n : (top + len(values)) * n] = samples.swapaxes(1, 2).reshape(len(values) * n, columns * n)
    return out.reshape(files, rows * n, columns * n)[:, : -(-c.height * n // 8), : -(-c.width * n // 8)]


def _pictures(frames: list[Frame], hint: int | None) -> np.ndarray:
    """(files, height, width, 4) of files that are alike in all but their numbers."""
    frame = frames[0]
    n = block_size(frame.width, frame.height, hint)
    width, height = -(-frame.width * n // 8), -(-frame.height * n // 8)
    parts = list(frame.components.values())
    top_h, top_v = max(c.h for c in parts), max(c.v for c in parts)
    planes = []
    for same in zip(*(f.components.values() for f in frames), strict=True):
        whole = upsample(_plane(list(same), [f.quant for f in frames], n), Fraction(top_h, same[0].h), Fraction(top_v, same[0].v))
        # rounding may leave the last row or column of a ratio that isn't whole
        more = max(0, height - whole.shape[1]), max(0, width - whole.shape[2])
        planes.append((np.pad(whole, ((0, 0), (0, more[0]), (0, more[1])), "edge") if any(more) else whole)[:, :height, :width])
    out = np.full((len(frames), height, width, 4), 255, np.uint8)
    if len(planes) == 1:
        out[..., :3] = planes[0][..., None]
        return out
    for top in range(0, height, 32):  # a band at a time stays in the cache
        band = [p[:, top : top + 32].astype(np.int32) for p in planes]
        if len(band) == 3:
            band = band if frame.adobe == 0 else [np.clip(v, 0, 255) for v in _rgb(*band)]
        else:
            band = [clamped(v * band[3] / 255) for v in (_rgb(*band[:3]) if frame.adobe == 2 else band[:3])]
        for k, values in enumerate(band):
            out[:, top : top + 32, :, k] = values
    return out


def decode(content: bytes, hint: int | None = None) -> Raster:
    """hint: the longest edge that is wanted; the picture comes at an eighth, a quarter, half or all of its size."""
    return _pictures([read(content)], hint)[0]


def decode_many(contents: list[bytes], hint: int | None = None) -> list[Raster | Exception]:
    """As decode, for many small files: a picture or what went wrong for each. Files of the same sizes and sampling are transformed
    together, at most GROUP_PIXELS at a time."""
    out: list = [None] * len(contents)
    groups: dict[tuple, list[tuple[int, Frame]]] = {}
    for i, content in enumerate(contents):
        try:
            frame = read(content)
        except Exception as e:  # the caller tells its own errors from others
            out[i] = e
            continue
        alike = frame.width, frame.height, frame.adobe, *((c.h, c.v) for c in frame.components.values())
        groups.setdefault(alike, []).append((i, frame))
    for alike, found in groups.items():
        step = max(1, GROUP_PIXELS // (alike[0] * alike[1]))
        for at in range(0, len(found), step):
            places, frames = zip(*found[at : at + step], strict=True)
            try:
                pictures = list(_pictures(list(frames), hint))
            except Exception as e:
                pictures = [e] * len(frames)
            for i, picture in zip(places, pictures, strict=True):
                out[i] = picture
    return out


def scaled_table(base: tuple[int, ...], quality: int) -> np.ndarray:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(base) * scale + 50) // 100, 1, 255)


_COSINES = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def _quantised(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """(rows, columns, 64) in zigzag order of a plane whose sides are multiples of 8."""
    h, w = plane.shape
    blocks = plane.reshape(h // 8, 8, w // 8, 8).swapaxes(1, 2).astype(float) - 128
    freq = _COSINES @ blocks @ _COSINES.T
    step = table.reshape(8, 8)
    whole = np.sign(freq) * np.floor(np.abs(freq) / step + 0.5)
    return whole.reshape(h // 8, w // 8, 64)[..., ZIGZAG].astype(np.int64)


def magnitude(values: np.ndarray) -> np.ndarray:
    """Bits of the absolute value."""
    return np.frexp(np.abs(values).astype(float))[1]


def _codes(*tables: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Code and length by (table, symbol)."""
    out = np.zeros((2, len(tables), 256), np.int64)
    for k, table in enumerate(tables):
        for symbol, found in canonical(*table).items():
            out[:, k, symbol] = found
    return out[0], out[1]


def _coded(blocks: np.ndarray, component: np.ndarray) -> bytes:
    """The scan of blocks (n, 64) in zigzag order; component: 0, 1 or 2 for each."""
    return _coded_many(blocks, component, 1)[0]


def _coded_many(blocks: np.ndarray, component: np.ndarray, files: int) -> list[bytes]:
    """The scans of `files` files with as many blocks each. All symbols are found at once, put in order and packed by their places
    in the stream; ones fill the last byte of each file."""
    table = (component > 0).astype(np.int64)
    # differences of the first coefficients, within each component
    first = np.empty(len(blocks), np.int64)
    for k in range(3):
        mine = np.flatnonzero(component == k)
        first[mine] = np.diff(blocks[mine, 0].reshape(files, -1), axis=1, prepend=0).ravel()
    block, place = np.nonzero(blocks[:, 1:])
    value = blocks[block, place + 1]
    new = np.ones(len(block), bool)
    new[1:] = block[1:] != block[:-1]
    run = place - np.where(new, -1, np.concatenate([[0], place[:-1]])) - 1
    skips = run >> 4  # each stands for 16 zeros
    many = np.repeat(np.arange(len(block)), skips)
    short = np.setdiff1d(np.arange(len(blocks)), block[place == 62])
    size, difference = magnitude(value), magnitude(first)
    dc, ac = _codes(DC_LUMINANCE, DC_CHROMINANCE), _codes(AC_LUMINANCE, AC_CHROMINANCE)

    def part(kind, of: np.ndarray, symbol: np.ndarray, at: np.ndarray, bits: np.ndarray | int = 0, extra: np.ndarray | int = 0) -> np.ndarray:
        """Rows of (order, bits, length): a symbol's code with the bits that follow it."""
        code, length = kind[0][table[of], symbol], kind[1][table[of], symbol]
        return np.stack([of * 512 + at, code << bits | extra, length + bits])

    low = lambda v, n: np.where(v < 0, v + (1 << n) - 1, v)
    every = np.arange(len(blocks))
    found = np.concatenate([part(dc, every, difference, np.zeros(len(blocks), np.int64), difference, low(first, difference)), part(ac, block[many], np.full(len(many), 0xF0), 2 * place[many] + 2), part(ac, block, (run & 15) << 4 | size, 2 * place + 3, size, low(value, size)), part(ac, short, np.zeros(len(short), np.int64), np.full(len(short), 255))], 1)
    last = len(blocks) // files
    total = np.bincount(found[0] // 512 // last, found[2], files).astype(np.int64)
    more = -total % 8
    filled = np.flatnonzero(more)
    found = np.concatenate([found, np.stack([(filled + 1) * last * 512 - 1, (1 << more[filled]) - 1, more[filled]])], 1)
    _, bits, length = found[:, np.argsort(found[0], kind="stable")]
    data, end = high_first(bits, length), np.cumsum((total + more) // 8)
    return [data[b:e].replace(b"\xff", b"\xff\0") for b, e in zip([0, *end[:-1].tolist()], end.tolist(), strict=True)]


def encode(image: Raster, quality: int = 82, background: tuple[int, ...] = WHITE) -> bytes:
    return encode_many(image[None], quality, background)[0]


def encode_many(images: np.ndarray, quality: int = 82, background: tuple[int, ...] = WHITE) -> list[bytes]:
    """Files of pictures of one size, (files, height, width, 4)."""
    if not is_integer(quality) or not 1 <= quality <= 100:
        raise InvalidOption("jpeg.quality", quality, "must be an integer from 1 to 100")
    files, height, width = images.shape[:3]
    rgb = composite(images, background)
    r, g, b = rgb[..., 0], rgb[..., 1], rgb[..., 2]
    full = [clamped(0.299 * r + 0.587 * g + 0.114 * b), clamped(128 - 0.168736 * r - 0.331264 * g + 0.5 * b), clamped(128 + 0.5 * r - 0.418688 * g - 0.081312 * b)]
    rows, columns = -(-height // 16) * 16, -(-width // 16) * 16
    more = (0, 0), (0, rows - height), (0, columns - width)
    planes = [np.pad(full[0], more, "edge").reshape(-1, columns)]  # one under the other
    for p in full[1:]:
        p = np.pad(p.astype(np.int32), more, "edge").reshape(-1, columns)
        planes.append(p[::2, ::2] + p[::2, 1::2] + p[1::2, ::2] + p[1::2, 1::2] + 2 >> 2)
    tables = [scaled_table(LUMINANCE, int(quality)), scaled_table(CHROMINANCE, int(quality))]
    coefficients = [_quantised(p, tables[k > 0]) for k, p in enumerate(planes)]
    # blocks in the order of the file: four of luminance, then one of each chrominance
    order = [coefficients[0].reshape(files * rows // 16, 2, columns // 16, 2, 64).swapaxes(1, 2).reshape(-1, 4, 64)] + [c.reshape(-1, 1, 64) for c in coefficients[1:]]
    blocks = np.concatenate(order, 1)
    scans = _coded_many(blocks.reshape(-1, 64), np.tile(np.array([0, 0, 0, 0, 1, 2]), len(blocks)), files)
    segment = lambda marker, data: struct.pack(">BBH", 255, marker, len(data) + 2) + data
    head = b"\xff\xd8" + segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")
    head += segment(0xDB, b"".join(bytes([k]) + tables[k][ZIGZAG].astype(np.uint8).tobytes() for k in (0, 1)))
    head += segment(0xC0, struct.pack(">BHHB", 8, height, width, 3) + bytes((1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1)))
    huffman = ((0x00, DC_LUMINANCE), (0x10, AC_LUMINANCE), (0x01, DC_CHROMINANCE), (0x11, AC_CHROMINANCE))
    head += segment(0xC4, b"".join(bytes([k]) + bytes(counts) + bytes(symbols) for k, (counts, symbols) in huffman))
    head += segment(0xDA, bytes((3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0)))
    return [head + scan + b"\xff\xd9" for scan in scans]
