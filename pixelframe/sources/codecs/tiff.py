"""TIFF: the first picture, in strips, plain, LZW or PackBits; writes one strip of RGB or RGBA."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from ...errors import CorruptImage, ImageTooLarge, InvalidOption, UnsupportedFormat
from ...operators.rasters import Raster, has_alpha
from ...plans.geometry import MAX_PIXELS
from .bits import high_first

# Tag numbers, and bytes of each field type that holds integers.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, COLOUR_MAP, TILE_WIDTH, TILE_OFFSETS, EXTRA = 284, 317, 320, 322, 324, 338
TYPES = {1: "B", 3: "H", 4: "I"}
CLEAR, END, FIRST = 256, 257, 258


@dataclass
class Directory:
    content: bytes
    order: str
    fields: dict[int, tuple[int, int, int]]

    def get(self, tag: int, default: tuple[int, ...] = ()) -> tuple[int, ...]:
        if tag not in self.fields:
            return default
        kind, count, at = self.fields[tag]
        size = struct.calcsize(TYPES[kind]) * count
        if size > 4:
            (at,) = struct.unpack_from(self.order + "I", self.content, at)
        if at + size > len(self.content):
            raise CorruptImage(f"TIFF tag {tag} points past the end of the file")
        return struct.unpack_from(f"{self.order}{count}{TYPES[kind]}", self.content, at)

    def one(self, tag: int, default: int | None = None) -> int:
        got = self.get(tag, () if default is None else (default,))
        if not got:
            raise CorruptImage(f"TIFF tag {tag} is missing")
        return got[0]

    def size(self) -> tuple[int, int]:
        width, height = self.one(WIDTH), self.one(HEIGHT)
        if width < 1 or height < 1:
            raise CorruptImage(f"TIFF size {width}x{height} is not valid")
        if width * height > MAX_PIXELS:
            raise ImageTooLarge(width, height, MAX_PIXELS)
        return width, height


def directory(content: bytes) -> Directory:
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if order is None or len(content) < 8:
        raise CorruptImage("TIFF header missing or truncated")
    magic, at = struct.unpack_from(order + "HI", content, 2)
    if magic == 43:
        raise UnsupportedFormat(content, "BigTIFF is not supported.")
    if magic != 42:
        raise CorruptImage(f"TIFF magic number is {magic}")
    if at + 2 > len(content):
        raise CorruptImage("TIFF directory lies past the end of the file")
    (n,) = struct.unpack_from(order + "H", content, at)
    if at + 2 + 12 * n > len(content):
        raise CorruptImage("TIFF directory is truncated")
    fields = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", content, at + 2 + 12 * k)
        if kind in TYPES:
            fields[tag] = (kind, count, at + 10 + 12 * k)
    return Directory(content, order, fields)


def probe(content: bytes) -> tuple[int, int]:
    return directory(content).size()


def unpack_lzw(data: bytes, expected: int) -> bytes:
    """Codes from the highest bit; they widen one code early."""
    table: list[bytes] = []
    out, held, bits, width, before = bytearray(), 0, 0, 9, b""
    start = [bytes([i]) for i in range(256)] + [b"", b""]
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == END or len(out) >= expected:
            break
        if code == CLEAR:
            table, width, before = list(start), 9, b""
            continue
        if not table:
            raise CorruptImage("TIFF LZW data does not begin with a clear code")
        if code < len(table):
            entry = table[code]
        elif code == len(table) and before:
            entry = before + before[:1]
        else:
            raise CorruptImage("TIFF LZW code out of range")
        out += entry
        if before and len(table) < 4096:
            table.append(before + entry[:1])
        before = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out[:expected])


def unpack_bits(data: bytes, expected: int) -> bytes:
    out, at = bytearray(), 0
    while len(out) < expected:
        if at >= len(data):
            raise CorruptImage("TIFF PackBits data is short")
        head = data[at] - 256 if data[at] > 127 else data[at]
        at += 1
        if head >= 0:
            out += data[at : at + head + 1]
            at += head + 1
            if at > len(data):
                raise CorruptImage("TIFF PackBits data is short")
        elif head != -128:
            if at >= len(data):
                raise CorruptImage("TIFF PackBits data is short")
            out += data[at : at + 1] * (1 - head)
            at += 1
    return bytes(out[:expected])


def decode(content: bytes) -> Raster:
    d = directory(content)
    width, height = d.size()
    if TILE_WIDTH in d.fields or TILE_OFFSETS in d.fields:
        raise UnsupportedFormat(content, "Tiled TIFF is not supported.")
    compression = d.one(COMPRESSION, 1)
    if compression not in (1, 5, 32773):
        raise UnsupportedFormat(content, f"TIFF compression {compression} is not supported.")
    n, all_bits = d.one(SAMPLES, 1), d.get(BITS, (1,))
    if not 1 <= n <= 64:
        raise CorruptImage(f"TIFF with {n} samples a pixel")
    bits = all_bits[0]
    if bits not in (1, 4, 8, 16) or len(set(all_bits)) > 1:
        raise UnsupportedFormat(content, f"TIFF with {all_bits} bits a sample is not supported.")
    if d.one(PLANAR, 1) != 1 and n > 1:
        raise UnsupportedFormat(content, "TIFF with a plane for each sample is not supported.")
    predictor = d.one(PREDICTOR, 1)
    if predictor not in (1, 2):
        raise UnsupportedFormat(content, f"TIFF predictor {predictor} is not supported.")
    if predictor == 2 and bits != 8:
        raise CorruptImage("TIFF predictor 2 goes with 8 bits a sample")
    row = (width * n * bits + 7) // 8
    rows = min(d.one(ROWS, height), height) or height
    offsets, counts = d.get(OFFSETS), d.get(COUNTS)
    strips = -(-height // rows)
    if len(offsets) < strips or len(counts) < strips:
        raise CorruptImage("TIFF has fewer strips than rows")
    parts = []
    for k in range(strips):
        expected = min(rows, height - k * rows) * row
        if offsets[k] + counts[k] > len(content):
            raise CorruptImage("TIFF strip runs past the end of the file")
        data = content[offsets[k] : offsets[k] + counts[k]]
        data = unpack_lzw(data, expected) if compression == 5 else unpack_bits(data, expected) if compression == 32773 else data[:expected]
        if len(data) < expected:
            raise CorruptImage("TIFF strip is short")
        parts.append(data)
    lines = np.frombuffer(b"".join(parts), np.uint8).reshape(height, row)
    if predictor == 2:
        lines = np.cumsum(lines.reshape(height, width, n), axis=1, dtype=np.uint8).reshape(height, row)
    return _rgba(d, lines, width, n, bits)


def _rgba(d: Directory, lines: np.ndarray, width: int, n: int, bits: int) -> Raster:
    height = len(lines)
    if bits == 16:
        raw = np.ascontiguousarray(lines).view(d.order + "u2").reshape(height, width, n).astype(np.int64)
    else:
        parts = np.unpackbits(lines, axis=1).reshape(height, -1, bits)[:, : width * n]
        raw = (parts @ (1 << np.arange(bits, dtype=np.int64)[::-1])).reshape(height, width, n)
    values = raw if bits == 8 else np.floor(raw / ((1 << bits) - 1) * 255 + 0.5).astype(np.int64)
    kind = d.one(PHOTOMETRIC)
    out = np.full((height, width, 4), 255, np.uint8)
    if kind == 3:
        entries = np.array(d.get(COLOUR_MAP), np.int64)
        if len(entries) < 3 << bits:
            raise CorruptImage("TIFF colour map is short")
        colours = np.floor(entries.reshape(3, -1) / 65535 * 255 + 0.5)
        index = raw[..., 0]
        if index.max() >= colours.shape[1]:
            raise CorruptImage("TIFF palette index out of range")
        out[..., :3] = np.moveaxis(colours[:, index], 0, -1)
    elif kind == 2:
        if n < 3:
            raise CorruptImage("TIFF in RGB has fewer than three samples a pixel")
        colour = values[..., :3]
        if n >= 4:
            alpha = values[..., 3]
            out[..., 3] = alpha
            if d.get(EXTRA)[:1] == (1,):  # colours were multiplied by it
                divided = np.minimum(255, np.floor(colour * 255 / np.maximum(alpha, 1)[..., None] + 0.5))
                colour = np.where(alpha[..., None] > 0, divided, colour)
        out[..., :3] = colour
    elif kind in (0, 1):
        grey = values[..., :1]
        out[..., :3] = 255 - grey if kind == 0 else grey
        if n >= 2:
            out[..., 3] = values[..., 1]
    else:
        raise UnsupportedFormat(d.content, f"TIFF PhotometricInterpretation {kind} is not supported.")
    return out


def pack_lzw(data: bytes) -> bytes:
    """LZW codes; a run is known by the code of all but its last byte."""
    table: dict[int, int] = {}
    free, width, run = FIRST, 9, -1
    codes, widths = [CLEAR], [9]
    for byte in data:
        if run < 0:
            run = byte
            continue
        longer = run << 8 | byte
        if (known := table.get(longer)) is not None:
            run = known
            continue
        codes.append(run)
        widths.append(width)
        table[longer], free = free, free + 1
        width = 9 if free < 512 else 10 if free < 1024 else 11 if free < 2048 else 12
        if free >= 4094:
            codes.append(CLEAR)
            widths.append(width)
            table.clear()
            free, width = FIRST, 9
        run = byte
    if run >= 0:
        codes.append(run)
        widths.append(width)
        # the reader has one entry more by now
        free += 1
        width = 9 if free < 512 else 10 if free < 1024 else 11 if free < 2048 else 12
    return high_first(np.array([*codes, END]), np.array([*widths, width]))


def encode(image: Raster, compression: str = "lzw") -> bytes:
    if compression not in ("lzw", "none"):
        raise InvalidOption("tiff.compression", compression, "must be 'none' or 'lzw'")
    height, width = image.shape[:2]
    alpha = has_alpha(image)
    n = 4 if alpha else 3
    data = np.ascontiguousarray(image[..., :n]).tobytes()
    packed = pack_lzw(data) if compression == "lzw" else data
    entries = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8] * n), (COMPRESSION, 3, [5 if compression == "lzw" else 1]), (PHOTOMETRIC, 3, [2]), (OFFSETS, 4, [0]), (SAMPLES, 3, [n]), (ROWS, 4, [height]), (COUNTS, 4, [len(packed)]), (PLANAR, 3, [1])] + [(EXTRA, 3, [2])] * alpha
    after = 8 + 2 + 12 * len(entries) + 4
    entries[5] = (OFFSETS, 4, [after + 2 * n])
    out, more = struct.pack("<2sHIH", b"II", 42, 8, len(entries)), b""
    for tag, kind, values in entries:
        value = struct.pack(f"<{len(values)}{TYPES[kind]}", *values)
        if len(value) > 4:
            value, more = struct.pack("<I", after + len(more)), more + value
        out += struct.pack("<HHI", tag, kind, len(values)) + value.ljust(4, b"\0")
    return out + struct.pack("<I", 0) + more + packed
