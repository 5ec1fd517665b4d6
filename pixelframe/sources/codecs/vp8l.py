"""Lossless WebP data (VP8L): reading whole, writing prefix-coded pixels."""

from __future__ import annotations

import heapq
import struct
from collections import Counter
from collections.abc import Callable

import numpy as np

from ...errors import CorruptImage
from ...operators.rasters import Raster
from .bits import low_first

SIGNATURE = 0x2F
# The order of code lengths' own lengths, symbols of the four channels and of distances, and the cache's multiplier.
ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LENGTHS, DISTANCES, LONGEST, MULTIPLIER = 24, 40, 15, 0x1E35A7BD
#: The places that short distances stand for, (left, up), nearest first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, -p[1], -p[0]))


class _Bits:
    """Numbers from the lowest bit on; zeros follow the end, and too many of them are an error."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data + b"\0" * 72, np.uint8).astype(np.int64)
        out = raw[: len(raw) - 6].copy()
        for k in range(1, 7):
            out |= raw[k : len(raw) - 6 + k] << (8 * k)
        self.windows, self.at, self.end = out.tolist(), 0, 8 * len(data)

    def take(self, n: int) -> int:
        if self.at > self.end:
            raise CorruptImage("WebP lossless data is short")
        value = self.windows[self.at >> 3] >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        return value


class _Code:
    """A prefix code: symbols by the next `width` bits."""

    def __init__(self, lengths: list[int]):
        used = [(n, s) for s, n in enumerate(lengths) if n]
        if not used:
            raise CorruptImage("WebP prefix code has no symbols")
        if len(used) == 1:
            self.width, self.table = 0, [used[0][1]]
            return
        self.width = max(n for n, _ in used)
        self.table, code, before = [-1] * (1 << self.width), 0, 0
        for n, symbol in sorted(used):
            code <<= n - before
            if code >> n:
                raise CorruptImage("WebP prefix code is not valid")
            begin = int(f"{code:0{n}b}"[::-1], 2)
            self.table[begin :: 1 << n] = [n << 16 | symbol] * (1 << (self.width - n))
            code, before = code + 1, n
        if code != 1 << before:
            raise CorruptImage("WebP prefix code is not complete")

    def read(self, bits: _Bits) -> int:
        if not self.width:
            return self.table[0]
        if bits.at > bits.end:
            raise CorruptImage("WebP lossless data is short")
        found = self.table[bits.windows[bits.at >> 3] >> (bits.at & 7) & ((1 << self.width) - 1)]
        bits.at += found >> 16
        return found & 0xFFFF


def _read_code(bits: _Bits, size: int) -> _Code:
    lengths = [0] * size
    if bits.take(1):
        two, wide = bits.take(1), bits.take(1)
        symbols = [bits.take(8 if wide else 1)]
        if two:
            symbols.append(bits.take(8))
        for symbol in symbols:
            if symbol >= size:
                raise CorruptImage("WebP prefix code names a symbol that is not there")
            lengths[symbol] = 1
        return _Code(lengths)
    own = [0] * 19
    for k in range(4 + bits.take(4)):
        own[ORDER[k]] = bits.take(3)
    code, most = _Code(own), size
    if bits.take(1):
        most = 2 + bits.take(2 + 2 * bits.take(3))
        if most > size:
            raise CorruptImage("WebP prefix code has too many symbols")
    at, before = 0, 8
    while at < size and most:
        most -= 1
        symbol = code.read(bits)
        if symbol < 16:
            lengths[at], at = symbol, at + 1
            before = symbol or before
            continue
        value, n = (before, 3 + bits.take(2)) if symbol == 16 else (0, 3 + bits.take(3)) if symbol == 17 else (0, 11 + bits.take(7))
        if at + n > size:
            raise CorruptImage("WebP prefix code has too many symbols")
        lengths[at : at + n] = [value] * n
        at += n
    return _Code(lengths)


def _value(bits: _Bits, prefix: int) -> int:
    """A length or distance from its prefix and the bits that follow."""
    if prefix < 4:
        return prefix + 1
    more = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << more) + bits.take(more) + 1


def _pixels(bits: _Bits, width: int, height: int, main: bool) -> np.ndarray:
    """(height, width) numbers of alpha, red, green and blue."""
    cache_bits = bits.take(4) if bits.take(1) else 0
    if cache_bits > 11:
        raise CorruptImage("WebP colour cache is too large")
    groups, of, shift = 1, None, 0
    if main and bits.take(1):
        shift = 2 + bits.take(3)
        of = _pixels(bits, (width + (1 << shift) - 1) >> shift, (height + (1 << shift) - 1) >> shift, False) >> 8 & 0xFFFF
        groups = int(of.max()) + 1
        of = of.tolist()
    cache = [0] * (1 << cache_bits) if cache_bits else []
    sizes = (256 + LENGTHS + len(cache), 256, 256, 256, DISTANCES)
    codes = [[_read_code(bits, n) for n in sizes] for _ in range(groups)]
    out, total, held = [0] * (width * height), width * height, 0
    at = x = y = 0
    green, red, blue, alpha, distance = codes[0]
    while at < total:
        if of is not None:
            green, red, blue, alpha, distance = codes[of[y >> shift][x >> shift]]
        symbol = green.read(bits)
        if symbol < 256:
            r = red.read(bits)
            b = blue.read(bits)
            out[at] = alpha.read(bits) << 24 | r << 16 | symbol << 8 | b
            n = 1
        elif symbol < 256 + LENGTHS:
            n, back = _value(bits, symbol - 256), _value(bits, distance.read(bits))
            back = back - len(NEAR) if back > len(NEAR) else max(1, NEAR[back - 1][0] + NEAR[back - 1][1] * width)
            if back > at or at + n > total:
                raise CorruptImage("WebP copies pixels that are not there")
            for k in range(at, at + n):
                out[k] = out[k - back]
        else:
            while held < at:  # only now is what went before needed
                cache[out[held] * MULTIPLIER >> (32 - cache_bits) & (len(cache) - 1)] = out[held]
                held += 1
            out[at], n = cache[symbol - 256 - LENGTHS], 1
        at += n
        x += n
        if x >= width:
            y, x = y + x // width, x % width
    return np.array(out, np.uint32).reshape(height, width)


def _channels(pixels: np.ndarray) -> np.ndarray:
    """(..., 4) of red, green, blue and alpha."""
    return np.stack([pixels >> s & 255 for s in (16, 8, 0, 24)], -1).astype(np.int32)


def _predicted(mode: int, left, up, up_right, up_left) -> list[int]:
    mean = lambda a, b: [(p + q) >> 1 for p, q in zip(a, b, strict=True)]
    cut = lambda v: [min(255, max(0, e)) for e in v]
    if mode == 11:
        by_left = sum(abs(u - c) for u, c in zip(up, up_left, strict=True))
        by_up = sum(abs(v - c) for v, c in zip(left, up_left, strict=True))
        return left if by_left < by_up else up
    if mode == 12:
        return cut(v + u - c for v, u, c in zip(left, up, up_left, strict=True))
    if mode == 13:
        halves = mean(left, up)
        return cut(h + int((h - c) / 2) for h, c in zip(halves, up_left, strict=True))
    known = {0: lambda: [0, 0, 0, 255], 1: lambda: left, 2: lambda: up, 3: lambda: up_right, 4: lambda: up_left, 5: lambda: mean(mean(left, up_right), up), 6: lambda: mean(left, up_left), 7: lambda: mean(left, up), 8: lambda: mean(up_left, up), 9: lambda: mean(up, up_right), 10: lambda: mean(mean(left, up_left), mean(up, up_right))}
    return known.get(mode, known[0])()


def _unpredicted(image: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    height, width = image.shape[:2]
    rows, modes = image.tolist(), modes.tolist()
    for y, row in enumerate(rows):
        above = rows[y - 1] if y else None
        for x, pixel in enumerate(row):
            if not y:
                guess = row[x - 1] if x else (0, 0, 0, 255)
            elif not x:
                guess = above[0]
            else:  # beyond the right edge stands the first pixel of this row
                guess = _predicted(modes[y >> shift][x >> shift], row[x - 1], above[x], above[x + 1] if x + 1 < width else row[0], above[x - 1])
            row[x] = [(p + g) & 255 for p, g in zip(pixel, guess, strict=True)]
    return np.array(rows, np.int32).reshape(height, width, 4)


def _signed(v: np.ndarray) -> np.ndarray:
    return (v ^ 128) - 128


def _recoloured(image: np.ndarray, shares: np.ndarray, shift: int) -> np.ndarray:
    height, width = image.shape[:2]
    share = np.repeat(np.repeat(shares, 1 << shift, 0), 1 << shift, 1)[:height, :width]
    red_to_blue, green_to_blue, green_to_red = (_signed(share[..., c]) for c in range(3))
    out = image.copy()
    green = _signed(image[..., 1])
    out[..., 0] = image[..., 0] + (green_to_red * green >> 5) & 255
    out[..., 2] = image[..., 2] + (green_to_blue * green >> 5) + (red_to_blue * _signed(out[..., 0]) >> 5) & 255
    return out


def decode(data: bytes) -> Raster:
    """The picture of a VP8L chunk."""
    bits = _Bits(data)
    if bits.take(8) != SIGNATURE:
        raise CorruptImage("WebP lossless data does not begin with its signature")
    width, height = bits.take(14) + 1, bits.take(14) + 1
    bits.take(1)
    if bits.take(3):
        raise CorruptImage("WebP lossless data has another version")
    undo: list[Callable[[np.ndarray], np.ndarray]] = []
    inner, seen = width, set()
    while bits.take(1):
        kind = bits.take(2)
        if kind in seen:
            raise CorruptImage("WebP transform comes twice")
        seen.add(kind)
        if kind < 2:
            shift = 2 + bits.take(3)
            part = _channels(_pixels(bits, (inner + (1 << shift) - 1) >> shift, (height + (1 << shift) - 1) >> shift, False))
            undo.append((lambda im, p=part, s=shift: _unpredicted(im, p[..., 1] & 15, s)) if kind == 0 else (lambda im, p=part, s=shift: _recoloured(im, p, s)))
        elif kind == 2:
            undo.append(lambda im: np.stack([im[..., 0] + im[..., 1] & 255, im[..., 1], im[..., 2] + im[..., 1] & 255, im[..., 3]], -1))
        else:
            n = bits.take(8) + 1
            colours = np.cumsum(_channels(_pixels(bits, n, 1, False))[0], axis=0) & 255
            packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0

            def indexed(im: np.ndarray, colours=colours, packed=packed, to=inner) -> np.ndarray:
                each = 8 >> packed
                index = np.stack([im[..., 1] >> (each * k) & ((1 << each) - 1) for k in range(1 << packed)], -1).reshape(len(im), -1)[:, :to]
                table = np.zeros((256, 4), np.int32)  # what the table lacks is clear
                table[: len(colours)] = colours
                return table[index]

            undo.append(indexed)
            inner = (inner + (1 << packed) - 1) >> packed
    image = _channels(_pixels(bits, inner, height, True))
    for step in reversed(undo):
        image = step(image)
    if bits.at > bits.end + 64:
        raise CorruptImage("WebP lossless data is short")
    return image.astype(np.uint8)


def code_lengths(counts: Counter, size: int) -> list[int]:
    """Lengths of a prefix code for what is counted, of at most LONGEST bits."""
    out = [0] * size
    heap = [(n, s, (s,)) for s, n in counts.items()]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            out[s] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    if max(out) > LONGEST:  # counts nearer to each other give a flatter code
        return code_lengths(Counter({s: 1 + n // 2 for s, n in counts.items()}), size)
    return out


def _numbers(image: Raster) -> np.ndarray:
    """What a VP8L chunk holds of a picture: numbers and how many bits each takes. The four channels of each pixel have prefix
    codes of their own."""
    height, width = image.shape[:2]
    text: list[tuple[int, int]] = [(SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (int((image[..., 3] < 255).any()), 1), (0, 3), (0, 1), (0, 1), (0, 1)]
    tables = []
    for channel, size in ((1, 256 + LENGTHS), (0, 256), (2, 256), (3, 256)):
        counts = Counter(dict(zip(*(v.tolist() for v in np.unique(image[..., channel], return_counts=True)), strict=True)))
        table = np.zeros((2, 256), np.int64)
        if len(counts) <= 2:
            symbols = sorted(counts)
            text += [(1, 1), (len(symbols) - 1, 1), (1, 1), *((s, 8) for s in symbols)]
            for code, s in enumerate(symbols):
                table[:, s] = code, len(symbols) - 1
        else:
            lengths = code_lengths(counts, size)
            # lengths 0 to 15 are written in four bits each, in the order of their values
            text += [(0, 1), (15, 4), *((0 if k > 15 else 4, 3) for k in ORDER), (0, 1), *((int(f"{n:04b}"[::-1], 2), 4) for n in lengths)]
            code = before = 0
            for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
                code <<= n - before
                table[:, s] = int(f"{code:0{n}b}"[::-1], 2), n
                code, before = code + 1, n
        tables.append(table)
    text += [(1, 1), (0, 1), (0, 1), (0, 1)]  # distances: one symbol that is never used
    head = np.array(text, np.int64).T
    body = np.stack([np.stack([tables[k][j][image[..., c].reshape(-1)] for k, c in enumerate((1, 0, 2, 3))], -1).reshape(-1) for j in range(2)])
    return np.concatenate([head, body], 1)


def encode(image: Raster) -> bytes:
    """A VP8L chunk's data."""
    return low_first(*_numbers(image))


def wrapped(data: bytes) -> bytes:
    """A whole file around a chunk's data."""
    chunk = b"VP8L" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def find(content: bytes) -> bytes | None:
    """The data of a file's lossless chunk, of a still picture; None where it has none."""
    at = 12
    while at + 8 <= len(content):
        kind, (size,) = content[at : at + 4], struct.unpack_from("<I", content, at + 4)
        if kind == b"VP8L":
            return content[at + 8 : at + 8 + size]
        if kind not in (b"VP8X", b"ICCP", b"EXIF", b"XMP "):
            return None
        at += 8 + size + size % 2
    return None
