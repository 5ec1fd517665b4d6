"""GIF: the first frame on its screen; writes one frame with a palette by median cut, dithered where colours are lost."""

from __future__ import annotations

import struct

import numpy as np

from ...errors import CorruptImage, ImageTooLarge, InvalidOption, is_integer
from ...operators.rasters import Raster
from ...plans.geometry import MAX_PIXELS
from .bits import low_first

#: First row and step of the passes of an interlaced frame.
PASSES = ((0, 8), (4, 8), (2, 4), (1, 2))
#: Distances of colours that a picture may take without a table of all colours, which has 32 MB.
DISTANCES = 1 << 18
#: Alpha from here on is opaque.
OPAQUE = 128


def probe(content: bytes) -> tuple[int, int]:
    if content[:6] not in (b"GIF87a", b"GIF89a"):
        raise CorruptImage("GIF signature missing")
    if len(content) < 13:
        raise CorruptImage("GIF header truncated")
    width, height = struct.unpack_from("<HH", content, 6)
    if not width or not height:
        raise CorruptImage(f"GIF size {width}x{height} is not valid")
    if width * height > MAX_PIXELS:
        raise ImageTooLarge(width, height, MAX_PIXELS)
    return width, height


class _Reader:
    def __init__(self, content: bytes, at: int):
        self.content, self.at = content, at

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.content):
            raise CorruptImage("GIF is truncated")
        self.at += n
        return self.content[self.at - n : self.at]

    def blocks(self) -> bytes:
        out = []
        while n := self.take(1)[0]:
            out.append(self.take(n))
        return b"".join(out)


def decode(content: bytes) -> Raster:
    width, height = probe(content)
    reader = _Reader(content, 13)
    flags = content[10]
    shared = reader.take(3 << (flags & 7) + 1) if flags & 0x80 else None
    transparent = None
    while True:
        kind = reader.take(1)[0]
        if kind == 0x21:
            label, data = reader.take(1)[0], reader.blocks()
            if label == 0xF9 and len(data) >= 4:
                transparent = data[3] if data[0] & 1 else None
        elif kind == 0x2C:
            break
        elif kind == 0x3B:
            raise CorruptImage("GIF has no frame")
        else:
            raise CorruptImage(f"GIF block {kind:#x} is not known")
    left, top, w, h, flags = struct.unpack("<HHHHB", reader.take(9))
    if not w or not h:
        raise CorruptImage(f"GIF frame of {w}x{h} is not valid")
    if w * h > MAX_PIXELS:
        raise ImageTooLarge(w, h, MAX_PIXELS)
    table = reader.take(3 << (flags & 7) + 1) if flags & 0x80 else shared
    if table is None:
        raise CorruptImage("GIF frame has no colour table")
    least = reader.take(1)[0]
    if not 2 <= least <= 11:
        raise CorruptImage(f"GIF code size {least} is not valid")
    index = np.frombuffer(unpack(reader.blocks(), least, w * h), np.uint8).reshape(h, w)
    if flags & 0x40:
        rows = np.concatenate([np.arange(first, h, step) for first, step in PASSES])
        index = index[np.argsort(rows)]
    colours = np.frombuffer(table, np.uint8).reshape(-1, 3)
    shown = np.ones(index.shape, bool) if transparent is None else index != transparent
    if (index[shown] >= len(colours)).any():
        raise CorruptImage("GIF colour index out of range")
    frame = np.zeros((h, w, 4), np.uint8)
    frame[shown] = np.hstack([colours, np.full((len(colours), 1), 255, np.uint8)])[index[shown]]
    out = np.zeros((height, width, 4), np.uint8)
    part = out[top : top + h, left : left + w]
    part[:] = frame[: part.shape[0], : part.shape[1]]
    return out


def unpack(data: bytes, least: int, expected: int) -> bytes:
    """LZW codes from the lowest bit; the table stops at 4096 entries."""
    clear, end = 1 << least, (1 << least) + 1
    start = [bytes([i & 255]) for i in range(clear)] + [b"", b""]
    table, width, before = list(start), least + 1, b""
    out, held, bits = bytearray(), 0, 0
    for byte in data:
        held, bits = held | byte << bits, bits + 8
        while bits >= width:
            code = held & ((1 << width) - 1)
            held, bits = held >> width, bits - width
            if code == clear:
                table, width, before = list(start), least + 1, b""
                continue
            if code == end or len(out) >= expected:
                bits = -1
                break
            if code < len(table):
                entry = table[code]
            elif code == len(table) and before:
                entry = before + before[:1]
            else:
                raise CorruptImage("GIF code out of range")
            out += entry
            if before and len(table) < 4096:
                table.append(before + entry[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            before = entry
        if bits < 0:
            break
    if len(out) < expected:
        raise CorruptImage("GIF frame data is short")
    if len(out) > expected:
        raise CorruptImage("GIF frame data is long")
    return bytes(out)


def histogram(image: Raster) -> np.ndarray:
    """(r, g, b, count) of the opaque colours, in the order in which they are first seen; black where there are none."""
    opaque = image[image[..., 3] >= OPAQUE][:, :3].astype(np.int64)
    if not len(opaque):
        return np.array([[0, 0, 0, 1]])
    colours, first, count = np.unique(opaque, axis=0, return_index=True, return_counts=True)
    order = np.argsort(first)
    return np.hstack([colours, count[:, None]])[order]


def _spread(box: np.ndarray) -> tuple[int, int]:
    """(axis, range) of a box's longest side, the first of equals."""
    span = box[:, :3].max(0) - box[:, :3].min(0)
    return int(np.argmax(span)), int(span.max())


def median_cut(colours: np.ndarray, budget: int) -> np.ndarray:
    """Mean colours of boxes, the longest of which is halved by weight until there are enough."""
    boxes = [colours]
    while len(boxes) < budget:
        ranges = [_spread(b)[1] if len(b) > 1 else 0 for b in boxes]
        at = int(np.argmax(ranges))
        if not ranges[at]:
            break
        box = boxes[at]
        box = box[np.argsort(box[:, _spread(box)[0]], kind="stable")]
        running = np.cumsum(box[:-1, 3])
        enough = np.flatnonzero(2 * running >= box[:, 3].sum())
        cut = int(enough[0]) + 1 if len(enough) else len(box) - 1
        boxes[at : at + 1] = [box[:cut], box[cut:]]
    return np.array([np.floor((b[:, :3] * b[:, 3:]).sum(0) / b[:, 3].sum() + 0.5) for b in boxes]).astype(np.int64)


def _nearest(image: Raster, palette: np.ndarray) -> np.ndarray:
    colours, back = np.unique(image[..., :3].reshape(-1, 3).astype(np.int64), axis=0, return_inverse=True)
    best = np.concatenate([((part[:, None] - palette[None]) ** 2).sum(2).argmin(1) for part in np.array_split(colours, -(-len(colours) // 4096))])
    return best[back.ravel()].reshape(image.shape[:2])


class _Places:
    """The nearest palette entry of colours, each worked out when it first comes; for pictures that need fewer distances than
    what is remembered takes to lay out, whenever it comes."""

    def __init__(self, palette: np.ndarray, pixels: int):
        self.palette, self.known = palette, np.full(1 << 24, -1, np.int16) if pixels * len(palette) > DISTANCES else None

    def of(self, colours: np.ndarray) -> np.ndarray:
        if self.known is None:
            return ((colours[:, None] - self.palette[None]) ** 2).sum(2).argmin(1)
        key = colours[:, 0] << 16 | colours[:, 1] << 8 | colours[:, 2]
        found = self.known[key]
        if (found < 0).any():
            fresh = np.unique(key[found < 0])
            for part in np.array_split(fresh, -(-len(fresh) // 4096)):
                apart = np.stack([part >> 16, part >> 8 & 255, part & 255], 1)[:, None] - self.palette[None]
                self.known[part] = (apart**2).sum(2).argmin(1)
            found = self.known[key]
        return found.astype(np.int64)


def _dithered(image: Raster, palette: np.ndarray, clear: np.ndarray) -> np.ndarray:
    """Each pixel's error goes to its neighbours: 7 to the right, 3, 5 and 1 sixteenths below. A pixel needs the one to its left
    and three above, which lie on the slanted lines x + 2y before its own, so a whole line is one step. Errors come to
    a pixel in the order of a scan: from above left, above, above right, and the left."""
    h, w = image.shape[:2]
    work = np.zeros((h + 1, w + 2, 3), np.float32)
    work[:h, 1 : w + 1] = image[..., :3]
    flat, out, places = work.reshape(-1, 3), np.zeros((h, w), np.int64), _Places(palette, h * w)
    shown, index = ~clear.reshape(-1), out.reshape(-1)
    for t in range(w + 2 * (h - 1)):
        y = np.arange(max(0, -(-(t - w + 1) // 2)), min(h - 1, t // 2) + 1)
        x = t - 2 * y
        mine = y * w + x
        y, x, mine = y[shown[mine]], x[shown[mine]], mine[shown[mine]]
        at = y * (w + 2) + x + 1
        want = np.floor(np.clip(flat[at], 0, 255).astype(float) + 0.5)
        index[mine] = k = places.of(want.astype(np.int64))
        error = want - palette[k]
        for step, share in ((w + 1, 3), (1, 7), (w + 2, 5), (w + 3, 1)):
            flat[at + step] += error * (share / 16)
    return out


def quantise(image: Raster, colors: int, dither: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Palette, indices, and whether the palette's last entry is for clear pixels."""
    clear = image[..., 3] < OPAQUE
    see_through = bool(clear.any())
    budget = max(1, colors - see_through)
    found = histogram(image)
    palette = median_cut(found, budget)
    index = _dithered(image, palette, clear) if dither and len(found) > budget else _nearest(image, palette)
    if see_through:
        index = np.where(clear, len(palette), index)
        palette = np.vstack([palette, [[0, 0, 0]]])
    return palette, index, see_through


def pack(index: bytes, least: int) -> bytes:
    """LZW codes; a full table starts anew. A run is known by the code of all but its last value."""
    clear, end = 1 << least, (1 << least) + 1
    table: dict[int, int] = {}
    free, width, run = end + 1, least + 1, -1
    codes, widths = [clear], [width]
    for value in index:
        if run < 0:
            run = value
            continue
        longer = run << 8 | value
        if (known := table.get(longer)) is not None:
            run = known
            continue
        codes.append(run)
        widths.append(width)
        if free < 4096:
            table[longer], free = free, free + 1
            if free > 1 << width and width < 12:
                width += 1
        else:
            codes.append(clear)
            widths.append(width)
            table.clear()
            free, width = end + 1, least + 1
        run = value
    if run >= 0:
        codes.append(run)
        widths.append(width)
        if free < 4096 and free + 1 > 1 << width and width < 12:
            width += 1
    return low_first(np.array([*codes, end]), np.array([*widths, width]))


def encode(image: Raster, colors: int = 256, dither: bool = True) -> bytes:
    if not is_integer(colors) or not 2 <= colors <= 256:
        raise InvalidOption("gif.colors", colors, "must be an integer from 2 to 256")
    height, width = image.shape[:2]
    if max(height, width) > 65535:
        raise InvalidOption("gif.size", [width, height], "must not exceed 65535")
    palette, index, see_through = quantise(image, int(colors), dither)
    depth = max(1, int(len(palette) - 1).bit_length())
    table = np.zeros((1 << depth, 3), np.uint8)
    table[: len(palette)] = palette
    out = b"GIF89a" + struct.pack("<HHBBB", width, height, 0xF0 | depth - 1, 0, 0) + table.tobytes()
    if see_through:
        out += struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1, 0, len(palette) - 1, 0)
    data = pack(index.astype(np.uint8).tobytes(), max(2, depth))
    parts = b"".join(bytes([len(data[k : k + 255])]) + data[k : k + 255] for k in range(0, len(data), 255))
    return out + struct.pack("<BHHHHB", 0x2C, 0, 0, width, height, 0) + bytes([max(2, depth)]) + parts + b"\0\x3b"
