"""Queries over files of all kinds, each with the SQL that gives the same rows.

The files are put together from the numbers of `part`, byte by byte as their formats say and not by the engine's own writers,
so that readers are held against the pixels that went in; SQL states these from the same numbers. A picture's sample at
(y, x) in channel c is (31 k + 3 s + 17 y + 7 x + 5 c) mod 256, with k and s the part's key and size, unless said otherwise.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .errors import ImageError
from .functions import numerics as N
from .functions import udfs
from .operators import rasters as R
from .plans.spec import Builder
from .queries import GREY, RGBA, SQL, _files, _table, grey, query, rgba, sql_clamp
from .sources import images
from .sources.codecs import jpeg, webp
from .streaming import arrivals

Make = Callable[[int, int], bytes]
#: Width and height of most pictures.
W, H = 5, 3


def built(spark: SparkSession, sf_dir: str, make: Make, table: str = "part", key: str = "p_partkey", size: str = "p_size") -> DataFrame:
    """image_id and content: a file for each row, from its key and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [make(k.as_py(), s.as_py()) for k, s in zip(batch.column(0), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["image_id", "content"])

    rows = _table(spark, sf_dir, table).select(F.col(key).cast("long").alias("k"), F.col(size).cast("long").alias("s"))
    return images.fused(images.spread(rows, rows.count()), run, "image_id long, content binary")


def sample(k: int, s: int, y: int, x: int, c: int = 0) -> int:
    return (31 * k + 3 * s + 17 * y + 7 * x + 5 * c) % 256


def sql_sample(c: int = 0) -> str:
    return f"((31 * k + 3 * s + 17 * y + 7 * x + {5 * c}) % 256)"


def sql_pixels(r: str, g: str, b: str, a: str = "255", width: int = W, height: int = H) -> str:
    """Channels as SQL over k, s, y and x."""
    at = f"SELECT p_partkey AS image_id, p_partkey::BIGINT AS k, p_size::BIGINT AS s, (i // {width})::INT AS y, (i % {width})::INT AS x FROM (SELECT p_partkey, p_size, unnest(range({width * height})) AS i FROM part)"
    return f"SELECT image_id, y, x, ({r})::INT AS r, ({g})::INT AS g, ({b})::INT AS b, ({a})::INT AS a FROM ({at})"


def pictures(name: str, make: Make, sql: str, **options) -> None:
    query(name, sql)(lambda spark, sf_dir: images.to_pixels(images.decode(built(spark, sf_dir, make), **options)))


def grid(k: int, s: int, c: tuple[int, ...] = (0,), width: int = W, height: int = H) -> list[list[int]]:
    """Rows of samples, the channels of a pixel side by side."""
    first = sample(k, s, 0, 0)
    return [[(first + v) % 256 for v in row] for row in _steps(c, tuple(range(width)), tuple(range(height)))]


@lru_cache(64)
def _steps(c: tuple[int, ...], columns: tuple[int, ...], rows: tuple[int, ...]) -> list[list[int]]:
    """What a sample has more than the first one."""
    return [[sample(0, 0, y, x, i) for x in columns for i in c] for y in rows]


_OPAQUE = tuple(sql_sample(c) for c in range(3))
_ALL = tuple(sql_sample(c) for c in range(4))


# PNG.


def png(width: int, height: int, depth: int, colour: int, lines: bytes, interlace: int = 0, more: bytes = b"", parts: int = 1) -> bytes:
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    packed = zlib.compress(lines)
    step = -(-len(packed) // parts)
    data = b"".join(chunk(b"IDAT", packed[at : at + step]) for at in range(0, len(packed), step))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlace)) + b"".join(chunk(more[at + 4 : at + 8], more[at + 8 : at + 8 + int.from_bytes(more[at : at + 4])]) for at in _starts(more)) + data + chunk(b"IEND", b"")


def _starts(more: bytes) -> list[int]:
    """Where each (length, type, data) begins."""
    out, at = [], 0
    while at < len(more):
        out.append(at)
        at += 8 + int.from_bytes(more[at : at + 4])
    return out


def bits(values: list[int], depth: int) -> bytes:
    """Numbers of `depth` bits, the highest bits first, to whole bytes."""
    text = "".join(f"{v:0{depth}b}" for v in values)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8)


def plain(rows: list[bytes]) -> bytes:
    return b"".join(b"\0" + r for r in rows)


def filtered(rows: list[bytes], step: int, first: int) -> bytes:
    """Rows under the five filters in turn."""
    out, above = [], bytes(len(rows[0]))
    for y, row in enumerate(rows):
        kind, left = (first + y) % 5, bytes(step) + row
        if kind == 0:
            line = row
        elif kind == 1:
            line = bytes([(v - a) & 255 for v, a in zip(row, left)])
        elif kind == 2:
            line = bytes([(v - b) & 255 for v, b in zip(row, above)])
        elif kind == 3:
            line = bytes([(v - (a + b) // 2) & 255 for v, a, b in zip(row, left, above)])
        else:
            line = bytes([(v - _near(a, b, c)) & 255 for v, a, b, c in zip(row, left, above, bytes(step) + above)])
        out += [bytes([kind]), line]
        above = row
    return b"".join(out)


def _near(a: int, b: int, c: int) -> int:
    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
    return a if pa <= pb and pa <= pc else b if pb <= pc else c


def _png_grey(k: int, s: int) -> bytes:
    depth = 1 << k % 4
    return png(W, H, depth, 0, plain([bits([v % (1 << depth) for v in row], depth) for row in grid(k, s)]))


_GREY_DEPTH = f"floor({sql_sample()} % (1 << (1 << (k % 4)::INT)) * 255::DOUBLE / ((1 << (1 << (k % 4)::INT)) - 1) + 0.5::DOUBLE)"
pictures("png_grey_depths", _png_grey, sql_pixels(*(_GREY_DEPTH,) * 3))
pictures("png_grey_alpha", lambda k, s: png(W, H, 8, 4, plain([bytes(r) for r in grid(k, s, (0, 1))])), sql_pixels(*(sql_sample(),) * 3, sql_sample(1)))
pictures("png_16_bit", lambda k, s: png(W, H, 16, 6, plain([b"".join(bytes([v, 3 * v % 256]) for v in r) for r in grid(k, s, (0, 1, 2, 3))])), sql_pixels(*_ALL))


def _png_palette(k: int, s: int) -> bytes:
    colours = b"".join(bytes([(16 * j + k) % 256, 7 * j, 255 - 9 * j]) for j in range(16))
    more = struct.pack(">I", 48) + b"PLTE" + colours + struct.pack(">I", 5) + b"tRNS" + bytes(50 * j for j in range(5))
    return png(W, H, 4, 3, plain([bits([v % 16 for v in row], 4) for row in grid(k, s)]), more=more)


_J = f"({sql_sample()} % 16)"
pictures("png_palette", _png_palette, sql_pixels(f"(16 * {_J} + k) % 256", f"7 * {_J}", f"255 - 9 * {_J}", f"CASE WHEN {_J} < 5 THEN 50 * {_J} ELSE 255 END"))


def _png_interlaced(k: int, s: int) -> bytes:
    """Nine by nine in seven passes: where each begins, and its steps."""
    lines, at = b"", sample(k, s, 0, 0)
    for x0, y0, dx, dy in ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)):
        rows = [bytes([(at + v) % 256 for v in row]) for row in _steps((0, 1, 2, 3), tuple(range(x0, 9, dx)), tuple(range(y0, 9, dy)))]
        lines += filtered(rows, 4, k)
    return png(9, 9, 8, 6, lines, 1)


pictures("png_interlaced", _png_interlaced, sql_pixels(*_ALL, 9, 9))
pictures("png_filters", lambda k, s: png(7, 6, 8, 2, filtered([bytes(r) for r in grid(k, s, (0, 1, 2), 7, 6)], 3, k)), sql_pixels(*_OPAQUE, "255", 7, 6))
pictures("png_data_in_parts", lambda k, s: png(W, H, 8, 2, plain([bytes(r) for r in grid(k, s, (0, 1, 2))]), parts=4), sql_pixels(*_OPAQUE))


# TIFF.


def tiff(order: str, tags: list[tuple[int, str, list[int]]], strips: list[bytes], after: bytes = b"") -> bytes:
    """Strips first, then the directory; numbers that don't fit into an entry follow it. `after` is a further directory's
    place of no use to a reader of the first picture."""
    places, data = [], b""
    for strip in strips:
        places.append(8 + len(data))
        data += strip
    data += b"\0" * (len(data) % 2)
    tags = sorted([*tags, (273, "I", places), (279, "I", [len(x) for x in strips])])
    at = 8 + len(data)
    entries, extra = b"", b""
    for tag, kind, values in tags:
        packed = struct.pack(f"{order}{len(values)}{kind}", *values)
        if len(packed) > 4:
            place = at + 2 + 12 * len(tags) + 4 + len(extra)
            extra += packed + b"\0" * (len(packed) % 2)
            packed = struct.pack(f"{order}I", place)
        entries += struct.pack(f"{order}HHI", tag, {"H": 3, "I": 4}[kind], len(values)) + packed.ljust(4, b"\0")
    following = at + 2 + 12 * len(tags) + 4 + len(extra) if after else 0
    return {"<": b"II", ">": b"MM"}[order] + struct.pack(f"{order}HI", 42, at) + data + struct.pack(f"{order}H", len(tags)) + entries + struct.pack(f"{order}I", following) + extra + after


def _tags(photometric: int, n: int, depth: int, rows: int = H, compression: int = 1, **more: int) -> list[tuple[int, str, list[int]]]:
    known = {"planar": 284, "predictor": 317, "tile": 322, "extra": 338}
    return [(256, "I", [W]), (257, "I", [H]), (258, "H", [depth] * n), (259, "H", [compression]), (262, "H", [photometric]), (277, "H", [n]), (278, "I", [rows])] + [(known[k], "H", [v]) for k, v in more.items()]


def pack_bits(row: bytes) -> bytes:
    """The first two bytes as they are, the last as a run of one, the rest as they are, and a code of no effect between."""
    return bytes([1]) + row[:2] + bytes([128]) + bytes([len(row) - 4]) + row[2:-1] + bytes([0]) + row[-1:]


def _tiff_packbits(k: int, s: int) -> bytes:
    """RGB in two strips, each row packed by itself; the last one's equal bytes as a run."""
    rows = [bytes(r) for r in grid(k, s, (0, 1, 2))[:2]] + [bytes([k % 256]) * 15]
    return tiff(">", _tags(2, 3, 8, 2, 32773), [b"".join(map(pack_bits, rows[:2])), bytes([256 - 14]) + rows[2][:1]])


_RUN = tuple(f"CASE WHEN y < 2 THEN {e} ELSE k % 256 END" for e in _OPAQUE)
pictures("tiff_packbits", _tiff_packbits, sql_pixels(*_RUN))
pictures("tiff_grey_16_bit", lambda k, s: tiff("<" if k % 2 else ">", _tags(k % 2, 1, 16, 1), [struct.pack(f"{'<' if k % 2 else '>'}{W}H", *(257 * v for v in r)) for r in grid(k, s)]), sql_pixels(*(f"CASE WHEN k % 2 = 0 THEN 255 - {sql_sample()} ELSE {sql_sample()} END",) * 3))
pictures("tiff_palette", lambda k, s: tiff("<", [*_tags(3, 1, 4), (320, "H", [4369 * j for j in range(16)] + [1000 * j for j in range(16)] + [65535 - 4369 * j for j in range(16)])], [b"".join(bits([v % 16 for v in r], 4) for r in grid(k, s))]), sql_pixels(f"17 * {_J}", f"floor(1000 * {_J} / 65535::DOUBLE * 255::DOUBLE + 0.5::DOUBLE)", f"255 - 17 * {_J}"))
pictures("tiff_first_directory", lambda k, s: tiff("<", _tags(1, 1, 8), [b"".join(map(bytes, grid(k, s)))], struct.pack("<HHHII", 1, 256, 4, 1, 99) + b"\0" * 4), sql_pixels(*(sql_sample(),) * 3))


def _difference(row: list[int], n: int) -> bytes:
    return bytes((v - (row[i - n] if i >= n else 0)) % 256 for i, v in enumerate(row))


pictures("tiff_predictor_file", lambda k, s: tiff("<", _tags(2, 4, 8, 1, predictor=2, extra=2), [_difference(r, 4) for r in grid(k, s, (0, 1, 2, 3))]), sql_pixels(*_ALL))

_REFUSED = ({"tile": 16}, {"compression": 7}, {"planar": 2}, {"predictor": 3}, {"predictor": 2, "depth": 16}, {})


def _tiff_refused(k: int, s: int) -> bytes:
    how = dict(_REFUSED[k % 6])
    depth = how.pop("depth", 8)
    return tiff("<", _tags(2, 3, depth, H, how.pop("compression", 1), **how), [bytes(3 * W * H * depth // 8)])


@query("tiff_refused", "SELECT p_partkey AS image_id, CASE p_partkey % 6 WHEN 4 THEN 'CORRUPT_IMAGE' WHEN 5 THEN NULL ELSE 'UNSUPPORTED_FORMAT' END AS code FROM part")
def tiff_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles, JPEG inside, planes, a predictor of floats; a predictor that its depth doesn't go with; and a good one."""
    return images.decode(built(spark, sf_dir, _tiff_refused)).select("image_id", F.col("error.code").alias("code"))


# BMP.


def bmp(depth: int, lines: list[bytes], palette: bytes = b"", compression: int = 0, masks: bytes = b"", down: bool = False) -> bytes:
    rows = [x + b"\0" * (-len(x) % 4) for x in (lines if down else lines[::-1])]
    at = 54 + len(masks) + len(palette)
    return b"BM" + struct.pack("<IHHI", at + sum(map(len, rows)), 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, W, -H if down else H, 1, depth, compression, 0, 0, 0, len(palette) // 4, 0) + masks + palette + b"".join(rows)


def _bmp_palette(k: int, s: int) -> bytes:
    depth = (1, 4, 8)[k % 3]
    palette = b"".join(bytes([j, (j + k) % 256, 255 - j, 0]) for j in range(1 << depth))
    return bmp(depth, [bits([v % (1 << depth) for v in r], depth) for r in grid(k, s)], palette, down=k % 2 == 0)


_B = f"({sql_sample()} % (1 << [1, 4, 8][(k % 3 + 1)::INT]))"
pictures("bmp_palette", _bmp_palette, sql_pixels(f"255 - {_B}", f"({_B} + k) % 256", _B))
_FIVE = tuple(f"floor(({e} % 32) / 31::DOUBLE * 255::DOUBLE + 0.5::DOUBLE)" for e in _OPAQUE)
_five = lambda k, s, y, x: [sample(k, s, y, x, c) % 32 for c in range(3)]
pictures("bmp_16_bit", lambda k, s: bmp(16, [b"".join(struct.pack("<H", r << 10 | g << 5 | b) for r, g, b in (_five(k, s, y, x) for x in range(W))) for y in range(H)]), sql_pixels(*_FIVE))
pictures("bmp_masks", lambda k, s: bmp(32, [b"".join(struct.pack("<I", sample(k, s, y, x) | sample(k, s, y, x, 1) << 8 | sample(k, s, y, x, 2) << 16) for x in range(W)) for y in range(H)], b"", 3, struct.pack("<III", 0xFF, 0xFF00, 0xFF0000)), sql_pixels(*_OPAQUE))


# GIF.


def gif_data(values: list[int]) -> bytes:
    """Numbers below 128 in codes of a byte each: the table is cleared before codes would widen."""
    codes = []
    for at in range(0, len(values), 100):
        codes += [128, *values[at : at + 100]]
    codes.append(129)
    return bytes([7]) + b"".join(bytes([len(part)]) + bytes(part) for part in (codes[at : at + 255] for at in range(0, len(codes), 255))) + b"\0"


def _gif_frames(k: int, s: int) -> bytes:
    """A screen of 5 x 3, a first frame of 3 x 2 at (1, 1), interlaced or not, whose colour 3 is clear, and a second frame."""
    colours = b"".join(bytes([j, 2 * j % 256, (j + k) % 256]) for j in range(128))
    rows = [[v % 128 for v in r] for r in grid(k, s, width=3, height=2)]
    head = b"GIF89a" + struct.pack("<HHBBB", W, H, 0x86 | 0x80, 0, 0) + colours
    control = bytes((0x21, 0xF9, 4, 1, 0, 0, 3, 0))
    frame = lambda data, flags: struct.pack("<BHHHHB", 0x2C, 1, 1, 3, 2, flags) + gif_data(data)
    return head + control + frame(rows[0] + rows[1], 0x40 * (k % 2)) + frame([1] * 6, 0) + b"\x3b"


_G = "((31 * k + 3 * s + 17 * (y - 1) + 7 * (x - 1)) % 256 % 128)"
_SHOWN = f"y >= 1 AND x BETWEEN 1 AND 3 AND {_G} <> 3"
pictures("gif_first_frame", _gif_frames, sql_pixels(*(f"CASE WHEN {_SHOWN} THEN {e} ELSE 0 END" for e in (_G, f"2 * {_G} % 256", f"({_G} + k) % 256", "255"))))

#: Grey pictures through a GIF of few colours: the box of all colours is halved by weight, at the first colour by which half of the
#: pixels are reached; a box's colour is its mean, and pixels take the nearest, the first of equals.
_SPLIT = f"""
WITH p AS MATERIALIZED ({GREY}), h AS (SELECT image_id, r AS v, count(*) AS n FROM p GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY image_id ORDER BY v) AS run, sum(n) OVER (PARTITION BY image_id) AS total, row_number() OVER (PARTITION BY image_id ORDER BY v DESC) AS from_end FROM h),
c AS (SELECT image_id, coalesce(min(v) FILTER (WHERE 2 * run >= total AND from_end > 1), max(v) FILTER (WHERE from_end = 2), max(v)) AS cut FROM r GROUP BY 1),
b AS (SELECT r.*, CASE WHEN v <= cut THEN 0 ELSE 1 END AS box FROM r JOIN c USING (image_id))"""
_MEAN = "floor(sum(v * n)::DOUBLE / sum(n) + 0.5::DOUBLE)::INT"


def few_colours(name: str, colors: int, dither: bool, sql: str, step=lambda p: p) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return images.to_pixels(images.decode(_files(spark, sf_dir, lambda s, f: step(grey(s, f)), "gif", colors=colors, dither=dither)))

    query(name, sql)(run)


_PICKED = "SELECT p.image_id, p.y, p.x, {v} AS r, {v} AS g, {v} AS b, 255 AS a FROM p JOIN q USING (image_id)"
few_colours("gif_two_colours", 2, False, _SPLIT + f""",
m AS (SELECT image_id, box, {_MEAN} AS colour FROM b GROUP BY 1, 2),
q AS (SELECT image_id, max(colour) FILTER (WHERE box = 0) AS c0, coalesce(max(colour) FILTER (WHERE box = 1), 9999) AS c1 FROM m GROUP BY 1)
""" + _PICKED.format(v="CASE WHEN (r - c0) * (r - c0) <= (r - c1) * (r - c1) THEN c0 ELSE c1 END"))
# the wider box is halved again, the first of equals
few_colours("gif_three_colours", 3, False, _SPLIT + f""",
w AS (SELECT image_id, CASE WHEN max(v) FILTER (WHERE box = 0) - min(v) FILTER (WHERE box = 0) >= coalesce(max(v) FILTER (WHERE box = 1) - min(v) FILTER (WHERE box = 1), 0) THEN 0 ELSE 1 END AS wide FROM b GROUP BY 1),
r2 AS (SELECT b.image_id, v, n, sum(n) OVER (PARTITION BY b.image_id ORDER BY v) AS run, sum(n) OVER (PARTITION BY b.image_id) AS total, row_number() OVER (PARTITION BY b.image_id ORDER BY v DESC) AS from_end FROM b JOIN w ON w.image_id = b.image_id AND box = wide),
c2 AS (SELECT image_id, coalesce(min(v) FILTER (WHERE 2 * run >= total AND from_end > 1), max(v) FILTER (WHERE from_end = 2), max(v)) AS cut2 FROM r2 GROUP BY 1),
m AS (SELECT b.image_id, CASE WHEN box <> wide THEN 2 * box WHEN v <= cut2 THEN 2 * box ELSE 2 * box + 1 END AS part, {_MEAN} AS colour FROM b JOIN w ON w.image_id = b.image_id JOIN c2 ON c2.image_id = b.image_id GROUP BY 1, 2),
q AS (SELECT image_id, list(colour ORDER BY part) AS cs FROM m GROUP BY 1)
""" + _PICKED.format(v="list_reduce(cs, lambda s, t: CASE WHEN (r - t) * (r - t) < (r - s) * (r - s) THEN t ELSE s END)"))
# the first row alone, in two colours: seven sixteenths of each error go to the right
_ROW = _SPLIT.replace(f"({GREY})", f"(SELECT * FROM ({GREY}) WHERE y = 0)")
few_colours("gif_dithered", 2, True, _ROW.replace("WITH ", "WITH RECURSIVE ") + f""",
m AS (SELECT image_id, box, {_MEAN} AS colour FROM b GROUP BY 1, 2),
q AS (SELECT image_id, max(colour) FILTER (WHERE box = 0) AS c0, coalesce(max(colour) FILTER (WHERE box = 1), 9999) AS c1, (SELECT count(*) FROM h WHERE h.image_id = m.image_id) > 2 AS lossy FROM m GROUP BY 1),
k AS (
  SELECT image_id, -1 AS x, 0::DOUBLE AS err, 0 AS v FROM q
  UNION ALL
  SELECT image_id, x, CASE WHEN lossy THEN (want - v) * 0.4375::DOUBLE ELSE 0 END, v::INT FROM (
    SELECT *, CASE WHEN (want - c0) * (want - c0) <= (want - c1) * (want - c1) THEN c0 ELSE c1 END AS v FROM (
      SELECT k.image_id, p.x, c0, c1, lossy, floor(greatest(0, least(255, p.r + k.err)) + 0.5::DOUBLE) AS want FROM k JOIN p ON p.image_id = k.image_id AND p.x = k.x + 1 JOIN q ON q.image_id = k.image_id)))
SELECT image_id, 0 AS y, x, v AS r, v AS g, v AS b, 255 AS a FROM k WHERE x >= 0
""", step=lambda p: p.crop(0, 0, 8, 1))


# JPEG. Codes by rule: a difference's size in four bits, and after it only "no more coefficients", or for the first one its size.


def _segment(marker: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(data) + 2) + data


def _difference_bits(v: int) -> str:
    size = abs(v).bit_length()
    return f"{size:04b}" + (f"{v if v > 0 else v + (1 << size) - 1:0{size}b}" if size else "")


def _scan_data(text: str) -> bytes:
    text += "1" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8).replace(b"\xff", b"\xff\0") if text else b""


#: Sizes 0 to 11 in four bits each; and "no more" as 0, then sizes 1 to 7 of a coefficient without a run in four bits from 1000 on.
_DC = bytes([0, 0, 0, 12, *(0,) * 12, *range(12)])
_AC = bytes([1, 0, 0, 7, *(0,) * 12, *range(8)])


def _coefficient(v: int) -> str:
    """The second coefficient, then no more."""
    if not v:
        return "0"
    size = abs(v).bit_length()
    return f"{7 + size:04b}" + f"{v if v > 0 else v + (1 << size) - 1:0{size}b}" + "0"


def jpeg_file(width: int, height: int, sampling: list[tuple[int, int]], quant: list[int], units: list[list[tuple[int, int, int]]], restart: int = 0, scans: bool = False, more: bytes = b"", left_out: int = 0) -> bytes:
    """units: for each place of the interleaved scan (component, first, second coefficient) of its blocks. Every component has
    tables of its own. scans: a scan for each component. left_out: of the last components, which have no scan."""
    n = len(sampling)
    head = b"\xff\xd8" + more + b"".join(_segment(0xDB, bytes([c]) + bytes([quant[c]]) * 64) for c in range(n))
    head += _segment(0xC0, struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes([c + 1, h << 4 | v, c]) for c, (h, v) in enumerate(sampling)))
    head += b"".join(_segment(0xC4, bytes([c]) + _DC + bytes([16 + c]) + _AC) for c in range(min(n, 4)))
    if restart:
        head += _segment(0xDD, struct.pack(">H", restart))

    def scan(chosen: list[int]) -> bytes:
        before, text, pieces = dict.fromkeys(chosen, 0), "", []
        for at, unit in enumerate(units):
            if restart and at and at % restart == 0:
                pieces.append(_scan_data(text))
                before, text = dict.fromkeys(chosen, 0), ""
            for c, first, second in unit:
                if c in chosen:
                    text += _difference_bits(first - before[c]) + _coefficient(second)
                    before[c] = first
        pieces.append(_scan_data(text))
        data = b"".join(p + (bytes([255, 0xD0 + k % 8]) if k + 1 < len(pieces) else b"") for k, p in enumerate(pieces))
        return _segment(0xDA, bytes([len(chosen)]) + b"".join(bytes([c + 1, c << 4 | c]) for c in chosen) + bytes([0, 63, 0])) + data

    shown = list(range(n - left_out))
    return head + b"".join(map(scan, [[c] for c in shown] if scans else [shown])) + b"\xff\xd9"


def level(k: int, at: int) -> int:
    """A first coefficient."""
    return (13 * k + 7 * at) % 61 - 30


def sql_level(at: str) -> str:
    return f"((13 * k + 7 * ({at})) % 61 - 30)"


def sql_flat(q: str, at: str) -> str:
    """The sample of a block that has its first coefficient alone."""
    return f"greatest(0, least(255, 128 + floor(({q} * {sql_level(at)} + 4) / 8::DOUBLE)))"


def sql_colour(y: str, cb: str, cr: str) -> tuple[str, str, str]:
    cut = lambda e: f"greatest(0, least(255, {e}))"
    return cut(f"{y} + floor((91881 * ({cr} - 128) + 32768) / 65536::DOUBLE)"), cut(f"{y} + floor((-22554 * ({cb} - 128) - 46802 * ({cr} - 128) + 32768) / 65536::DOUBLE)"), cut(f"{y} + floor((116130 * ({cb} - 128) + 32768) / 65536::DOUBLE)")


_grey_file = lambda k, s, **more: jpeg_file(24, 8, [(1, 1)], [s + 1], [[(0, level(k, at), 0)] for at in range(3)], **more)
_GREY_FILE = sql_pixels(*(sql_flat("(s + 1)", "x // 8"),) * 3, "255", 24, 8)
pictures("jpeg_grey", _grey_file, _GREY_FILE)
pictures("jpeg_restarts", lambda k, s: _grey_file(k, s, restart=1 + k % 2), _GREY_FILE)
pictures("jpeg_fill_and_comments", lambda k, s: _grey_file(k, s, more=_segment(0xFE, b"a comment") + b"\xff\xff\xff" + _segment(0xE5, bytes(k % 50))), _GREY_FILE)


def _coloured(sampling: list[tuple[int, int]], blocks: list[int], width: int, height: int, **more) -> Make:
    """One unit; blocks: the component of each of its blocks in order."""
    return lambda k, s: jpeg_file(width, height, sampling, [s + 1 + c for c in range(len(sampling))], [[(c, level(k, at), 0) for at, c in enumerate(blocks)]], **more)


_THREE = sql_colour(sql_flat("(s + 1)", "0"), sql_flat("(s + 2)", "1"), sql_flat("(s + 3)", "2"))
pictures("jpeg_444", _coloured([(1, 1)] * 3, [0, 1, 2], 8, 8), sql_pixels(*_THREE, "255", 8, 8))
pictures("jpeg_scans", _coloured([(1, 1)] * 3, [0, 1, 2], 8, 8, scans=True), sql_pixels(*_THREE, "255", 8, 8))
pictures("jpeg_420", _coloured([(2, 2), (1, 1), (1, 1)], [0, 0, 0, 0, 1, 2], 16, 16), sql_pixels(*sql_colour(sql_flat("(s + 1)", "2 * (y // 8) + x // 8"), sql_flat("(s + 2)", "4"), sql_flat("(s + 3)", "5")), "255", 16, 16))
pictures("jpeg_422", _coloured([(2, 1), (1, 1), (1, 1)], [0, 0, 1, 2], 13, 8), sql_pixels(*sql_colour(sql_flat("(s + 1)", "x // 8"), sql_flat("(s + 2)", "2"), sql_flat("(s + 3)", "3")), "255", 13, 8))
# chrominance at two thirds of the width: each of its samples stands where it falls
pictures("jpeg_two_thirds", _coloured([(3, 1), (2, 1), (2, 1)], [0, 0, 0, 1, 1, 2, 2], 24, 8), sql_pixels(*sql_colour(sql_flat("(s + 1)", "x // 8"), sql_flat("(s + 2)", "3 + (x * 2 // 3) // 8"), sql_flat("(s + 3)", "5 + (x * 2 // 3) // 8")), "255", 24, 8))
_INKS = [sql_flat(f"(s + {c + 1})", str(c)) for c in range(4)]
_ink = lambda e: sql_clamp(f"{e} * {_INKS[3]} / 255::DOUBLE")
pictures("jpeg_inks", _coloured([(1, 1)] * 4, [0, 1, 2, 3], 8, 8, more=_segment(0xEE, b"Adobe\0\x64\0\0\0\0\0")), sql_pixels(*map(_ink, _INKS[:3]), "255", 8, 8))
_uncut = lambda y, cb, cr: (f"({y} + floor((91881 * ({cr} - 128) + 32768) / 65536::DOUBLE))", f"({y} + floor((-22554 * ({cb} - 128) - 46802 * ({cr} - 128) + 32768) / 65536::DOUBLE))", f"({y} + floor((116130 * ({cb} - 128) + 32768) / 65536::DOUBLE))")
pictures("jpeg_ycck", _coloured([(1, 1)] * 4, [0, 1, 2, 3], 8, 8, more=_segment(0xEE, b"Adobe\0\x64\0\0\0\0\x02")), sql_pixels(*map(_ink, _uncut(*_INKS[:3])), "255", 8, 8))
pictures("jpeg_rgb", _coloured([(1, 1)] * 3, [0, 1, 2], 8, 8, more=_segment(0xEE, b"Adobe\0\x64\0\0\0\0\0")), sql_pixels(*_INKS[:3], "255", 8, 8))

#: The second coefficient alone beside the first: what the integer transform's multipliers, in 13 bits, make of it across.
_ACROSS = "[11363, 9633, 6437, 2260, -2260, -6437, -9633, -11363]"
_WAVE = f"greatest(0, least(255, 128 + floor((4 * (s + 1) * {sql_level('0')} * 8192 + 4 * (s + 1) * ((5 * k) % 127 - 63) * {_ACROSS}[x + 1] + 131072) / 262144::DOUBLE)))"
pictures("jpeg_wave", lambda k, s: jpeg_file(8, 8, [(1, 1)], [s + 1], [[(0, level(k, 0), 5 * k % 127 - 63)]]), sql_pixels(*(_WAVE,) * 3, "255", 8, 8))
_ROOT = "'0.7071067811865476'::DOUBLE"
_mean = lambda e, n: f"{e} / 8::DOUBLE" if n == 1 else f"{_ROOT} * ({_ROOT} * {e}) / 4::DOUBLE"
# an eighth, a quarter and half of the size: means of flat blocks, which but for the eighth go through a product with the root of a half
for _n, _hint in ((1, 2), (2, 5), (4, 11)):
    pictures(f"jpeg_reduced_{_n}", lambda k, s: jpeg_file(16, 8, [(1, 1)], [s + 1], [[(0, level(k, at), 0)] for at in range(2)]), sql_pixels(*(f"greatest(0, least(255, 128 + floor({_mean(f"((s + 1) * {sql_level(f'x // {_n}')})", _n)} + 0.5::DOUBLE)))",) * 3, "255", 2 * _n, _n), hint=_hint)


@query("jpeg_missing_scan", "SELECT p_partkey AS image_id, CASE WHEN p_partkey % 3 > 0 THEN 'CORRUPT_IMAGE' END AS code FROM part")
def jpeg_missing_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components whose data never come."""
    make = lambda k, s: _coloured([(1, 1)] * 3, [0, 1, 2], 8, 8, left_out=k % 3)(k, s)
    return images.decode(built(spark, sf_dir, make)).select("image_id", F.col("error.code").alias("code"))


def _exif(k: int) -> bytes:
    """One entry: the orientation k mod 10, or where that is 0 another tag, in either byte order."""
    order, value = "<>"[k // 10 % 2], k % 10
    return _segment(0xE1, b"Exif\0\0" + {"<": b"II", ">": b"MM"}[order] + struct.pack(f"{order}HIHHHIHHI", 42, 8, 1, 0x0112 if value else 0x0110, 3, 1, value, 0, 0))


_exif_file = lambda k, s: jpeg_file(16, 8, [(1, 1)], [s + 1], [[(0, level(k, at), 0)] for at in range(2)], more=_exif(k))


@query("exif_read", "SELECT p_partkey AS image_id, CASE WHEN p_partkey % 10 BETWEEN 1 AND 8 THEN p_partkey % 10 ELSE 1 END::INT AS orientation FROM part")
def exif_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.orientation(built(spark, sf_dir, _exif_file)).select("image_id", "orientation")


# where a pixel of the upright picture comes from: its column in the file decides the block
_FROM = "CASE k % 10 WHEN 2 THEN 15 - x WHEN 3 THEN 15 - x WHEN 5 THEN y WHEN 6 THEN y WHEN 7 THEN 15 - y WHEN 8 THEN 15 - y ELSE x END"
_TALL = "k % 10 BETWEEN 5 AND 8"
SQL_UPRIGHT = f"SELECT image_id, y, x, v AS r, v AS g, v AS b, 255 AS a FROM (SELECT image_id, y, x, ({sql_flat('(s + 1)', f'({_FROM}) // 8')})::INT AS v FROM (SELECT *, CASE WHEN {_TALL} THEN i // 8 ELSE i // 16 END::INT AS y, CASE WHEN {_TALL} THEN i % 8 ELSE i % 16 END::INT AS x FROM (SELECT p_partkey AS image_id, p_partkey::BIGINT AS k, p_size::BIGINT AS s, unnest(range(128)) AS i FROM part)))"
pictures("exif_upright", _exif_file, SQL_UPRIGHT)


@query("metadata_stripped", "SELECT p_partkey AS image_id, true AS before, false AS after FROM part")
def metadata_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = built(spark, sf_dir, _exif_file)
    holds = lambda c: F.hex(c).contains("457869660000")
    kept = files.withColumn("before", holds(F.col("content")))
    return images.run(kept, {"stripMetadata": True}).select("image_id", "before", holds(F.col("content")).alias("after"))


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of 20 x 12 in one colour each."""
    one = lambda by, c: F.lpad(F.hex((F.col("p_partkey") * by + c) % 256), 2, "0")
    pixel = F.concat(one(37, 11), one(59, 23), one(83, 5), F.lit("FF"))
    image = F.struct(F.lit(20).alias("width"), F.lit(12).alias("height"), F.unhex(F.repeat(pixel, 240)).alias("data"))
    rows = _table(spark, sf_dir, "part").select("p_partkey")
    return images.spread(rows, rows.count()).select(F.col("p_partkey").cast("long").alias("image_id"), image.alias("image"))


# quality 75 halves the tables, to 8 and 9 for the first coefficients, which are 8 times a flat block's distance from 128
_R, _GR, _BL = "((k * 37 + 11) % 256)", "((k * 59 + 23) % 256)", "((k * 83 + 5) % 256)"
_YCC = [sql_clamp(e) for e in (f"0.299::DOUBLE * {_R} + 0.587::DOUBLE * {_GR} + 0.114::DOUBLE * {_BL}", f"128 - 0.168736::DOUBLE * {_R} - 0.331264::DOUBLE * {_GR} + 0.5::DOUBLE * {_BL}", f"128 + 0.5::DOUBLE * {_R} - 0.418688::DOUBLE * {_GR} - 0.081312::DOUBLE * {_BL}")]
_read_back = lambda e, q: f"greatest(0, least(255, 128 + floor(({q} * sign({e} - 128) * floor(abs(({e} - 128) * 8) / {q}::DOUBLE + 0.5::DOUBLE) + 4) / 8::DOUBLE)))"


@query("jpeg_written", sql_pixels(*sql_colour(*(_read_back(e, q) for e, q in zip(_YCC, (8, 9, 9), strict=True))), "255", 20, 12))
def jpeg_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.to_pixels(images.decode(images.encode(_flat(spark, sf_dir), "jpeg", quality=75)))


@query("jpeg_magnitude", "SELECT p_partkey, CASE WHEN v = 0 THEN 0 ELSE floor(log2(abs(v)))::INT + 1 END::INT AS bits FROM (SELECT p_partkey, (p_partkey * 7919 % 4095 - 2047) AS v FROM part)")
def jpeg_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", N.magnitude(F.col("p_partkey") * 7919 % 4095 - 2047).alias("bits"))


@query("jpeg_zigzag", "SELECT vec_id, (row_number() OVER (PARTITION BY vec_id ORDER BY i // 8 + i % 8, CASE WHEN (i // 8 + i % 8) % 2 = 1 THEN i // 8 ELSE i % 8 END) - 1)::INT AS place, embedding[(i + 1)::INT] AS value FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings)")
def jpeg_zigzag(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.lit(jpeg.ZIGZAG.tolist())
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.transform(order, lambda i: F.get("embedding", i))).alias("place", "value"))


# What is called otherwise than over tables of files.

_STEPS = {"resize": {"maxLongEdge": 3}, "flip": {"horizontal": True}, "rotate": {"angle": 90}, "crop": {"x": 1, "y": 1, "width": 6, "height": 6}}


def _built_chain(chain: Builder) -> Builder:
    return chain.max_long_edge(3).flip(horizontal=True).rotate(90).crop(1, 1, 6, 6)


def by_bytes(files: DataFrame, f: Callable[[bytes], bytes]) -> DataFrame:
    """The column content after a function of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), pa.array([f(c.as_py()) for c in batch.column("content")], pa.binary())], names=["image_id", "content"])

    return images.fused(files, run, "image_id long, content binary", ["image_id", "content"])


def _called(name: str, sql: str, source, f: Callable[[DataFrame], DataFrame]) -> None:
    query(name, sql)(lambda spark, sf_dir: images.to_pixels(images.decode(f(_files(spark, sf_dir, source)))))


_CANONICAL = SQL["pipeline_canonical"]
_called("chain_methods", _CANONICAL, grey, lambda files: _built_chain(api.from_table(files)).to_table())
_called("chain_to_buffer", _CANONICAL, grey, lambda files: by_bytes(files, lambda c: _built_chain(api.from_buffer(c)).to_buffer()))
_called("pipeline_object", _CANONICAL, grey, lambda files: api.Pipeline(_STEPS).run_table(files))
_called("pipeline_bytes", _CANONICAL, grey, lambda files: by_bytes(files, api.Pipeline(_STEPS).run))
_called("pipeline_to_json", _CANONICAL, grey, lambda files: images.run(files, _built_chain(Builder()).to_json()))
_called("low_level_codecs", RGBA, rgba, lambda files: by_bytes(files, lambda c: api.encode_tiff(api.decode_png(c), "none")))
_called("copied", RGBA, rgba, lambda files: by_bytes(files, lambda c: api.encode_png(_painted(api.decode_png(c)))))


def _painted(image: R.Raster) -> R.Raster:
    """A copy, of which another copy was painted over."""
    mine = api.copy_image(image)
    api.copy_image(mine)[:] = 0
    return mine


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see: in spark.checkpoint.dir; where that is unset and all runs on one machine, in /tmp."""
    import uuid

    top = spark.conf.get("spark.checkpoint.dir", "")
    if not top and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{top or 'file:///tmp/pixelframe-checkpoint'}/{name}-{uuid.uuid4().hex}"


def _stored(spark: SparkSession, sf_dir: str, folder: str) -> None:
    files = _files(spark, sf_dir, rgba).withColumn("name", F.concat(F.col("image_id").cast("string"), F.lit(".png")))
    images.write_images(files, folder, "name")


def _with_id(files: DataFrame) -> DataFrame:
    return files.select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("image_id"), "content")


@query("files_written", SQL["pixels_rgba"])
def files_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "files")
    _stored(spark, sf_dir, folder)
    return images.to_pixels(images.decode(_with_id(images.read_images(spark, folder, "*.png"))))


@query("files_arrived", SQL["pixels_rgba"])
def files_arrived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through a stream, flipped there and back."""
    folder, out = scratch(spark, "arrivals"), scratch(spark, "arrived")
    _stored(spark, sf_dir, folder)
    arrivals.run_arrivals(spark, folder, {"flip": {"horizontal": True}}, f"{out}/rows", f"{out}/checkpoint", glob="*.png").awaitTermination()
    return images.to_pixels(images.transform(images.decode(_with_id(spark.read.parquet(f"{out}/rows"))), {"flip": {"horizontal": True}}))


@query("sql_functions", "SELECT p_partkey AS image_id, 'bmp' AS format, 5 AS width, 3 AS height, CASE WHEN p_partkey % 2 = 1 THEN 'bmp' END AS after, CASE WHEN p_partkey % 2 = 0 THEN 'INVALID_OPTION' END AS code FROM part")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    udfs.register(spark)
    crop = F.when(F.col("image_id") % 2 == 1, '{"crop":{"x":0,"y":0,"width":5,"height":1}}').otherwise('{"crop":{"x":0,"y":0,"width":6,"height":1}}')
    rows = built(spark, sf_dir, _bmp_palette).withColumn("spec", crop)
    called = spark.sql("SELECT image_id, image_format(content) AS format, image_probe(content) AS size, image_result(content, spec) AS done FROM {rows}", rows=rows)
    return spark.sql("SELECT image_id, format, size.width AS width, size.height AS height, image_format(done.content) AS after, split(done.error, ':')[0] AS code FROM {called}", called=called)


@query("sql_pixels", SQL["bmp_palette"])
def sql_pixels_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    udfs.register(spark)
    return spark.sql("SELECT f.image_id, p.* FROM {files} f, LATERAL image_pixels(f.content) p", files=built(spark, sf_dir, _bmp_palette))


@query("encode_failed", "SELECT r_regionkey AS image_id, CASE r_regionkey % 3 WHEN 0 THEN 'ENCODE_FAILED' WHEN 1 THEN 'INVALID_OPTION' END AS code FROM region")
def encode_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of a row of 70,000 pixels, which JPEG files and GIF screens cannot hold, and PNG can."""
    rows = _table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("image_id"))
    image = F.struct(F.lit(70_000).alias("width"), F.lit(1).alias("height"), F.unhex(F.repeat(F.lit("102030FF"), 70_000)).alias("data"))
    parts = [images.encode(rows.where(F.col("image_id") % 3 == k).withColumn("image", image), f) for k, f in enumerate(("jpeg", "gif", "png"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("image_id", F.col("error.code").alias("code"))


# The pixel layout's own.

query("rotate_lanczos3", SQL["packed_rotate_lanczos3"])(lambda spark, sf_dir: rgba(spark, sf_dir).rotate(33, "lanczos3").df)


# WebP: lossless files are read and written here, lossy ones by a library.

query("codec_webp", SQL["pixels_rgba"])(lambda spark, sf_dir: images.to_pixels(images.decode(_files(spark, sf_dir, rgba, "webp", lossless=True))))


def _without_library(k: int) -> str:
    """What reading a lossy file, writing one, or loading the codec says where no library can be imported; twice the same."""
    lossy = b"RIFF\0\0\0\0WEBPVP8 " + b"\0" * 7 + b"\x9d\x01\x2a" + struct.pack("<HH", 7, 4) + b"\0" * 8
    calls = (lambda: images.decode_bytes(lossy), lambda: images.encode_raster(R.create(2, 2), "webp", {"quality": 50}), lambda: api.preload("webp"))
    before = webp.BACKENDS, dict(webp._state)
    webp.BACKENDS = ("no_such_codec",)
    webp._state.clear()
    codes = []
    try:
        for _ in range(2):
            try:
                calls[k % 3]()
            except ImageError as e:
                codes.append(e.code)
        listed = api.supported_formats()
        return f"{','.join(codes)},{'webp' in listed['read']},{len(listed['unavailable'])}"
    finally:
        webp.BACKENDS = before[0]
        webp._state.clear()
        webp._state.update(before[1])


@query("codec_load_failed", "SELECT p_partkey AS image_id, 'CODEC_LOAD_FAILED,CODEC_LOAD_FAILED,False,1' AS said FROM part")
def codec_load_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_without_library(k) for k in batch.column(0).to_pylist()])], names=["image_id", "said"])

    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("image_id"))
    return images.spread(rows, rows.count()).mapInArrow(run, "image_id long, said string")
