"""Queries of the image engine over the driver's tables, each with the SQL that gives the same rows.

The tables hold no image, so images are made from them alike in both engines: an embedding of 64 numbers is an opaque grey
8x8 picture or a 4x4 picture of four channels; file headers and recipes are put together from the numbers of `part` and `events`.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog
from .functions import headers as H
from .functions import numerics as N
from .operators import rasters as R
from .operators.pixels import Pixels, bilinear_plan, nearest_plan
from .plans import geometry as G
from .plans import spec as S
from .sources import images

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
COLUMNS = ("image_id", "y", "x", "r", "g", "b", "a")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grey(spark: SparkSession, sf_dir: str) -> Pixels:
    return Pixels.grey(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def rgba(spark: SparkSession, sf_dir: str) -> Pixels:
    return Pixels.rgba(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def pixels(name: str, source: Callable[[SparkSession, str], Pixels], step: Callable[[Pixels], Pixels], sql: str) -> None:
    query(name, f"SELECT image_id, y::INT AS y, x::INT AS x, r::INT AS r, g::INT AS g, b::INT AS b, a::INT AS a FROM ({sql})")(lambda spark, sf_dir: step(source(spark, sf_dir)).df)


# The same operators in SQL text.


def d(value: float) -> str:
    return f"'{value!r}'::DOUBLE"


def sql_clamp(e: str) -> str:
    return f"greatest(0::DOUBLE, least(255::DOUBLE, round_even(({e})::DOUBLE, 0)))::INT"


_VALUE = sql_clamp("(embedding[{}]::DOUBLE + 0.5::DOUBLE) * 255::DOUBLE")
GREY = f"SELECT vec_id AS image_id, (i // 8)::INT AS y, (i % 8)::INT AS x, v AS r, v AS g, v AS b, 255 AS a FROM (SELECT vec_id, i, {_VALUE.format('(i + 1)::INT')} AS v FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings))"
RGBA = "SELECT vec_id AS image_id, (i // 4)::INT AS y, (i % 4)::INT AS x, " + ", ".join(f"{_VALUE.format(f'(4 * i + {k + 1})::INT')} AS {c}" for k, c in enumerate("rgba")) + " FROM (SELECT vec_id, embedding, unnest(range(16)) AS i FROM embeddings)"


def sql_moved(source: str, y: str, x: str, where: str = "true") -> str:
    return f"SELECT image_id, {y} AS y, {x} AS x, r, g, b, a FROM ({source}) WHERE {where}"


def sql_premultiplied(source: str) -> str:
    return "SELECT image_id, y, x, " + ", ".join(f"{sql_clamp(f'{c} * (a / 255::DOUBLE)')} AS {c}" for c in "rgb") + f", a FROM ({source})"


def sql_unpremultiplied(source: str) -> str:
    return "SELECT image_id, y, x, " + ", ".join(f"CASE WHEN a = 0 THEN 0 ELSE {sql_clamp(f'{c} * (255::DOUBLE / a)')} END AS {c}" for c in "rgb") + f", a FROM ({source})"


def sql_sum(terms: str) -> str:
    return f"list_reduce({terms}, lambda s, t: s + t)"


def sql_filter(source: str, axis: str, n: int, out: int, kernel: str) -> str:
    plan = ", ".join(f"({o}, {i}, {d(w)})" for o, t in enumerate(G.taps(n, out, kernel)) for i, w in t)
    other = "y" if axis == "x" else "x"
    sums = ", ".join(f"{sql_clamp(sql_sum(f'list({c} * w ORDER BY i)'))} AS {c}" for c in "rgba")
    return f"SELECT image_id, {other}, o AS {axis}, {sums} FROM ({source}) s JOIN (VALUES {plan}) t(o, i, w) ON s.{axis} = t.i GROUP BY image_id, {other}, o"


def sql_resample(source: str, n: int, width: int, height: int, kernel: str, alpha: bool = False) -> str:
    if kernel == "nearest":
        plan = [", ".join(f"({o}, {i})" for o, i in enumerate(G.nearest_places(n, out))) for out in (width, height)]
        return f"SELECT image_id, v.o AS y, u.o AS x, r, g, b, a FROM ({source}) s JOIN (VALUES {plan[0]}) u(o, i) ON s.x = u.i JOIN (VALUES {plan[1]}) v(o, i) ON s.y = v.i"
    out = sql_filter(sql_filter(sql_premultiplied(source) if alpha else source, "x", n, width, kernel), "y", n, height, kernel)
    return sql_unpremultiplied(out) if alpha else out


def sql_padded(source: str, width: int, height: int, left: int, top: int, fill: tuple[int, ...]) -> str:
    shown = ", ".join(f"coalesce(s.{c}, {f}) AS {c}" for c, f in zip("rgba", fill, strict=True))
    grid = f"SELECT vec_id AS image_id, unnest(range({width * height})) AS k0 FROM embeddings"
    return f"SELECT q.image_id, k0 // {width} AS y, k0 % {width} AS x, {shown} FROM ({grid}) q LEFT JOIN ({source}) s ON s.image_id = q.image_id AND s.y + {top} = k0 // {width} AND s.x + {left} = k0 % {width}"


def sql_rotated(source: str, n: int, angle: float, kernel: str, fill: tuple[int, ...] = G.CLEAR, alpha: bool = False) -> str:
    plan = G.Rotation.of(n, n, angle)
    grid = f"SELECT vec_id AS image_id, unnest(range({plan.width * plan.height})) AS k0 FROM embeddings"
    if kernel == "nearest":
        rows = ", ".join(f"({at}, {i})" for at, i in enumerate(nearest_plan(plan)) if i >= 0)
        shown = ", ".join(f"coalesce(s.{c}, {f}) AS {c}" for c, f in zip("rgba", fill, strict=True))
        return f"SELECT q.image_id, k0 // {plan.width} AS y, k0 % {plan.width} AS x, {shown} FROM ({grid}) q LEFT JOIN (VALUES {rows}) t(k, i) ON t.k = q.k0 LEFT JOIN ({source}) s ON s.image_id = q.image_id AND s.y * {n} + s.x = t.i"
    rows = ", ".join(f"({at}, {j}, {t[f'i{j}']}, {d(t[f'w{j}'])})" for at, t in enumerate(bilinear_plan(plan)) if t for j in range(4))
    source = sql_premultiplied(source) if alpha else source
    sums = ", ".join(f"{sql_sum(f'list({c} * w ORDER BY j)')} AS {c}" for c in "rgba")
    total = f"SELECT image_id, k, {sums} FROM ({source}) s JOIN (VALUES {rows}) t(k, j, i, w) ON s.y * {n} + s.x = t.i GROUP BY image_id, k"
    scaled = [sql_clamp(f"t.{c} * (255::DOUBLE / t.a)" if alpha else f"t.{c}") for c in "rgb"] + [sql_clamp("t.a")]
    shown = ", ".join(f"CASE WHEN t.a IS NULL OR t.a = 0 THEN {f} ELSE {v} END AS {c}" for c, f, v in zip("rgba", fill, scaled, strict=True))
    return f"SELECT q.image_id, k0 // {plan.width} AS y, k0 % {plan.width} AS x, {shown} FROM ({grid}) q LEFT JOIN ({total}) t ON t.image_id = q.image_id AND t.k = q.k0"


def sql_rotated_lanczos3(source: str, n: int, angle: float) -> str:
    """Every tap of every destination pixel as a literal."""
    plan, rows, norms = G.Rotation.of(n, n, angle), [], []
    weight = lambda v: float(R._lanczos_weight(np.float64(v)))
    for k, (sx, sy) in enumerate(p for row in plan.places(0.0) for p in row):
        if not (-0.5 <= sx <= n - 0.5 and -0.5 <= sy <= n - 0.5):
            continue
        x, y, total, taps = sx - 0.5, sy - 0.5, 0.0, []
        for j in range(max(0, math.ceil(y - 3)), min(n - 1, math.floor(y + 3)) + 1):
            for i in range(max(0, math.ceil(x - 3)), min(n - 1, math.floor(x + 3)) + 1):
                taps.append((j * n + i, weight(j - y) * weight(i - x)))
                total += taps[-1][1]
        norms.append(f"({k}, {d(1 / total)})")
        rows += [f"({k}, {at}, {i}, {d(w)})" for at, (i, w) in enumerate(taps)]
    sums = ", ".join(f"{sql_sum(f'list({c} * (a / 255::DOUBLE) * w ORDER BY j)')} AS {c}" for c in "rgb") + f", {sql_sum('list(a * w ORDER BY j)')} AS a"
    total = f"SELECT image_id, k, {sums} FROM ({source}) s JOIN (VALUES {', '.join(rows)}) t(k, j, i, w) ON s.y * {n} + s.x = t.i GROUP BY image_id, k"
    grid = f"SELECT vec_id AS image_id, unnest(range({plan.width * plan.height})) AS k0 FROM embeddings"
    shown = ", ".join(f"CASE WHEN t.a IS NULL OR t.a * m <= 0 THEN 0 ELSE {v} END AS {c}" for c, v in zip("rgba", [sql_clamp(f"t.{c} * m * (255::DOUBLE / (t.a * m))") for c in "rgb"] + [sql_clamp("t.a * m")], strict=True))
    return f"SELECT q.image_id, k0 // {plan.width} AS y, k0 % {plan.width} AS x, {shown} FROM ({grid}) q LEFT JOIN ({total}) t ON t.image_id = q.image_id AND t.k = q.k0 LEFT JOIN (VALUES {', '.join(norms)}) v(k, m) ON v.k = q.k0"


# Pixels and exact geometry.

pixels("pixels_grey", grey, lambda p: p, GREY)
pixels("pixels_rgba", rgba, lambda p: p, RGBA)
pixels("crop", grey, lambda p: p.crop(2, 1, 5, 4), sql_moved(GREY, "y - 1", "x - 2", "x BETWEEN 2 AND 6 AND y BETWEEN 1 AND 4"))
pixels("flip_horizontal", grey, lambda p: p.flip(horizontal=True), sql_moved(GREY, "y", "7 - x"))
pixels("flip_vertical", grey, lambda p: p.flip(vertical=True), sql_moved(GREY, "7 - y", "x"))
pixels("flip_both", rgba, lambda p: p.flip(True, True), sql_moved(RGBA, "3 - y", "3 - x"))
for _angle, _y, _x in ((90, "x", "7 - y"), (180, "7 - y", "7 - x"), (270, "7 - x", "y"), (-90, "7 - x", "y"), (450, "x", "7 - y")):
    pixels(f"rotate90_{_angle}".replace("-", "minus_"), grey, lambda p, angle=_angle: p.rotate90(angle), sql_moved(GREY, _y, _x))
for _k, (_y, _x) in enumerate((("y", "x"), ("y", "7 - x"), ("7 - y", "7 - x"), ("7 - y", "x"), ("x", "y"), ("x", "7 - y"), ("7 - x", "7 - y"), ("7 - x", "y"))):
    pixels(f"exif_orientation_{_k + 1}", grey, lambda p, k=_k: p.oriented(k + 1), sql_moved(GREY, _y, _x))

# Filters.

for _name, _to in (("up", 13), ("down", 3)):
    pixels(f"resize_nearest_{_name}", grey, lambda p, to=_to: p.resize(to, to, resampling="nearest"), sql_resample(GREY, 8, _to, _to, "nearest"))
    pixels(f"resize_bilinear_{_name}", grey, lambda p, to=_to: p.resize(to, to, alpha=False), sql_resample(GREY, 8, _to, _to, "bilinear"))
    pixels(f"resize_lanczos3_{_name}", grey, lambda p, to=_to: p.resize(to, to, resampling="lanczos3", alpha=False), sql_resample(GREY, 8, _to, _to, "lanczos3"))
for _kernel in ("bilinear", "lanczos3"):
    pixels(f"resize_{_kernel}_alpha", rgba, lambda p, k=_kernel: p.resize(7, 3, resampling=k), sql_resample(RGBA, 4, 7, 3, _kernel, True))
pixels("resize_one_side", grey, lambda p: p.resize(height=5, alpha=False), sql_resample(GREY, 8, 5, 5, "bilinear"))
pixels("resize_no_upscale", grey, lambda p: p.resize(12, 4, upscale=False), GREY)
pixels("max_long_edge", grey, lambda p: p.max_long_edge(3, alpha=False), sql_resample(GREY, 8, 3, 3, "bilinear"))
pixels("max_long_edge_within", grey, lambda p: p.max_long_edge(8), GREY)
pixels("fit_contain", grey, lambda p: p.resize(12, 6, fit="contain", background=(9, 8, 7, 255), alpha=False), sql_padded(sql_resample(GREY, 8, 6, 6, "bilinear"), 12, 6, 3, 0, (9, 8, 7, 255)))
pixels("fit_cover", grey, lambda p: p.resize(12, 6, fit="cover", alpha=False), sql_moved(sql_resample(GREY, 8, 12, 12, "bilinear"), "y - 3", "x", "y BETWEEN 3 AND 8"))
pixels("rotate_nearest", grey, lambda p: p.rotate(30, "nearest"), sql_rotated(GREY, 8, 30, "nearest"))
pixels("rotate_nearest_background", rgba, lambda p: p.rotate(-77.5, "nearest", (1, 2, 3, 4)), sql_rotated(RGBA, 4, -77.5, "nearest", (1, 2, 3, 4)))
pixels("rotate_bilinear", grey, lambda p: p.rotate(15, alpha=False), sql_rotated(GREY, 8, 15, "bilinear"))
pixels("rotate_bilinear_alpha", rgba, lambda p: p.rotate(200, background=(250, 0, 120, 255)), sql_rotated(RGBA, 4, 200, "bilinear", (250, 0, 120, 255), True))
pixels("rotate_right_angle", grey, lambda p: p.rotate(-270), sql_moved(GREY, "x", "7 - y"))
pixels("premultiply", rgba, Pixels.premultiply, sql_premultiplied(RGBA))
pixels("unpremultiply", rgba, lambda p: p.premultiply().unpremultiply(), sql_unpremultiplied(sql_premultiplied(RGBA)))
pixels("pipeline_canonical", grey, lambda p: p.crop(1, 1, 6, 6).rotate90(90).flip(horizontal=True).max_long_edge(3, alpha=False), sql_resample(sql_moved(sql_moved(sql_moved(GREY, "y - 1", "x - 1", "x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6"), "x", "5 - y"), "y", "5 - x"), 6, 3, 3, "bilinear"))


@query("create_image", "SELECT vec_id AS image_id, (i // 3)::INT AS y, (i % 3)::INT AS x, 10 AS r, 20 AS g, 30 AS b, 40 AS a FROM (SELECT vec_id, unnest(range(6)) AS i FROM embeddings)")
def create_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.explode(F.sequence(F.lit(0), F.lit(5)))
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), at.alias("i"))
    return rows.select("image_id", F.expr("cast(i div 3 as int)").alias("y"), (F.col("i") % 3).alias("x"), *(F.lit(v).alias(c) for c, v in zip("rgba", (10, 20, 30, 40), strict=True)))


@query("assert_valid_image", "SELECT vec_id, CASE WHEN len(embedding) = 4 * (vec_id % 3 + 4) * 4 THEN NULL ELSE 'CORRUPT_IMAGE' END AS code FROM embeddings")
def assert_valid_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.size("embedding") != 4 * (F.col("vec_id") % 3 + 4) * 4, "CORRUPT_IMAGE").alias("code"))


@query("has_alpha", f"SELECT image_id, bool_or(a <> 255) AS has_alpha, bool_or(a < 128) AS has_transparent FROM ({RGBA}) GROUP BY image_id")
def has_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rgba(spark, sf_dir).df.groupBy("image_id").agg(F.bool_or(F.col("a") != 255).alias("has_alpha"), F.bool_or(F.col("a") < 128).alias("has_transparent"))


def sql_over(c: str, background: int) -> str:
    return f"({c} * (a / 255::DOUBLE) + {background}::DOUBLE * (1::DOUBLE - a / 255::DOUBLE))"


@query("composite_truncated", f"SELECT image_id, y, x, {', '.join(f'floor({sql_over(c, v)})::INT AS {c}' for c, v in zip('rgb', (255, 255, 255), strict=True))} FROM ({RGBA})")
def composite_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rgba(spark, sf_dir).df.select("image_id", "y", "x", *(N.truncated(N.over(F.col(c), F.col("a"), 255)).alias(c) for c in "rgb"))


# Colour and the arithmetic of codecs.

_LUMA = {"luma": "0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b", "cb": "128::DOUBLE - 0.168736::DOUBLE * r - 0.331264::DOUBLE * g + 0.5::DOUBLE * b", "cr": "128::DOUBLE + 0.5::DOUBLE * r - 0.418688::DOUBLE * g - 0.081312::DOUBLE * b"}
YCC = "SELECT image_id, y, x, " + ", ".join(f"{sql_clamp(e)} AS {c}" for c, e in _LUMA.items()) + f" FROM (SELECT image_id, y, x, {', '.join(f'{sql_over(c, 255)} AS {c}' for c in 'rgb')} FROM ({RGBA}))"


def _ycc(spark: SparkSession, sf_dir: str) -> DataFrame:
    solid = rgba(spark, sf_dir).df.select("image_id", "y", "x", *(N.over(F.col(c), F.col("a"), 255).alias(c) for c in "rgb"))
    return solid.select("image_id", "y", "x", *(N.clamp8(v).alias(c) for c, v in zip(("luma", "cb", "cr"), N.luma(*map(F.col, "rgb")), strict=True)))


query("rgb_to_ycbcr", YCC)(_ycc)


@query("ycbcr_to_rgb", f"""SELECT image_id, y, x, greatest(0, least(255, luma + ((91881 * (cr - 128) + 32768) >> 16)))::INT AS r,
 greatest(0, least(255, luma + ((-22554 * (cb - 128) - 46802 * (cr - 128) + 32768) >> 16)))::INT AS g,
 greatest(0, least(255, luma + ((116130 * (cb - 128) + 32768) >> 16)))::INT AS b FROM ({YCC})""")
def ycbcr_to_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = N.rgb_of(F.col("luma"), F.col("cb"), F.col("cr"))
    return _ycc(spark, sf_dir).select("image_id", "y", "x", *(v.alias(c) for c, v in zip("rgb", back, strict=True)))


_BOX = "SELECT image_id, (y // 2)::INT AS y, (x // 2)::INT AS x, ((sum(cb) + 2) >> 2)::INT AS cb, ((sum(cr) + 2) >> 2)::INT AS cr FROM ({}) GROUP BY image_id, y // 2, x // 2"


def _boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = lambda c: F.expr(f"cast({c} div 2 as int)").alias(c)
    return _ycc(spark, sf_dir).groupBy("image_id", half("y"), half("x")).agg(*(F.shiftright(F.sum(c) + 2, 2).cast("int").alias(c) for c in ("cb", "cr")))


query("chroma_box_420", _BOX.format(YCC))(_boxed)


@query("chroma_h2v1_upsample", f"""SELECT image_id, y, (2 * x + s)::INT AS x, CASE WHEN (s = 0 AND x = 0) OR (s = 1 AND x = 7) THEN r ELSE (3 * r + n + 1 + s) >> 2 END::INT AS v FROM (
 SELECT image_id, y, x, r, s, CASE WHEN s = 0 THEN lag(r) OVER w ELSE lead(r) OVER w END AS n FROM ({GREY}), (VALUES (0), (1)) t(s) WINDOW w AS (PARTITION BY image_id, y, s ORDER BY x))""")
def chroma_h2v1_upsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice the columns by a triangle: three quarters of the nearer sample, a quarter of the further, ends alone."""
    p = grey(spark, sf_dir)
    line = p.df.groupBy("image_id", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "r"))), lambda s: s["r"]).alias("v"))

    def sample(at):
        x, side = F.expr("cast(0 as int)") + F.floor(at / 2).cast("int"), at % 2
        own, other = F.get("v", x), F.get("v", x + 2 * side - 1)
        return F.coalesce(F.shiftright(3 * own + other + 1 + side, 2), own).cast("int")

    return line.select("image_id", "y", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(15)), sample)).alias("x", "v"))


# The luminance table of JPEG's Annex K, in rows.
LUMINANCE = (16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99)


@query("quant_table_scale", f"""SELECT q::INT AS quality, (k - 1)::INT AS at, greatest(1, least(255, floor((t[k::INT] * CASE WHEN q < 50 THEN floor(5000 / q) ELSE 200 - 2 * q END + 50) / 100)))::INT AS step
 FROM (SELECT DISTINCT p_size * 2 AS q FROM part WHERE p_size BETWEEN 1 AND 50), (SELECT {list(LUMINANCE)} AS t), (SELECT unnest(range(1, 65)) AS k)""")
def quant_table_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = _table(spark, sf_dir, "part").where("p_size between 1 and 50").select((F.col("p_size") * 2).cast("int").alias("quality")).distinct()
    rows = quality.select("quality", F.posexplode(F.lit(list(LUMINANCE))).alias("at", "base"))
    return rows.select("quality", "at", N.quantiser_step(F.col("base"), F.col("quality")).alias("step"))


_LAG = "coalesce(lag({c}) OVER (PARTITION BY image_id, {by} ORDER BY {axis}), 0)"


def _before(c: str, by: str, axis: str):
    from pyspark.sql import Window

    return F.coalesce(F.lag(c).over(Window.partitionBy("image_id", by).orderBy(axis)), F.lit(0))


@query("predictor2_encode", "SELECT image_id, y, x, " + ", ".join(f"((({c} - {_LAG.format(c=c, by='y', axis='x')}) % 256 + 256) % 256)::INT AS {c}" for c in "rgba") + f" FROM ({RGBA})")
def predictor2_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rgba(spark, sf_dir).df.select("image_id", "y", "x", *(F.pmod(F.col(c) - _before(c, "y", "x"), F.lit(256)).cast("int").alias(c) for c in "rgba"))


@query("predictor2_undo", f"SELECT image_id, y, x, r, g, b, a FROM ({RGBA})")
def predictor2_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    line = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    return predictor2_encode(spark, sf_dir).select("image_id", "y", "x", *((F.sum(c).over(line) % 256).cast("int").alias(c) for c in "rgba"))


@query("png_up_undo", f"SELECT image_id, y, x, (sum(r) OVER (PARTITION BY image_id, x ORDER BY y) % 256)::INT AS r FROM ({GREY})")
def png_up_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    column = Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    return grey(spark, sf_dir).df.select("image_id", "y", "x", (F.sum("r").over(column) % 256).cast("int").alias("r"))


@query("paeth_residual", f"""WITH n AS (SELECT image_id, y, x, r, {_LAG.format(c='r', by='y', axis='x')} AS l, {_LAG.format(c='r', by='x', axis='y')} AS u FROM ({GREY})),
 m AS (SELECT *, coalesce(lag(u) OVER (PARTITION BY image_id, y ORDER BY x), 0) AS c FROM n),
 p AS (SELECT *, abs(u - c) AS pa, abs(l - c) AS pb, abs(l + u - 2 * c) AS pc FROM m)
 SELECT image_id, y, x, (((r - CASE WHEN pa <= pb AND pa <= pc THEN l WHEN pb <= pc THEN u ELSE c END) % 256 + 256) % 256)::INT AS residual FROM p""")
def paeth_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = grey(spark, sf_dir).df.select("image_id", "y", "x", "r", _before("r", "y", "x").alias("l"), _before("r", "x", "y").alias("u"))
    near = near.withColumn("c", _before("u", "y", "x"))
    return near.select("image_id", "y", "x", F.pmod(F.col("r") - N.paeth(F.col("l"), F.col("u"), F.col("c")), F.lit(256)).cast("int").alias("residual"))


@query("dc_prediction", f"SELECT image_id, y, (dc - coalesce(lag(dc) OVER (PARTITION BY image_id ORDER BY y), 0))::INT AS difference FROM (SELECT image_id, y, sum(r) - 1024 AS dc FROM ({GREY}) GROUP BY image_id, y)")
def dc_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    dc = grey(spark, sf_dir).df.groupBy("image_id", "y").agg((F.sum("r") - 1024).alias("dc"))
    return dc.select("image_id", "y", (F.col("dc") - F.coalesce(F.lag("dc").over(Window.partitionBy("image_id").orderBy("y")), F.lit(0))).cast("int").alias("difference"))


# Palettes.

COARSE = f"SELECT image_id, y, x, (r // 32) * 32 AS r, (g // 32) * 32 AS g, (b // 32) * 32 AS b, a FROM ({RGBA})"


def _coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rgba(spark, sf_dir).df.select("image_id", "y", "x", *(F.expr(f"cast({c} div 32 * 32 as int)").alias(c) for c in "rgb"), "a")


@query("gif_histogram", f"SELECT r::INT AS r, g::INT AS g, b::INT AS b, count(*) AS n FROM ({COARSE}) WHERE a >= 128 GROUP BY r, g, b")
def gif_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coarse(spark, sf_dir).where("a >= 128").groupBy("r", "g", "b").agg(F.count(F.lit(1)).alias("n"))


@query("gif_colour_count", f"SELECT image_id, count(DISTINCT r * 65536 + g * 256 + b) AS colours, count(DISTINCT r * 65536 + g * 256 + b) <= 8 AS exact FROM ({COARSE}) WHERE a >= 128 GROUP BY image_id")
def gif_colour_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coarse(spark, sf_dir).where("a >= 128").groupBy("image_id").agg(F.count_distinct("r", "g", "b").alias("colours")).withColumn("exact", F.col("colours") <= 8)


@query("gif_widest_axis", f"""SELECT image_id, CASE WHEN dr >= dg AND dr >= db THEN 'r' WHEN dg >= db THEN 'g' ELSE 'b' END AS axis, greatest(dr, dg, db)::INT AS span
 FROM (SELECT image_id, max(r) - min(r) AS dr, max(g) - min(g) AS dg, max(b) - min(b) AS db FROM ({RGBA}) WHERE a >= 128 GROUP BY image_id)""")
def gif_widest_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = rgba(spark, sf_dir).df.where("a >= 128").groupBy("image_id").agg(*((F.max(c) - F.min(c)).alias(f"d{c}") for c in "rgb"))
    axis = F.when((F.col("dr") >= F.col("dg")) & (F.col("dr") >= F.col("db")), "r").when(F.col("dg") >= F.col("db"), "g").otherwise("b")
    return spans.select("image_id", axis.alias("axis"), F.greatest("dr", "dg", "db").alias("span"))


@query("gif_box_average", "SELECT image_id, " + ", ".join(f"floor(sum({c} * n) / sum(n)::DOUBLE + 0.5::DOUBLE)::INT AS {c}" for c in "rgb") + f" FROM (SELECT image_id, r, g, b, count(*) AS n FROM ({COARSE}) WHERE a >= 128 GROUP BY ALL) GROUP BY image_id")
def gif_box_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _coarse(spark, sf_dir).where("a >= 128").groupBy("image_id", "r", "g", "b").count()
    return counted.groupBy("image_id").agg(*(N.half_up(F.sum(F.col(c) * F.col("count")) / F.sum("count")).alias(c) for c in "rgb"))


PALETTE = tuple((r, g, b) for r in (40, 128, 216) for g in (40, 128, 216) for b in (64, 192))
_DISTANCE = "(r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb)"


@query("palette_nearest", f"""SELECT image_id, y, x, arg_min(i, k)::INT AS i FROM (SELECT image_id, y, x, i, ({_DISTANCE}) * 1000 + i AS k FROM ({RGBA}), (VALUES {', '.join(f'({i}, {r}, {g}, {b})' for i, (r, g, b) in enumerate(PALETTE))}) t(i, pr, pg, pb)) GROUP BY image_id, y, x""")
def palette_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of a palette's at most 256 colours, the first of equals; the palette is a constant of the plan."""
    palette = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("i", "r", "g", "b"), (i, *c), strict=True))) for i, c in enumerate(PALETTE)))
    square = lambda p, c: (F.col(c) - p[c]) * (F.col(c) - p[c])
    nearest = F.array_min(F.transform(palette, lambda p: F.struct((square(p, "r") + square(p, "g") + square(p, "b")).alias("d"), p["i"].alias("i"))))["i"]
    return rgba(spark, sf_dir).df.select("image_id", "y", "x", nearest.alias("i"))


@query("palette_lookup", f"SELECT image_id, y, x, pr AS r, pg AS g, pb AS b FROM (SELECT image_id, y, x, r % {len(PALETTE)} AS k FROM ({GREY})) JOIN (VALUES {', '.join(f'({i}, {r}, {g}, {b})' for i, (r, g, b) in enumerate(PALETTE))}) t(i, pr, pg, pb) ON i = k")
def palette_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    palette = spark.createDataFrame([(i, *c) for i, c in enumerate(PALETTE)], "i int, pr int, pg int, pb int")
    indexed = grey(spark, sf_dir).df.select("image_id", "y", "x", (F.col("r") % len(PALETTE)).alias("i"))
    return indexed.join(F.broadcast(palette), "i").select("image_id", "y", "x", *(F.col(f"p{c}").alias(c) for c in "rgb"))


@query("gif_frame_on_screen", f"SELECT image_id, y::INT AS y, x::INT AS x, r::INT AS r, g::INT AS g, b::INT AS b, a::INT AS a FROM ({sql_padded(GREY, 14, 10, 6, 5, G.CLEAR)})")
def gif_frame_on_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame at (6, 5) on a 14x10 screen: what sticks out is cut, the rest of the screen is clear."""
    p = grey(spark, sf_dir)
    places = [(y - 5) * 8 + x - 6 if 0 <= y - 5 < 8 and 0 <= x - 6 < 8 else -1 for y in range(10) for x in range(14)]
    return p._picked(places, G.CLEAR, 14, 10).df


_PASSES = ((0, 8), (4, 8), (2, 4), (1, 2))


def _interlaced(height: int) -> list[int]:
    return [y for first, step in _PASSES for y in range(first, height, step)]


@query("gif_interlace_rows", "SELECT h::INT AS height, (row_number() OVER (PARTITION BY h ORDER BY p, y) - 1)::INT AS stored, y::INT AS y FROM (SELECT h, y, CASE WHEN y % 8 = 0 THEN 0 WHEN y % 8 = 4 THEN 1 WHEN y % 4 = 2 THEN 2 ELSE 3 END AS p FROM (SELECT h, unnest(range(h)) AS y FROM (SELECT DISTINCT p_size AS h FROM part)))")
def gif_interlace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    heights = _table(spark, sf_dir, "part").select(F.col("p_size").cast("int").alias("height")).distinct()
    passes = F.flatten(F.array(*(F.when(F.col("height") > first, F.sequence(F.lit(first), F.col("height") - 1, F.lit(step))).otherwise(F.array().cast("array<int>")) for first, step in _PASSES)))
    return heights.select("height", F.posexplode(passes).alias("stored", "y"))


# Column and row at which each of PNG's interlace passes begins, and its steps.
ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


@query("adam7_pass_geometry", f"""SELECT s.w::INT AS width, s.h::INT AS height, p.k::INT AS pass, greatest(0, (s.w - p.x + p.dx - 1) // p.dx)::INT AS columns, greatest(0, (s.h - p.y + p.dy - 1) // p.dy)::INT AS rows
 FROM (SELECT DISTINCT p_size AS w, p_partkey % 23 + 1 AS h FROM part) s, (VALUES {', '.join(f'({k + 1}, {x}, {y}, {dx}, {dy})' for k, (x, y, dx, dy) in enumerate(ADAM7))}) p(k, x, y, dx, dy)""")
def adam7_pass_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _table(spark, sf_dir, "part").select(F.col("p_size").cast("int").alias("width"), (F.col("p_partkey") % 23 + 1).cast("int").alias("height")).distinct()
    count = lambda n, first, step: F.greatest(F.lit(0), F.floor((F.col(n) - first + step - 1) / step)).cast("int")
    passes = F.array(*(F.struct(F.lit(k + 1).alias("pass"), count("width", x, dx).alias("columns"), count("height", y, dy).alias("rows")) for k, (x, y, dx, dy) in enumerate(ADAM7)))
    return sizes.select("width", "height", F.explode(passes).alias("p")).select("width", "height", "p.*")


# Sizes by rule.

_RESIZES = [(w, h, fit, up) for w, h in ((40, None), (None, 17), (30, 20)) for fit in ("fill", "contain", "cover") for up in (True, False)]


@query("resize_dims", """WITH s AS (SELECT DISTINCT p_size AS w, p_partkey % 37 + 1 AS h FROM part),
 t AS (SELECT * FROM (VALUES (0, 40, NULL), (1, NULL, 17), (2, 30, 20)) x(k, tw, th), (VALUES ('fill'), ('contain'), ('cover')) f(fit), (VALUES (true), (false)) u(upscale)),
 r AS (SELECT *, coalesce(tw, greatest(1, floor(th::DOUBLE / h * w + 0.5::DOUBLE))) AS rw, coalesce(th, greatest(1, floor(tw::DOUBLE / w * h + 0.5::DOUBLE))) AS rh FROM s, t),
 c AS (SELECT *, CASE WHEN fit = 'contain' THEN least(rw::DOUBLE / w, rh::DOUBLE / h) ELSE greatest(rw::DOUBLE / w, rh::DOUBLE / h) END AS scale FROM r)
SELECT w::INT AS width, h::INT AS height, k::INT AS target, fit, upscale,
 CASE WHEN (NOT upscale AND (rw > w OR rh > h)) THEN w WHEN k = 2 AND fit = 'cover' THEN least(rw, greatest(1, floor(w * scale + 0.5::DOUBLE))) ELSE rw END::INT AS to_width,
 CASE WHEN (NOT upscale AND (rw > w OR rh > h)) THEN h WHEN k = 2 AND fit = 'cover' THEN least(rh, greatest(1, floor(h * scale + 0.5::DOUBLE))) ELSE rh END::INT AS to_height FROM c""")
def resize_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _table(spark, sf_dir, "part").select(F.col("p_size").cast("int").alias("width"), (F.col("p_partkey") % 37 + 1).cast("int").alias("height")).distinct()
    w, h = F.col("width"), F.col("height")
    at_least_1 = lambda v: F.greatest(F.lit(1), N.half_up(v))
    out = []
    for k, (tw, th) in enumerate(((40, None), (None, 17), (30, 20))):
        rw = F.lit(tw) if tw else at_least_1(F.lit(float(th)) / h * w)
        rh = F.lit(th) if th else at_least_1(F.lit(float(tw)) / w * h)
        for fit in G.FITS:
            scale = F.greatest(rw / w, rh / h)
            cw, ch = (F.least(rw, at_least_1(w * scale)), F.least(rh, at_least_1(h * scale))) if tw and th and fit == "cover" else (rw, rh)
            for upscale in (True, False):
                same = (rw > w) | (rh > h) if not upscale else F.lit(False)
                out.append(F.struct(F.lit(k).alias("target"), F.lit(fit).alias("fit"), F.lit(upscale).alias("upscale"), F.when(same, w).otherwise(cw).cast("int").alias("to_width"), F.when(same, h).otherwise(ch).cast("int").alias("to_height")))
    return sizes.select("width", "height", F.explode(F.array(*out)).alias("o")).select("width", "height", "o.*")


@query("max_long_edge_dims", "SELECT DISTINCT p_size::INT AS width, (p_partkey % 997 + 1)::INT AS height, CASE WHEN greatest(p_size, p_partkey % 997 + 1) <= 60 THEN p_size ELSE greatest(1, floor(p_size * (60::DOUBLE / greatest(p_size, p_partkey % 997 + 1)) + 0.5::DOUBLE)) END::INT AS to_width, CASE WHEN greatest(p_size, p_partkey % 997 + 1) <= 60 THEN p_partkey % 997 + 1 ELSE greatest(1, floor((p_partkey % 997 + 1) * (60::DOUBLE / greatest(p_size, p_partkey % 997 + 1)) + 0.5::DOUBLE)) END::INT AS to_height FROM part")
def max_long_edge_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").select(F.col("p_size").cast("int").alias("width"), (F.col("p_partkey") % 997 + 1).cast("int").alias("height")).distinct()
    longest = F.greatest("width", "height")
    to = lambda c: F.when(longest <= 60, F.col(c)).otherwise(F.greatest(F.lit(1), N.half_up(F.col(c) * (F.lit(60.0) / longest)))).cast("int")
    return rows.select("width", "height", to("width").alias("to_width"), to("height").alias("to_height"))


_ANGLES = (15.0, 30.0, -77.5, 200.0)


@query("rotate_box_dims", " UNION ALL ".join(f"SELECT DISTINCT p_size::INT AS width, (p_partkey % 50 + 1)::INT AS height, {d(a)} AS angle, ceil(abs(p_size * {d(math.cos(a * math.pi / 180))}) + abs((p_partkey % 50 + 1) * {d(math.sin(a * math.pi / 180))}))::INT AS to_width, ceil(abs(p_size * {d(math.sin(a * math.pi / 180))}) + abs((p_partkey % 50 + 1) * {d(math.cos(a * math.pi / 180))}))::INT AS to_height FROM part" for a in _ANGLES))
def rotate_box_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").select(F.col("p_size").cast("int").alias("width"), (F.col("p_partkey") % 50 + 1).cast("int").alias("height")).distinct()
    turns = F.array(*(F.struct(F.lit(a).alias("angle"), F.lit(math.cos(a * math.pi / 180)).alias("cos"), F.lit(math.sin(a * math.pi / 180)).alias("sin")) for a in _ANGLES))
    rows = rows.select("width", "height", F.explode(turns).alias("t")).select("width", "height", "t.*")
    side = lambda p, q: F.ceil(F.abs(F.col("width") * F.col(p)) + F.abs(F.col("height") * F.col(q))).cast("int")
    return rows.select("width", "height", "angle", side("cos", "sin").alias("to_width"), side("sin", "cos").alias("to_height"))


@query("dct_block_size", "SELECT p_partkey, CASE WHEN p_size IS NULL THEN 8 WHEN ceil(p_partkey * 8 / 8.0::DOUBLE) <= p_size * 8 THEN 8 WHEN ceil(p_partkey * 4 / 8.0::DOUBLE) <= p_size * 8 THEN 4 WHEN ceil(p_partkey * 2 / 8.0::DOUBLE) <= p_size * 8 THEN 2 ELSE 1 END::INT AS block FROM part")
def dct_block_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", H.block_size(F.col("p_partkey"), F.col("p_size") * 8).alias("block"))


# Headers of files.

_HEX = {"png": "89504E470D0A1A0A", "jpeg": "FFD8FFE000104A4649460001", "gif": "474946383961", "bmp": "424D36000000", "tiff_le": "49492A0008000000", "tiff_be": "4D4D002A00000008", "webp": "52494646240000005745425056503820", "wave": "524946462400000057415645", "heic": "000000186674797068656963", "short": "89504E", "empty": "", "text": "68656C6C6F"}
_KINDS = list(_HEX.values())


def _content(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.lit(_KINDS)
    return _table(spark, sf_dir, "part").select("p_partkey", F.unhex(F.get(kinds, (F.col("p_partkey") % len(_KINDS)).cast("int"))).alias("content"))


_SQL_KIND = "{}[(p_partkey % {} + 1)::INT]".format("['" + "', '".join(_KINDS) + "']", len(_KINDS))
_SQL_SNIFF = "CASE WHEN starts_with(h, '89504E470D0A1A0A') THEN 'png' WHEN starts_with(h, '52494646') AND substr(h, 17, 8) = '57454250' THEN 'webp' WHEN starts_with(h, 'FFD8FF') THEN 'jpeg' WHEN starts_with(h, '47494638') THEN 'gif' WHEN starts_with(h, '49492A00') OR starts_with(h, '4D4D002A') THEN 'tiff' WHEN starts_with(h, '424D') THEN 'bmp' END"


@query("sniff", f"SELECT p_partkey, {_SQL_SNIFF} AS format FROM (SELECT p_partkey, {_SQL_KIND} AS h FROM part)")
def sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _content(spark, sf_dir).select("p_partkey", H.sniff(F.col("content")).alias("format"))


@query("sniff_text", "SELECT doc_id, CAST(NULL AS VARCHAR) AS format FROM documents")
def sniff_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", H.sniff(F.col("text").cast("binary")).alias("format"))


@query("format_mismatch", f"SELECT p_partkey, CASE WHEN {_SQL_SNIFF} IS DISTINCT FROM 'png' THEN 'FORMAT_MISMATCH' END AS code FROM (SELECT p_partkey, {_SQL_KIND} AS h FROM part)")
def format_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _content(spark, sf_dir).select("p_partkey", F.when(~H.sniff(F.col("content")).eqNullSafe(F.lit("png")), "FORMAT_MISMATCH").alias("code"))


@query("error_not_an_image", f"SELECT p_partkey, CASE WHEN {_SQL_SNIFF} IS NOT NULL THEN NULL WHEN h = '' THEN 'Not an image: the file is empty.' ELSE 'Not a supported image format. First bytes: ' || rtrim(regexp_replace(lower(substr(h, 1, 24)), '(..)', '\\1 ', 'g')) END AS message FROM (SELECT p_partkey, {_SQL_KIND} AS h FROM part)")
def error_not_an_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _content(spark, sf_dir).select("p_partkey", H.not_an_image(F.col("content")).alias("message"))


_SIZED = "SELECT p_partkey, (p_partkey * 7 % 4000)::BIGINT AS w, (p_size * 31)::BIGINT AS h FROM part"


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 7 % 4000).alias("w"), (F.col("p_size") * 31).cast("long").alias("h"))


def _probed(spark: SparkSession, sf_dir: str, header) -> DataFrame:
    rows = _sized(spark, sf_dir).select("p_partkey", F.unhex(header(F.col("w"), F.col("h"))).alias("content"))
    size = H.header_size(F.col("content"))
    return rows.select("p_partkey", size["width"].alias("width"), size["height"].alias("height"))


def _le(value, n: int):
    return F.concat(*(F.lpad(F.hex(F.shiftright(value, 8 * k).bitwiseAND(255)), 2, "0") for k in range(n)))


def _header_query(name: str, header, rule: str) -> None:
    query(f"probe_{name}", f"SELECT p_partkey, CASE WHEN {rule} THEN w END::INT AS width, CASE WHEN {rule} THEN h END::INT AS height FROM ({_SIZED})")(lambda spark, sf_dir: _probed(spark, sf_dir, header))


_BIG = lambda v: F.lpad(F.hex(v), 8, "0")
_IHDR = lambda w, h: F.concat(F.lit("49484452"), _BIG(w), _BIG(h), F.lit("0806000000"))
_header_query("png", lambda w, h: F.concat(F.lit("89504E470D0A1A0A0000000D"), _IHDR(w, h), _BIG(F.crc32(F.unhex(_IHDR(w, h))))), "w >= 1")
_header_query("png_bad_checksum", lambda w, h: F.concat(F.lit("89504E470D0A1A0A0000000D"), _IHDR(w, h), F.lit("00000001")), "false")
_header_query("gif", lambda w, h: F.concat(F.lit("474946383961"), _le(w, 2), _le(h, 2), F.lit("800000")), "w >= 1")
_header_query("bmp", lambda w, h: F.concat(F.lit("424D"), F.lit("00" * 8), F.lit("3600000028000000"), _le(w, 4), _le(-h, 4), F.lit("01001800"), F.lit("00" * 24)), "w >= 1")
_header_query("webp_lossy", lambda w, h: F.concat(F.lit("5249464600000000574542505650382000000000000000"), F.lit("9D012A"), _le(w, 2), _le(h, 2)), "w >= 1")
_header_query("webp_lossless", lambda w, h: F.concat(F.lit("5249464600000000574542505650384C000000002F"), _le((w - 1).bitwiseAND(0x3FFF).bitwiseOR(F.shiftleft(h - 1, 14)), 4)), "w >= 1")
_header_query("webp_extended", lambda w, h: F.concat(F.lit("5249464600000000574542505650385800000000"), F.lit("00000000"), _le(w, 3), _le(h, 3)), "false")
_header_query("truncated", lambda w, h: F.concat(F.lit("474946383961"), _le(w, 2)), "false")
# lossless files hold the width less 1 in 14 bits, so that of 0 reads 16384; extended ones both sizes less 1
SQL["probe_webp_lossless"] = f"SELECT p_partkey, ((w - 1) & 16383)::INT + 1 AS width, h::INT AS height FROM ({_SIZED})"
SQL["probe_webp_extended"] = f"SELECT p_partkey, (w + 1)::INT AS width, (h + 1)::INT AS height FROM ({_SIZED})"


@query("size_guard", f"SELECT p_partkey, CASE WHEN w * h > 500000 THEN 'Image is ' || w || 'x' || h || ' (' || w * h || ' pixels), over the 500000-pixel limit.' END AS message FROM ({_SIZED})")
def size_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sized(spark, sf_dir).select("p_partkey", H.too_large(F.col("w"), F.col("h"), 500_000).alias("message"))


# The packed layout: the same pictures as files, one row an image, against the SQL of the pixel layout.


def _files(spark: SparkSession, sf_dir: str, source: Callable[[SparkSession, str], Pixels], format: str = "png", **options) -> DataFrame:
    rasters = images.from_pixels(source(spark, sf_dir).df)
    return images.encode(images.spread(rasters, _table(spark, sf_dir, "embeddings").count()), format, **options)


def packed(name: str, source: Callable[[SparkSession, str], Pixels], spec: dict, sql: str | None, format: str = "png") -> None:
    """Pixels to rasters to files, a recipe over the files, and back."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        done = images.run(_files(spark, sf_dir, source, format), spec)
        return images.to_pixels(images.decode(done))

    query(name, sql and f"SELECT image_id, y::INT AS y, x::INT AS x, r::INT AS r, g::INT AS g, b::INT AS b, a::INT AS a FROM ({sql})")(run)


packed("codec_png", rgba, {}, RGBA)
packed("codec_tiff", rgba, {}, RGBA, "tiff")
packed("codec_bmp", rgba, {}, "SELECT image_id, y, x, " + ", ".join(f"floor({sql_over(c, 255)})::INT AS {c}" for c in "rgb") + f", 255 AS a FROM ({RGBA})", "bmp")
packed("codec_gif", rgba, {}, "SELECT image_id, y, x, " + ", ".join(f"CASE WHEN a >= 128 THEN {c} ELSE 0 END AS {c}" for c in "rgb") + f", CASE WHEN a >= 128 THEN 255 ELSE 0 END AS a FROM ({RGBA})", "gif")
packed("codec_chain", rgba, {"format": {"format": "tiff", "options": {"compression": "none"}}}, RGBA)
packed("packed_pipeline", grey, {"resize": {"maxLongEdge": 3}, "flip": {"horizontal": True}, "rotate": {"angle": 90}, "crop": {"x": 1, "y": 1, "width": 6, "height": 6}}, SQL["pipeline_canonical"])
packed("packed_resize_nearest", grey, {"resize": {"width": 13, "height": 13, "resampling": "nearest"}}, SQL["resize_nearest_up"])
packed("packed_resize_lanczos3", rgba, {"resize": {"width": 7, "height": 3, "resampling": "lanczos3"}}, SQL["resize_lanczos3_alpha"])
packed("packed_resize_bilinear", rgba, {"resize": {"width": 7, "height": 3}}, SQL["resize_bilinear_alpha"])
packed("packed_contain", grey, {"background": [9, 8, 7, 255], "resize": {"width": 12, "height": 6, "fit": "contain"}}, SQL["fit_contain"])
packed("packed_cover", grey, {"resize": {"width": 12, "height": 6, "fit": "cover"}}, SQL["fit_cover"])
packed("packed_rotate_nearest", rgba, {"background": [1, 2, 3, 4], "rotate": {"angle": -77.5, "resampling": "nearest"}}, SQL["rotate_nearest_background"])
packed("packed_rotate_bilinear", grey, {"rotate": {"angle": 15}}, SQL["rotate_bilinear"])
packed("packed_rotate_bilinear_alpha", rgba, {"rotate": {"angle": 200, "background": [250, 0, 120, 255]}}, SQL["rotate_bilinear_alpha"])
packed("packed_rotate_lanczos3", rgba, {"rotate": {"angle": 33, "resampling": "lanczos3"}}, sql_rotated_lanczos3(RGBA, 4, 33))


@query("codec_jpeg_error")
def codec_jpeg_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each picture moves through a JPEG file."""
    p = grey(spark, sf_dir)
    back = images.to_pixels(images.decode(_files(spark, sf_dir, grey, "jpeg", quality=90))).withColumnRenamed("r", "s")
    return p.df.join(back.select("image_id", "y", "x", "s"), ["image_id", "y", "x"]).groupBy("image_id").agg(F.avg(F.abs(F.col("r") - F.col("s"))).alias("mean_error"))


@query("error_rows", f"SELECT p_partkey, CASE WHEN {_SQL_SNIFF} IS NULL THEN 'UNSUPPORTED_FORMAT' ELSE 'CORRUPT_IMAGE' END AS code FROM (SELECT p_partkey, {_SQL_KIND} AS h FROM part)")
def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are only a beginning: each row its own error, and no failed job."""
    rows = _content(spark, sf_dir)
    return images.decode(images.spread(rows, rows.count())).select("p_partkey", F.col("error.code").alias("code"))


def _probe_walked(name: str, header) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _sized(spark, sf_dir).select("p_partkey", F.unhex(header(F.col("w"), F.col("h"))).alias("content"))
        return images.probe(images.spread(rows, rows.count())).select("p_partkey", "format", "width", "height", F.col("error.code").alias("code"))

    query(f"probe_{name}", f"SELECT p_partkey, CASE WHEN w >= 1 THEN '{name}' END AS format, CASE WHEN w >= 1 THEN w END::INT AS width, CASE WHEN w >= 1 THEN h END::INT AS height, CASE WHEN w < 1 THEN 'CORRUPT_IMAGE' END AS code FROM ({_SIZED})")(run)


_BIG2 = lambda v: F.lpad(F.hex(v), 4, "0")
_probe_walked("jpeg", lambda w, h: F.concat(F.lit("FFD8FFE000044A46FFFFC0000B08"), _BIG2(h), _BIG2(w), F.lit("01011100")))
_probe_walked("tiff", lambda w, h: F.concat(F.lit("4D4D002A00000008000201000004000000 01".replace(" ", "")), _BIG(w), F.lit("0101000400000001"), _BIG(h)))


# Recipes.

_SPECS = (
    ('{"version":1,"resize":{"maxLongEdge":600},"stripMetadata":true,"format":{"format":"jpeg","options":{"quality":75}}}', None, None),
    ('{"crop":{"x":4,"y":3,"width":20,"height":14},"rotate":{"angle":15},"flip":{"horizontal":true},"resize":{"width":12}}', None, None),
    ("[]", "pipeline", "pipeline must be an object, got []"),
    ('"x"', "pipeline", 'pipeline must be an object, got "x"'),
    ('{"version":2}', "pipeline.version", "pipeline.version is not a version this library understands (1), got 2"),
    ('{"blur":3}', "pipeline.blur", "pipeline.blur is not a pipeline stage (expected one of version, crop, rotate, flip, resize, format, stripMetadata, background), got 3"),
    ('{"crop":{"x":"0","y":0,"width":1,"height":1}}', "pipeline.crop.x", 'pipeline.crop.x must be a number, got "0"'),
    ('{"rotate":{"angle":"15"}}', "pipeline.rotate.angle", 'pipeline.rotate.angle must be a number, got "15"'),
    ('{"resize":{}}', "pipeline.resize", "pipeline.resize needs a maxLongEdge, a width, or a height, got {}"),
    ('{"resize":{"width":4,"resampling":"bicubic"}}', "pipeline.resize.resampling", 'pipeline.resize.resampling must be one of nearest, bilinear, lanczos3, got "bicubic"'),
    ('{"resize":{"width":4,"fit":"stretch"}}', "pipeline.resize.fit", 'pipeline.resize.fit must be one of fill, contain, cover, got "stretch"'),
    ('{"format":{"format":"heic"}}', "pipeline.format.format", 'pipeline.format.format must be one of png, jpeg, gif, bmp, tiff, webp, got "heic"'),
    ('{"background":[1,2,3]}', "pipeline.background", "pipeline.background must be an [r, g, b, a] array of four numbers, got [1,2,3]"),
    ('{"stripMetadata":"yes"}', "pipeline.stripMetadata", 'pipeline.stripMetadata must be a boolean, got "yes"'),
    ('{"crop":null}', "pipeline.crop.x", "pipeline.crop.x must be a number, got undefined"),
    ('{"format":{"format":"png","options":{"quality":80}}}', None, None),
)


def _sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


@query("spec_validate", f"SELECT event_id, ({_sql_list(s[1] for s in _SPECS)})[(event_id % {len(_SPECS)} + 1)::INT] AS option, ({_sql_list(s[2] for s in _SPECS)})[(event_id % {len(_SPECS)} + 1)::INT] AS message FROM events")
def spec_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipes as a column, each checked by itself."""
    rows = _table(spark, sf_dir, "events").select("event_id", F.get(F.lit([s[0] for s in _SPECS]), (F.col("event_id") % len(_SPECS)).cast("int")).alias("spec"))
    return images.check_specs(images.spread(rows, rows.count())).select("event_id", "error.option", "error.message")


@query("spec_per_row", f"SELECT vec_id AS image_id, CASE WHEN vec_id % 3 = 1 THEN 'INVALID_OPTION' END AS code, CASE vec_id % 3 WHEN 0 THEN 5 WHEN 2 THEN 8 END::INT AS width FROM embeddings")
def spec_per_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recipe of its own for each file: one shrinks, one is refused, one is empty."""
    recipes = F.lit(['{"resize":{"maxLongEdge":5}}', '{"crop":{"x":7,"y":0,"width":2,"height":1}}', "{}"])
    files = _files(spark, sf_dir, grey).drop("error").withColumn("spec", F.get(recipes, (F.col("image_id") % 3).cast("int")))
    done = images.run_each(files)
    size = H.header_size(F.col("content"))
    return done.select("image_id", F.col("error.code").alias("code"), size["width"].alias("width"))


@query("option_whitelist", "SELECT p_partkey, f AS format, o AS option, CASE WHEN NOT list_contains(CASE f WHEN 'jpeg' THEN ['quality', 'background'] WHEN 'gif' THEN ['colors', 'dither'] WHEN 'bmp' THEN ['background'] WHEN 'tiff' THEN ['compression'] WHEN 'webp' THEN ['quality', 'lossless'] ELSE [''] END, o) THEN 'encode.' || o END AS refused FROM (SELECT p_partkey, ['png', 'jpeg', 'gif', 'bmp', 'tiff', 'webp'][(p_partkey % 6 + 1)::INT] AS f, ['quality', 'background', 'colors', 'dither', 'compression', 'lossless', 'blur'][(p_partkey % 7 + 1)::INT] AS o FROM part)")
def option_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    formats, options = list(S.OPTIONS), ["quality", "background", "colors", "dither", "compression", "lossless", "blur"]
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.get(F.lit(formats), (F.col("p_partkey") % 6).cast("int")).alias("format"), F.get(F.lit(options), (F.col("p_partkey") % 7).cast("int")).alias("option"))
    table = spark.createDataFrame([(f, list(o)) for f, o in S.OPTIONS.items()], "format string, known array<string>")
    met = rows.join(F.broadcast(table), "format")
    return met.select("p_partkey", "format", "option", F.when(~F.array_contains("known", F.col("option")), F.concat(F.lit("encode."), "option")).alias("refused"))


@query("supported_formats", "SELECT * FROM (VALUES ('png', true), ('jpeg', true), ('gif', true), ('bmp', true), ('tiff', true)) t(format, read)")
def supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those that need nothing loaded."""
    known = catalog.supported_formats()
    return spark.createDataFrame([(f, f in known["read"]) for f in S.FORMATS if f != "webp"], "format string, read boolean")


def queries() -> dict[str, Query]:
    from . import file_queries  # noqa: F401  (adds its own)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import file_queries  # noqa: F401

    return dict(SQL)
