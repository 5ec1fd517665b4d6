"""Operators on a relation of pixels (image_id, y, x, r, g, b, a) whose images share one size.

Projections stay projections. Filters gather a row (or a column) of an image into one array, in order, so that the sums of
floats have one order at any number of partitions, and need one shuffle for each direction; rotation and padding gather a whole image.
Rasters of photos belong in the packed layout (operators.rasters); this one is for analysis and for checking that one.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numerics import clamp8, premultiplied, unpremultiplied
from ..plans import geometry as G

CHANNELS = ("r", "g", "b", "a")


def _literal(value: list, kind: str) -> Column:
    """A nested constant; folded once, when the plan is optimised."""
    return F.from_json(F.lit(json.dumps(value)), kind)


@dataclass(frozen=True)
class Pixels:
    df: DataFrame
    width: int
    height: int

    @classmethod
    def grey(cls, vectors: DataFrame, identifier: str, vector: str, width: int = 8, height: int = 8) -> Pixels:
        """Opaque grey images from arrays of width * height numbers about zero: (v + 0.5) * 255."""
        value = clamp8((F.col("v").cast("double") + 0.5) * 255)
        rows = vectors.select(F.col(identifier).alias("image_id"), F.posexplode(vector).alias("at", "v"))
        rows = rows.select("image_id", F.expr(f"cast(at div {width} as int)").alias("y"), (F.col("at") % width).alias("x"), value.alias("r"))
        return cls(rows.select("image_id", "y", "x", "r", F.col("r").alias("g"), F.col("r").alias("b"), F.lit(255).alias("a")), width, height)

    @classmethod
    def rgba(cls, vectors: DataFrame, identifier: str, vector: str, width: int = 4, height: int = 4) -> Pixels:
        """Images from arrays of width * height * 4 numbers, the four channels of a pixel side by side."""
        places = F.explode(F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda i: F.struct(i.alias("at"), F.slice(F.col(vector), i * 4 + 1, 4).alias("v"))))
        rows = vectors.select(F.col(identifier).alias("image_id"), places.alias("p"))
        channel = [clamp8((F.col("p.v")[k].cast("double") + 0.5) * 255).alias(c) for k, c in enumerate(CHANNELS)]
        return cls(rows.select("image_id", F.expr(f"cast(p.at div {width} as int)").alias("y"), (F.col("p.at") % width).alias("x"), *channel), width, height)

    def _to(self, df: DataFrame, width: int | None = None, height: int | None = None) -> Pixels:
        return replace(self, df=df, width=width or self.width, height=height or self.height)

    def _moved(self, y: Column, x: Column, width: int | None = None, height: int | None = None) -> Pixels:
        return self._to(self.df.select("image_id", y.cast("int").alias("y"), x.cast("int").alias("x"), *CHANNELS), width, height)

    def crop(self, x: int, y: int, width: int, height: int) -> Pixels:
        G.check_crop(x, y, width, height)
        G.check_inside(x, y, width, height, self.width, self.height)
        inside = self.df.where(F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1))
        return self._to(inside)._moved(F.col("y") - y, F.col("x") - x, width, height)

    def flip(self, horizontal: bool = False, vertical: bool = False) -> Pixels:
        x = self.width - 1 - F.col("x") if horizontal else F.col("x")
        return self._moved(self.height - 1 - F.col("y") if vertical else F.col("y"), x)

    def rotate90(self, angle: float) -> Pixels:
        x, y, w, h = F.col("x"), F.col("y"), self.width, self.height
        turns = G.quarter_turns(angle)
        if turns is None:
            raise G.InvalidOption("rotate.angle", angle, "rotate90 only accepts multiples of 90")
        return [lambda: self, lambda: self._moved(x, h - 1 - y, h, w), lambda: self._moved(h - 1 - y, w - 1 - x), lambda: self._moved(w - 1 - x, y, h, w)][turns]()

    def oriented(self, orientation: int) -> Pixels:
        out = self.flip(horizontal=True) if orientation in (2, 5, 7) else self.flip(vertical=True) if orientation == 4 else self
        return out.rotate90({3: 180, 5: 270, 6: 90, 7: 90, 8: 270}.get(orientation, 0))

    def has_alpha(self) -> DataFrame:
        return self.df.groupBy("image_id").agg(F.bool_or(F.col("a") != 255).alias("has_alpha"))

    def _colours(self, f) -> Pixels:
        return self._to(self.df.select("image_id", "y", "x", *(f(F.col(c), F.col("a")).alias(c) for c in "rgb"), "a"))

    def premultiply(self) -> Pixels:
        return self._colours(premultiplied)

    def unpremultiply(self) -> Pixels:
        return self._colours(unpremultiplied)

    def _filter(self, axis: str, n: int, out: int, kernel: str) -> DataFrame:
        other = "y" if axis == "x" else "x"
        line = self.df.groupBy("image_id", other).agg(F.array_sort(F.collect_list(F.struct(axis, *CHANNELS))).alias("line"))
        plan = _literal([[{"i": i, "w": w} for i, w in t] for t in G.taps(n, out, kernel)], "array<array<struct<i:int,w:double>>>")

        def summed(tap: Column, channel: str) -> Column:
            terms = F.transform(tap, lambda t: F.get(F.col("line"), t["i"])[channel] * t["w"])
            return clamp8(F.aggregate(terms, F.lit(0.0), lambda total, term: total + term)).alias(channel)

        sums = F.transform(plan, lambda tap: F.struct(*(summed(tap, c) for c in CHANNELS)))
        rows = line.select("image_id", other, F.posexplode(sums).alias(axis, "p"))
        return rows.select("image_id", "y", "x", *(F.col(f"p.{c}").alias(c) for c in CHANNELS))

    def resample(self, width: int, height: int, kernel: str = "bilinear", alpha: bool = True) -> Pixels:
        """alpha: False where all images are known to be opaque, which saves two projections."""
        G.check_kernel(kernel, "resize.resampling")
        if (width, height) == (self.width, self.height):
            return self
        if kernel == "nearest":
            takers = {axis: [[o for o, i in enumerate(G.nearest_places(n, out)) if i == k] for k in range(n)] for axis, n, out in (("x", self.width, width), ("y", self.height, height))}
            to = {axis: F.get(_literal(lists, "array<array<int>>"), F.col(axis)) for axis, lists in takers.items()}
            rows = self.df.select("image_id", "x", F.explode(to["y"]).alias("y"), *CHANNELS).select("image_id", "y", F.explode(to["x"]).alias("x"), *CHANNELS)
            return self._to(rows, width, height)
        source = self.premultiply() if alpha else self
        wide = self._to(source._filter("x", self.width, width, kernel), width)
        out = self._to(wide._filter("y", self.height, height, kernel), width, height)
        return out.unpremultiply() if alpha else out

    def _gathered(self, plan: list, kind: str, pixel, width: int, height: int) -> Pixels:
        """Each destination pixel, in rows, from an entry of the plan and the whole image as an array."""
        whole = self.df.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", *CHANNELS))).alias("image"))
        rows = whole.select("image_id", F.posexplode(F.transform(_literal(plan, kind), pixel)).alias("at", "p"))
        rows = rows.select("image_id", F.expr(f"cast(at div {width} as int)").alias("y"), (F.col("at") % width).alias("x"), *(F.col(f"p.{c}").alias(c) for c in CHANNELS))
        return self._to(rows, width, height)

    def _picked(self, plan: list[int], fill: Sequence[int], width: int, height: int) -> Pixels:
        def pixel(i: Column) -> Column:
            return F.struct(*(F.when(i < 0, F.lit(int(f))).otherwise(F.get(F.col("image"), i)[c]).alias(c) for c, f in zip(CHANNELS, fill, strict=True)))

        return self._gathered(plan, "array<int>", pixel, width, height)

    def resize(self, width: int | None = None, height: int | None = None, fit: str = "fill", upscale: bool = True, resampling: str = "bilinear", background: Sequence[int] = G.WHITE, alpha: bool = True) -> Pixels:
        G.check_resize(width, height, resampling)
        plan = G.Resize.of(self.width, self.height, width, height, fit, upscale)
        if plan.same:
            return self
        inner = self.resample(plan.inner_width, plan.inner_height, resampling, alpha)
        if (plan.inner_width, plan.inner_height) == (plan.width, plan.height):
            return inner
        if fit == "cover":
            return inner.crop(plan.left, plan.top, plan.width, plan.height)
        places = [(y - plan.top) * inner.width + x - plan.left if 0 <= y - plan.top < inner.height and 0 <= x - plan.left < inner.width else -1 for y in range(plan.height) for x in range(plan.width)]
        return inner._picked(places, background, plan.width, plan.height)

    def max_long_edge(self, size: int, resampling: str = "bilinear", alpha: bool = True) -> Pixels:
        G.check_length(size, "maxLongEdge.size")
        plan = G.Resize.capped(self.width, self.height, size)
        return self if plan.same else self.resample(plan.width, plan.height, resampling, alpha)

    def rotate(self, angle: float, resampling: str = "bilinear", background: Sequence[int] | None = None, max_pixels: int = G.MAX_PIXELS, alpha: bool = True) -> Pixels:
        G.check_angle(angle)
        if G.quarter_turns(angle) is not None:
            return self.rotate90(angle)
        G.check_kernel(resampling, "rotate.resampling")
        plan = G.Rotation.of(self.width, self.height, angle, max_pixels)
        if resampling == "lanczos3":
            return self._lanczos3(plan, tuple(background or G.CLEAR))
        if resampling == "nearest":
            return self._picked(nearest_plan(plan), background or G.CLEAR, plan.width, plan.height)
        fill = tuple(background or G.CLEAR)
        source = self.premultiply() if alpha else self

        def pixel(t: Column) -> Column:
            def total(c: str) -> Column:
                taps = [F.get(F.col("image"), t[f"i{k}"])[c] * t[f"w{k}"] for k in range(4)]
                return taps[0] + taps[1] + taps[2] + taps[3]

            a = total("a")
            scale = F.lit(255.0) / a if alpha else F.lit(1.0)
            hidden = t["i0"].isNull() | (a == 0)
            shown = [clamp8(total(c) * scale) for c in "rgb"] + [clamp8(a)]
            return F.struct(*(F.when(hidden, F.lit(int(f))).otherwise(v).alias(c) for c, f, v in zip(CHANNELS, fill, shown, strict=True)))

        kind = "array<struct<" + ",".join([f"i{k}:int" for k in range(4)] + [f"w{k}:double" for k in range(4)]) + ">>"
        return source._gathered(bilinear_plan(plan), kind, pixel, plan.width, plan.height)


    def _lanczos3(self, plan: G.Rotation, fill: Sequence[int]) -> Pixels:
        def pixel(t: Column) -> Column:
            def total(value) -> Column:
                return F.aggregate(t["taps"], F.lit(0.0), lambda s, tap: s + value(F.get(F.col("image"), tap["i"])) * tap["w"])

            a = total(lambda p: p["a"].cast("double")) * t["norm"]
            colours = [total(lambda p, c=c: p[c] * (p["a"] / F.lit(255.0))) * t["norm"] * (F.lit(255.0) / a) for c in "rgb"]
            return F.struct(*(F.when(t["norm"].isNull() | (a <= 0), F.lit(int(f))).otherwise(clamp8(v)).alias(c) for c, f, v in zip(CHANNELS, fill, [*colours, a], strict=True)))

        return self._gathered(lanczos3_plan(plan), "array<struct<norm:double,taps:array<struct<i:int,w:double>>>>", pixel, plan.width, plan.height)


def lanczos3_plan(plan: G.Rotation) -> list[dict]:
    """The source pixels within three of each destination pixel's place, their weights, and what these are divided by."""
    out, w, h = [], plan.source_width, plan.source_height
    for row in plan.places(0.0):
        for sx, sy in row:
            x, y, taps, total = sx - 0.5, sy - 0.5, [], 0.0
            if -0.5 <= sx <= w - 0.5 and -0.5 <= sy <= h - 0.5:
                for j in range(max(0, math.ceil(y - 3)), min(h - 1, math.floor(y + 3)) + 1):
                    for i in range(max(0, math.ceil(x - 3)), min(w - 1, math.floor(x + 3)) + 1):
                        taps.append({"i": j * w + i, "w": G.kernel_weight(j - y, "lanczos3") * G.kernel_weight(i - x, "lanczos3")})
                        total += taps[-1]["w"]
            out.append({"norm": 1 / total, "taps": taps} if total else {})
    return out


def nearest_plan(plan: G.Rotation) -> list[int]:
    """The source pixel of each destination pixel, in rows; -1 outside."""
    out = []
    for row in plan.places(0.5):
        for sx, sy in row:
            x, y = G.half_up(sx), G.half_up(sy)
            out.append(y * plan.source_width + x if 0 <= x < plan.source_width and 0 <= y < plan.source_height else -1)
    return out


def bilinear_plan(plan: G.Rotation) -> list[dict]:
    """Four source pixels and weights of each destination pixel, in rows; none outside."""
    out, w, h = [], plan.source_width, plan.source_height
    for row in plan.places(0.5):
        for sx, sy in row:
            if sx < -0.5 or sy < -0.5 or sx > w - 0.5 or sy > h - 0.5:
                out.append({})
                continue
            x, y = int(sx // 1), int(sy // 1)
            fx, fy = sx - x, sy - y
            xs, ys = [min(max(x + d, 0), w - 1) for d in (0, 1)], [min(max(y + d, 0), h - 1) for d in (0, 1)]
            out.append({f"i{2 * j + i}": ys[j] * w + xs[i] for j in (0, 1) for i in (0, 1)} | {"w0": (1 - fx) * (1 - fy), "w1": fx * (1 - fy), "w2": (1 - fx) * fy, "w3": fx * fy})
    return out
