"""Sizes, filter taps and rotations: everything that depends on options and dimensions alone, worked out once on the driver.

Trigonometric functions and kernel weights come from Python's math alone, so every engine that is given them as literals
agrees to the last bit.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache
from typing import Any

from ..errors import ImageTooLarge, InvalidOption, is_integer, is_number

MAX_PIXELS = 128 * 1024 * 1024
KERNELS = ("nearest", "bilinear", "lanczos3")
FITS = ("fill", "contain", "cover")
WHITE = (255, 255, 255, 255)
CLEAR = (0, 0, 0, 0)
LEAST, MOST = 1, 20_000


def half_up(x: float) -> int:
    return math.floor(x + 0.5)


def check_kernel(kernel: Any, option: str) -> None:
    if kernel not in KERNELS:
        raise InvalidOption(option, kernel, f"must be one of {', '.join(KERNELS)}")


def check_length(value: Any, option: str) -> None:
    if not is_integer(value):
        raise InvalidOption(option, value, "must be an integer")
    if not LEAST <= value <= MOST:
        raise InvalidOption(option, value, f"must be between {LEAST} and {MOST}")


def check_crop(x: Any, y: Any, width: Any, height: Any) -> None:
    for name, value, least in (("x", x, 0), ("y", y, 0), ("width", width, 1), ("height", height, 1)):
        if not is_integer(value) or value < least:
            raise InvalidOption(f"crop.{name}", value, f"must be an integer >= {least}")


def check_inside(x: int, y: int, width: int, height: int, of_width: int, of_height: int) -> None:
    for name, start, length, whole in (("width", x, width, of_width), ("height", y, height, of_height)):
        if start + length > whole:
            raise InvalidOption(f"crop.{name}", length, f"must fit inside the image: {'x' if name == 'width' else 'y'}={start} + {name}={length} exceeds {name} {whole}")


def check_angle(angle: Any) -> None:
    if not is_number(angle) or not math.isfinite(angle):
        raise InvalidOption("rotate.angle", angle, "must be a finite number of degrees")


def check_resize(width: Any = None, height: Any = None, resampling: Any = None) -> None:
    if width is None and height is None:
        raise InvalidOption("resize", {}, "needs a width or a height")
    for name, value in (("width", width), ("height", height)):
        if value is not None:
            check_length(value, f"resize.{name}")
    if resampling is not None:
        check_kernel(resampling, "resize.resampling")


def quarter_turns(angle: float) -> int | None:
    """Clockwise quarter turns of a right angle, folded into 0..3; None for other angles."""
    turn = math.fmod(math.fmod(angle, 360) + 360, 360)
    return int(turn // 90) if turn % 90 == 0 else None


@dataclass(frozen=True)
class Rotation:
    """A destination canvas and the inverse map of its first column: the source place of the centre of (0, y), from which
    each further column adds (cos, -sin)."""

    width: int
    height: int
    cos: float
    sin: float
    source_width: int
    source_height: int

    @classmethod
    def of(cls, width: int, height: int, angle: float, max_pixels: int = MAX_PIXELS) -> Rotation:
        check_angle(angle)
        cos, sin = math.cos(angle * math.pi / 180), math.sin(angle * math.pi / 180)
        w, h = math.ceil(abs(width * cos) + abs(height * sin)), math.ceil(abs(width * sin) + abs(height * cos))
        if w * h > max_pixels:
            raise ImageTooLarge(w, h, max_pixels)
        return cls(w, h, cos, sin, width, height)

    def starts(self, shift: float) -> list[tuple[float, float]]:
        """(x, y) in the source for the first column of each row, less `shift`."""
        left, out = 0.5 - self.width / 2, []
        for y in range(self.height):
            down = y + 0.5 - self.height / 2
            out.append((left * self.cos + down * self.sin + self.source_width / 2 - shift, -left * self.sin + down * self.cos + self.source_height / 2 - shift))
        return out

    def places(self, shift: float) -> list[list[tuple[float, float]]]:
        """Source places by destination row and column, each column added to the one before."""
        rows = []
        for sx, sy in self.starts(shift):
            row = []
            for _ in range(self.width):
                row.append((sx, sy))
                sx, sy = sx + self.cos, sy - self.sin
            rows.append(row)
        return rows


def kernel_weight(x: float, kernel: str) -> float:
    d = abs(x)
    if kernel == "bilinear":
        return 1 - d if d < 1 else 0.0
    if d == 0:
        return 1.0
    return 0.0 if d >= 3 else 3 * math.sin(math.pi * d) * math.sin(math.pi * d / 3) / (math.pi * math.pi * d * d)


@cache
def taps(n: int, out: int, kernel: str) -> tuple[tuple[tuple[int, float], ...], ...]:
    """For each output place the (source place, weight) it sums, in ascending order; weights add up to 1. Shrinking widens the
    kernel. An output that no weight reaches takes its nearest source."""
    scale = out / n
    widen = max(1.0, 1 / scale)
    reach = (3 if kernel == "lanczos3" else 1) * widen
    plan = []
    for o in range(out):
        centre = (o + 0.5) / scale - 0.5
        near = range(max(0, math.ceil(centre - reach)), min(n - 1, math.floor(centre + reach)) + 1)
        found = [(i, w) for i in near if (w := kernel_weight((i - centre) / widen, kernel)) != 0]
        total = 0.0
        for _, w in found:
            total += w
        plan.append(tuple((i, w / total) for i, w in found) if total else ((min(n - 1, max(0, half_up(centre))), 1.0),))
    return tuple(plan)


def nearest_places(n: int, out: int) -> list[int]:
    return [min(n - 1, math.floor(o * (n / out))) for o in range(out)]


def scaled(length: int, scale: float) -> int:
    return max(1, half_up(length * scale))


@dataclass(frozen=True)
class Resize:
    """What a resize comes to for one source size: the filtered size, then an offset on a canvas (contain), or a cut (cover)."""

    width: int
    height: int
    inner_width: int
    inner_height: int
    left: int = 0
    top: int = 0
    same: bool = False

    @classmethod
    def of(cls, w: int, h: int, width: int | None = None, height: int | None = None, fit: str = "fill", upscale: bool = True) -> Resize:
        to_w = width if width is not None else max(1, half_up(height / h * w))
        to_h = height if height is not None else max(1, half_up(width / w * h))
        if (not upscale and (to_w > w or to_h > h)) or (to_w, to_h) == (w, h):
            return cls(w, h, w, h, same=True)
        if width is None or height is None or fit not in ("contain", "cover"):
            return cls(to_w, to_h, to_w, to_h)
        scale = (min if fit == "contain" else max)(to_w / w, to_h / h)
        in_w, in_h = scaled(w, scale), scaled(h, scale)
        if fit == "contain":
            return cls(to_w, to_h, in_w, in_h, (to_w - in_w) // 2, (to_h - in_h) // 2)
        return cls(min(to_w, in_w), min(to_h, in_h), in_w, in_h, (in_w - to_w) // 2, (in_h - to_h) // 2)

    @classmethod
    def capped(cls, w: int, h: int, longest: int) -> Resize:
        edge = max(w, h)
        if edge <= longest:
            return cls(w, h, w, h, same=True)
        to = scaled(w, longest / edge), scaled(h, longest / edge)
        return cls(*to, *to)


