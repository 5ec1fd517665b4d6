"""The numeric rules as column expressions; their numpy twins are in operators.rasters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp8(value: Column) -> Column:
    """A double to a byte: halves to even, cut to 0..255."""
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.rint(value))).cast("int")


def half_up(value: Column) -> Column:
    return F.floor(value + F.lit(0.5)).cast("int")


def truncated(value: Column) -> Column:
    return F.floor(value).cast("int")


def premultiplied(value: Column, alpha: Column) -> Column:
    return clamp8(value * (alpha / F.lit(255.0)))


def unpremultiplied(value: Column, alpha: Column) -> Column:
    return F.when(alpha == 0, 0).otherwise(clamp8(value * (F.lit(255.0) / alpha)))


def over(value: Column, alpha: Column, background: float) -> Column:
    """A colour composited on a background, as a double."""
    share = alpha / F.lit(255.0)
    return value * share + F.lit(float(background)) * (F.lit(1.0) - share)


def luma(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Y, Cb, Cr as doubles, by the full-range weights of JPEG files."""
    y = r * 0.299 + g * 0.587 + b * 0.114
    cb = 128.0 - r * 0.168736 - g * 0.331264 + b * 0.5
    cr = 128.0 + r * 0.5 - g * 0.418688 - b * 0.081312
    return y, cb, cr


def rgb_of(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    """RGB bytes from byte-valued Y, Cb, Cr in 16-bit fixed point with rounding."""
    cb, cr = cb - 128, cr - 128
    cut = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), v)).cast("int")
    red = y + F.shiftright(91881 * cr + 32768, 16)
    green = y + F.shiftright(-22554 * cb - 46802 * cr + 32768, 16)
    blue = y + F.shiftright(116130 * cb + 32768, 16)
    return cut(red), cut(green), cut(blue)


def paeth(left: Column, up: Column, corner: Column) -> Column:
    """The neighbour nearest to left + up - corner; ties to left, then up."""
    guess = left + up - corner
    a, b, c = F.abs(guess - left), F.abs(guess - up), F.abs(guess - corner)
    return F.when((a <= b) & (a <= c), left).when(b <= c, up).otherwise(corner)


def quantiser_step(base: Column, quality: Column) -> Column:
    """An entry of a quantisation table at a quality of 1..100, cut to 1..255."""
    scale = F.when(quality < 50, F.floor(F.lit(5000) / quality)).otherwise(200 - 2 * quality)
    return F.greatest(F.lit(1), F.least(F.lit(255), F.floor((base * scale + 50) / 100))).cast("int")


def magnitude(value: Column) -> Column:
    """Bits of the absolute value: the category of a coefficient."""
    return F.when(value == 0, 0).otherwise(F.length(F.bin(F.abs(value)))).cast("int")
