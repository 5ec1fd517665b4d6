"""The engine as SQL functions: image_format, image_probe, image_result (content and error), image_run and image_error (either of
the two alone) and the table function image_pixels.

Header functions of PNG, GIF, BMP and WebP exist as plain expressions in functions.headers; those don't leave the JVM.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ImageError
from ..plans.spec import validate
from ..sources.codecs import codec, sniff
from ..sources.images import decode_bytes, run_bytes


@F.pandas_udf(T.StringType())
def image_format(content: pd.Series) -> pd.Series:
    return content.map(lambda c: None if c is None else sniff(bytes(c)))


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def image_probe(content: pd.Series) -> pd.DataFrame:
    """Width and height as stored; nulls for what isn't an image."""

    def one(c: bytes | None) -> tuple[int | None, int | None]:
        try:
            return codec(sniff(bytes(c)) or "").probe(bytes(c))
        except (ImageError, TypeError):
            return None, None

    return pd.DataFrame([one(c) for c in content], columns=["width", "height"], dtype="Int32")


def _ran(content: bytes | None, spec: str) -> bytes | ImageError | None:
    if content is None:
        return None
    try:
        try:
            recipe = json.loads(spec)
        except ValueError:
            recipe = spec
        return run_bytes(bytes(content), validate(recipe))
    except ImageError as e:
        return e


@F.pandas_udf(T.StructType([T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())]))
def image_result(content: pd.Series, spec: pd.Series) -> pd.DataFrame:
    """The file after a recipe, or what went wrong, from one run."""
    done = [_ran(c, s) for c, s in zip(content, spec, strict=True)]
    return pd.DataFrame({"content": pd.Series([None if isinstance(d, ImageError) else d for d in done], dtype=object), "error": pd.Series([f"{d.code}: {d}" if isinstance(d, ImageError) else None for d in done], dtype=object)})


@F.pandas_udf(T.BinaryType())
def image_run(content: pd.Series, spec: pd.Series) -> pd.Series:
    """The file after a recipe; null where that fails: image_error says why."""
    done = (_ran(c, s) for c, s in zip(content, spec, strict=True))
    return pd.Series([None if isinstance(d, ImageError) else d for d in done])


@F.pandas_udf(T.StringType())
def image_error(content: pd.Series, spec: pd.Series) -> pd.Series:
    done = (_ran(c, s) for c, s in zip(content, spec, strict=True))
    return pd.Series([f"{d.code}: {d}" if isinstance(d, ImageError) else None for d in done])


@F.udtf(returnType=T.StructType([T.StructField(c, T.IntegerType()) for c in ("y", "x", "r", "g", "b", "a")]))
class image_pixels:  # noqa: N801
    """A row for each pixel of a file; none for what isn't an image."""

    def eval(self, content: bytes) -> Iterator[tuple[int, ...]]:
        try:
            image = decode_bytes(bytes(content or b""))
        except ImageError:
            return
        for y, row in enumerate(image.tolist()):
            for x, colour in enumerate(row):
                yield (y, x, *colour)


def register(spark: SparkSession) -> None:
    for f in (image_format, image_probe, image_result, image_run, image_error):
        spark.udf.register(f.__name__, f)
    spark.udtf.register("image_pixels", image_pixels)
