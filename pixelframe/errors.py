"""Typed errors, and the struct column that carries one for each row."""

from __future__ import annotations

import json
import math
from typing import Any

from pyspark.sql import types as T

CODES = ("UNSUPPORTED_FORMAT", "CORRUPT_IMAGE", "FORMAT_MISMATCH", "INVALID_OPTION", "IMAGE_TOO_LARGE", "CODEC_LOAD_FAILED", "ENCODE_FAILED")
#: A row's error: null where all went well.
ERROR = T.StructType([T.StructField("code", T.StringType()), T.StructField("message", T.StringType()), T.StructField("option", T.StringType()), T.StructField("pixels", T.LongType()), T.StructField("limit", T.LongType()), T.StructField("detected_magic", T.StringType())])


class ImageError(Exception):
    """Any error of the engine; `code` is one of CODES."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code

    def row(self) -> dict[str, Any]:
        return {"code": self.code, "message": str(self)} | {k: getattr(self, k, None) for k in ("option", "pixels", "limit", "detected_magic")}


class CorruptImage(ImageError):
    def __init__(self, message: str):
        super().__init__("CORRUPT_IMAGE", message)


class InvalidOption(ImageError):
    def __init__(self, option: str, value: Any, reason: str):
        super().__init__("INVALID_OPTION", f"{option} {reason}, got {shown(value)}")
        self.option, self.value = option, value


class ImageTooLarge(ImageError):
    def __init__(self, width: int, height: int, limit: int):
        super().__init__("IMAGE_TOO_LARGE", f"Image is {width}x{height} ({width * height} pixels), over the {limit}-pixel limit.")
        self.pixels, self.limit = width * height, limit


class UnsupportedFormat(ImageError):
    def __init__(self, content: bytes, reason: str | None = None):
        self.detected_magic = content[:12].hex(" ")
        super().__init__("UNSUPPORTED_FORMAT", reason or (f"Not a supported image format. First bytes: {self.detected_magic}" if content else "Not an image: the file is empty."))


class Missing:
    """The value of an option that isn't there; unlike None, which is a JSON null."""

    def __repr__(self) -> str:
        return "undefined"


MISSING = Missing()


def shown(value: Any) -> str:
    """A value as compact JSON; whole floats as integers, numbers without a JSON form as null."""
    if value is MISSING:
        return "undefined"
    if isinstance(value, float) and not math.isfinite(value):
        return "null"
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    try:
        return json.dumps(value, separators=(",", ":"), ensure_ascii=False)
    except (TypeError, ValueError):
        return str(value)


def is_number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def is_integer(value: Any) -> bool:
    return is_number(value) and math.isfinite(value) and float(value).is_integer()
