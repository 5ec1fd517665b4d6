"""WebP: sizes from the header; lossless pixels here, lossy ones by a library, where one can be imported. It is looked for once
in a process, when first needed, and what came of it holds from then on."""

from __future__ import annotations

import importlib
import math
import struct

import numpy as np

from ...errors import CorruptImage, ImageError, InvalidOption, is_number, shown
from ...operators.rasters import Raster
from . import vp8l

#: Modules that may decode and encode, in this order.
BACKENDS = ("PIL.Image",)
_state: dict = {}


def probe(content: bytes) -> tuple[int, int]:
    if content[:4] != b"RIFF" or content[8:12] != b"WEBP" or len(content) < 30:
        raise CorruptImage("WebP header missing or truncated")
    kind = content[12:16]
    if kind == b"VP8 ":
        if content[23:26] != b"\x9d\x01\x2a":
            raise CorruptImage("WebP frame does not begin with its start code")
        size = tuple(v & 0x3FFF for v in struct.unpack_from("<HH", content, 26))
    elif kind == b"VP8L":
        if content[20] != 0x2F:
            raise CorruptImage("WebP lossless data does not begin with its signature")
        (packed,) = struct.unpack_from("<I", content, 21)
        size = (packed & 0x3FFF) + 1, (packed >> 14 & 0x3FFF) + 1
    elif kind == b"VP8X":
        size = int.from_bytes(content[24:27], "little") + 1, int.from_bytes(content[27:30], "little") + 1
    else:
        raise CorruptImage(f"WebP chunk {kind!r} is not known")
    if min(size) < 1:
        raise CorruptImage(f"WebP size {size[0]}x{size[1]} is not valid")
    return size


def load():
    """The library; the first failure is raised again by every later call."""
    if not _state:
        _state["error"] = ImageError("CODEC_LOAD_FAILED", f"The WebP codec could not be loaded: none of {', '.join(BACKENDS)} can be imported")
        for name in BACKENDS:
            try:
                _state["codec"] = importlib.import_module(name)
                _state["error"] = None
                break
            except ImportError:
                continue
    if _state["error"]:
        raise _state["error"]
    return _state["codec"]


def attempted() -> bool:
    return bool(_state)


def failed() -> bool:
    return bool(_state.get("error"))


def failure() -> str | None:
    return str(_state["error"]) if failed() else None


def decode(content: bytes) -> Raster:
    import io

    size = probe(content)
    if (data := vp8l.find(content)) is not None:
        image = vp8l.decode(data)
    else:
        codec = load()
        try:
            image = np.array(codec.open(io.BytesIO(content)).convert("RGBA"))
        except Exception as e:
            raise CorruptImage(f"WebP data does not decode: {e}") from e
    if (image.shape[1], image.shape[0]) != size:
        raise CorruptImage("WebP data has another size than its header")
    return image


def encode(image: Raster, quality: float | None = None, lossless: bool = False) -> bytes:
    import io

    if lossless and quality is not None:
        raise InvalidOption("encode.quality", quality, "is ignored when lossless is true; pass one or the other")
    quality = 80 if quality is None else quality
    if not is_number(quality) or not math.isfinite(quality) or not 1 <= quality <= 100:
        raise InvalidOption("encode.quality", quality, "must be between 1 and 100")
    if lossless:
        if max(image.shape[:2]) > 1 << 14:
            raise InvalidOption("webp.size", [image.shape[1], image.shape[0]], "must not exceed 16384")
        return vp8l.wrapped(vp8l.encode(image))
    out = io.BytesIO()
    load().fromarray(image, "RGBA").save(out, "WEBP", quality=quality)
    if not out.getvalue():
        raise ImageError("ENCODE_FAILED", f"Encoding to webp failed at quality {shown(quality)}")
    return out.getvalue()
