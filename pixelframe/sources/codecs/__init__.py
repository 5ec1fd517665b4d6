"""Codecs between file bytes and rasters. Each module has `probe(content) -> (width, height)`, `decode(content) -> raster`
and `encode(raster, **options) -> bytes`; none knows Spark."""

from __future__ import annotations

from types import ModuleType

from ...errors import UnsupportedFormat

# What files begin with, strongest signature first; RIFF files also say WEBP at byte 8.
SIGNATURES = ((b"\x89PNG\r\n\x1a\n", "png"), (b"RIFF", "webp"), (b"\xff\xd8\xff", "jpeg"), (b"GIF8", "gif"), (b"II*\0", "tiff"), (b"MM\0*", "tiff"), (b"BM", "bmp"))


def sniff(content: bytes) -> str | None:
    for signature, name in SIGNATURES:
        if content.startswith(signature) and (name != "webp" or content[8:12] == b"WEBP"):
            return name
    return None


def codec(name: str) -> ModuleType:
    from . import bmp, gif, jpeg, png, tiff, webp

    found = {"png": png, "jpeg": jpeg, "gif": gif, "bmp": bmp, "tiff": tiff, "webp": webp}.get(name)
    if found is None:
        raise UnsupportedFormat(b"", f"Cannot encode to {name}: no encoder for that format.")
    return found
