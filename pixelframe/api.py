"""The engine's names in one place: recipes bound to bytes, files or tables, and the functions they are made of.

    from_buffer(content).crop(0, 0, 8, 8).to_format("png").to_buffer()      # one image, here
    from_table(files).crop(0, 0, 8, 8).to_format("png").to_table()         # a table of them, on the cluster
    Pipeline(json_text).run_table(files)                                    # a stored recipe
"""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

from .catalog import preload, supported_formats
from .errors import CODES, CorruptImage, ImageError, ImageTooLarge, InvalidOption, UnsupportedFormat
from .operators.rasters import Raster, create, crop, flip, has_alpha, max_long_edge, premultiply, resize, rotate, rotate90, unpremultiply
from .operators.rasters import from_bytes as raster_from_bytes
from .plans.spec import FORMATS, Builder, validate
from .sources import images
from .sources.codecs import bmp, codec, gif, jpeg, png, sniff, tiff, webp
from .sources.images import apply_spec, decode_bytes, encode_raster, run_bytes

decode_png, encode_png, probe_png = png.decode, png.encode, png.probe
decode_jpeg, encode_jpeg, probe_jpeg = jpeg.decode, jpeg.encode, jpeg.probe
decode_gif, encode_gif, probe_gif = gif.decode, gif.encode, gif.probe
decode_bmp, encode_bmp, probe_bmp = bmp.decode, bmp.encode, bmp.probe
decode_tiff, encode_tiff, probe_tiff = tiff.decode, tiff.encode, tiff.probe
decode_webp, encode_webp, probe_webp = webp.decode, webp.encode, webp.probe
decode, encode, run_pipeline, validate_spec = decode_bytes, encode_raster, run_bytes, validate


def probe(content: bytes) -> tuple[int, int]:
    """Width and height as stored, from the header alone."""
    found = sniff(content)
    if found is None:
        raise UnsupportedFormat(content)
    return codec(found).probe(content)


def copy_image(image: Raster) -> Raster:
    return image.copy()


class _Chain(Builder):
    """A recipe with its input; nothing runs before the last call, and every last call runs anew."""

    def __init__(self, source: Any, spec: dict[str, Any] | None = None):
        super().__init__(spec)
        self.source = source


class BufferChain(_Chain):
    def to_buffer(self) -> bytes:
        return run_bytes(self.source, self.spec)

    def to_file(self, path: str) -> None:
        Path(path).write_bytes(self.to_buffer())


class TableChain(_Chain):
    def to_table(self, **options: Any) -> DataFrame:
        """The table with the results in its column content, and error."""
        return images.run(self.source, self.spec, **options)


def from_buffer(content: bytes) -> BufferChain:
    return BufferChain(content)


def from_file(path: str) -> BufferChain:
    """A path that isn't there raises as the file system says it."""
    return BufferChain(Path(path).read_bytes())


def from_table(files: DataFrame) -> TableChain:
    return TableChain(files)


class Pipeline(Builder):
    """A recipe without an input, checked when it is made, to run on any number of them."""

    def __init__(self, spec: dict[str, Any] | str | None = None):
        super().__init__(json.loads(spec) if isinstance(spec, str) else spec)

    def run(self, content: bytes) -> bytes:
        return run_bytes(content, self.spec)

    def run_table(self, files: DataFrame, **options: Any) -> DataFrame:
        return images.run(files, self.spec, **options)


__all__ = ["CODES", "FORMATS", "BufferChain", "CorruptImage", "ImageError", "ImageTooLarge", "InvalidOption", "Pipeline", "TableChain", "UnsupportedFormat", "apply_spec", "copy_image", "create", "crop", "flip", "from_buffer", "from_file", "from_table", "has_alpha", "max_long_edge", "preload", "premultiply", "probe", "raster_from_bytes", "resize", "rotate", "rotate90", "sniff", "supported_formats", "unpremultiply"]
