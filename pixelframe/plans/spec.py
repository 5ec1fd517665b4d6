"""Recipes: a JSON record with a slot for each operator, always run in the order crop, rotate, flip, resize, format."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from ..errors import MISSING, InvalidOption, is_number
from . import geometry as G

VERSION = 1
SLOTS = ("version", "crop", "rotate", "flip", "resize", "format", "stripMetadata", "background")
FORMATS = ("png", "jpeg", "gif", "bmp", "tiff", "webp")
#: Options that an encoder takes.
OPTIONS = {"png": (), "jpeg": ("quality", "background"), "gif": ("colors", "dither"), "bmp": ("background",), "tiff": ("compression",), "webp": ("quality", "lossless")}


def validate(spec: Any) -> dict[str, Any]:
    """The recipe itself if its shape is right. Ranges, formats' options and what depends on an image are checked when it runs."""
    if not isinstance(spec, dict):
        raise InvalidOption("pipeline", spec, "must be an object")
    version = spec.get("version", MISSING)
    if version is not MISSING and (not is_number(version) or version != VERSION):
        raise InvalidOption("pipeline.version", version, f"is not a version this library understands ({VERSION})")
    for key, value in spec.items():
        if key not in SLOTS:
            raise InvalidOption(f"pipeline.{key}", value, f"is not a pipeline stage (expected one of {', '.join(SLOTS)})")

    def part(slot: str, field: str) -> Any:
        return spec[slot].get(field, MISSING) if isinstance(spec[slot], dict) else MISSING

    def must(ok: bool, option: str, value: Any, reason: str) -> None:
        if not ok:
            raise InvalidOption(f"pipeline.{option}", value, reason)

    if "crop" in spec:
        for field in ("x", "y", "width", "height"):
            must(is_number(part("crop", field)), f"crop.{field}", part("crop", field), "must be a number")
    if "rotate" in spec:
        must(is_number(part("rotate", "angle")), "rotate.angle", part("rotate", "angle"), "must be a number")
    if "resize" in spec:
        stage = spec["resize"]
        must(isinstance(stage, dict), "resize", stage, "must be an object")
        must(any(k in stage for k in ("maxLongEdge", "width", "height")), "resize", stage, "needs a maxLongEdge, a width, or a height")
        rules: dict[str, tuple[Callable[[Any], bool], str]] = {k: (is_number, "must be a number") for k in ("maxLongEdge", "width", "height")}
        rules["upscale"] = (lambda v: isinstance(v, bool), "must be a boolean")
        for name, values in (("fit", G.FITS), ("resampling", G.KERNELS)):
            rules[name] = (lambda v, values=values: v in values, f"must be one of {', '.join(values)}")
        for field, (ok, reason) in rules.items():
            must(field not in stage or ok(stage[field]), f"resize.{field}", stage.get(field), reason)
    if "format" in spec:
        name = part("format", "format")
        must(isinstance(name, str) and name in FORMATS, "format.format", name, f"must be one of {', '.join(FORMATS)}")
    if "stripMetadata" in spec:
        must(isinstance(spec["stripMetadata"], bool), "stripMetadata", spec["stripMetadata"], "must be a boolean")
    if "background" in spec:
        colour = spec["background"]
        must(isinstance(colour, list | tuple) and len(colour) == 4 and all(map(is_number, colour)), "background", colour, "must be an [r, g, b, a] array of four numbers")
    return spec


def check_options(format: str, options: dict[str, Any]) -> None:
    for key, value in options.items():
        if key not in OPTIONS[format]:
            raise InvalidOption(f"encode.{key}", value, f"{format} takes only {', '.join(OPTIONS[format])}" if OPTIONS[format] else f"{format} takes no options")


def stages(spec: dict[str, Any]) -> list[tuple[str, dict[str, Any]]]:
    """The stages that a recipe has, in the order in which they run, with the recipe's background where they take one."""
    found = []
    fill = {"background": tuple(spec["background"])} if "background" in spec else {}
    if "crop" in spec:
        found.append(("crop", dict(spec["crop"])))
    if "rotate" in spec:
        found.append(("rotate", fill | spec["rotate"]))
    if "flip" in spec:
        found.append(("flip", dict(spec["flip"])))
    if "resize" in spec:
        stage = spec["resize"]
        found.append(("max_long_edge", dict(stage)) if "maxLongEdge" in stage else ("resize", fill | stage))
    return found


class Builder:
    """Records a slot with each call, the last call winning; nothing runs. Crop, rotate and resize check their arguments at once."""

    def __init__(self, spec: dict[str, Any] | None = None):
        self.spec: dict[str, Any] = {"version": VERSION} | (dict(validate(spec)) if spec else {})

    def _with(self, slot: str, value: Any) -> Builder:
        self.spec[slot] = value
        return self

    def crop(self, x: int, y: int, width: int, height: int) -> Builder:
        G.check_crop(x, y, width, height)
        return self._with("crop", {"x": x, "y": y, "width": width, "height": height})

    def rotate(self, angle: float, **options: Any) -> Builder:
        G.check_angle(angle)
        if "resampling" in options:
            G.check_kernel(options["resampling"], "rotate.resampling")
        return self._with("rotate", {"angle": angle, **options})

    def flip(self, horizontal: bool = False, vertical: bool = False) -> Builder:
        return self._with("flip", {"horizontal": horizontal, "vertical": vertical})

    def resize(self, width: int | None = None, height: int | None = None, **options: Any) -> Builder:
        G.check_resize(width, height, options.get("resampling"))
        return self._with("resize", {k: v for k, v in {"width": width, "height": height, **options}.items() if v is not None})

    def max_long_edge(self, size: int, **options: Any) -> Builder:
        return self._with("resize", {"maxLongEdge": size, **options})

    def strip_metadata(self) -> Builder:
        """Says so in the recipe; no metadata outlives decoding anyway."""
        return self._with("stripMetadata", True)

    def to_format(self, format: str, **options: Any) -> Builder:
        return self._with("format", {"format": format, "options": options})

    def background(self, colour: tuple[int, int, int, int]) -> Builder:
        return self._with("background", list(colour))

    def to_json(self) -> str:
        return json.dumps(self.spec)
