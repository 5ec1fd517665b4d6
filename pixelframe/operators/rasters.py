"""Operators on rasters: numpy arrays (height, width, 4) of RGBA bytes. Every function returns a new array or, where nothing
changes, the same one."""

from __future__ import annotations

import numpy as np

from ..errors import CorruptImage, InvalidOption, is_integer
from ..plans import geometry as G

Raster = np.ndarray


def clamped(values: np.ndarray) -> np.ndarray:
    """To bytes: halves to even, cut to 0..255."""
    return np.clip(np.rint(values), 0, 255).astype(np.uint8)


def create(width: int, height: int, fill: tuple[int, ...] = G.CLEAR) -> Raster:
    for name, value in (("width", width), ("height", height)):
        if not is_integer(value) or value < 1:
            raise InvalidOption(name, value, "must be an integer >= 1")
    pixel = clamped(np.array(fill, float)).view(np.uint32)[0]
    return np.full((height, width), pixel).view(np.uint8).reshape(height, width, 4)


def from_bytes(width: int, height: int, data: bytes) -> Raster:
    if not (is_integer(width) and is_integer(height)) or width < 1 or height < 1 or len(data) != 4 * width * height:
        raise CorruptImage(f"A {width}x{height} image needs {4 * max(width, 0) * max(height, 0)} bytes, got {len(data)}")
    return np.frombuffer(data, np.uint8).reshape(height, width, 4)


def crop(image: Raster, x: int, y: int, width: int, height: int) -> Raster:
    G.check_crop(x, y, width, height)
    x, y, width, height = int(x), int(y), int(width), int(height)
    G.check_inside(x, y, width, height, image.shape[1], image.shape[0])
    return image[y : y + height, x : x + width].copy()


def flip(image: Raster, horizontal: bool = False, vertical: bool = False) -> Raster:
    return image[:: -1 if vertical else 1, :: -1 if horizontal else 1].copy()


def rotate90(image: Raster, angle: float) -> Raster:
    turns = G.quarter_turns(angle)
    if turns is None:
        raise InvalidOption("rotate.angle", angle, "rotate90 only accepts multiples of 90")
    return np.ascontiguousarray(np.rot90(image, -turns))


def has_alpha(image: Raster) -> bool:
    return bool((image[..., 3] != 255).any())


def premultiply(image: Raster) -> Raster:
    out = image.copy()
    out[..., :3] = clamped(image[..., :3] * (image[..., 3:] / 255))
    return out


def unpremultiply(image: Raster) -> Raster:
    alpha = image[..., 3:].astype(float)
    out = np.concatenate([clamped(image[..., :3] * (255 / np.maximum(alpha, 1))), image[..., 3:]], 2)
    out[image[..., 3] == 0] = 0
    return out


def composite(image: Raster, background: tuple[int, ...] = G.WHITE) -> np.ndarray:
    """Colours over a background, as floats."""
    alpha = image[..., 3:] / 255
    return image[..., :3] * alpha + np.array(background[:3], float) * (1 - alpha)


def _filtered(image: Raster, out: int, kernel: str, axis: int) -> Raster:
    plan = G.taps(image.shape[axis], out, kernel)
    most = max(map(len, plan))
    place = np.array([[t[0] for t in p] + [0] * (most - len(p)) for p in plan])
    weight = np.array([[t[1] for t in p] + [0.0] * (most - len(p)) for p in plan])
    shape = (1, -1, 1) if axis == 1 else (-1, 1, 1)
    total = 0.0
    for t in range(most):  # in ascending order of the source: sums of floats depend on it
        total = total + np.take(image, place[:, t], axis) * weight[:, t].reshape(shape)
    return clamped(total)


def resample(image: Raster, width: int, height: int, kernel: str = "bilinear") -> Raster:
    h, w = image.shape[:2]
    if (width, height) == (w, h):
        return image.copy()
    if kernel == "nearest":
        return image[np.ix_(G.nearest_places(h, height), G.nearest_places(w, width))]
    alpha = has_alpha(image)
    out = _filtered(_filtered(premultiply(image) if alpha else image, width, kernel, 1), height, kernel, 0)
    return unpremultiply(out) if alpha else out


def resize(image: Raster, width: int | None = None, height: int | None = None, fit: str = "fill", upscale: bool = True, resampling: str = "bilinear", background: tuple[int, ...] = G.WHITE) -> Raster:
    G.check_resize(width, height, resampling)
    plan = G.Resize.of(image.shape[1], image.shape[0], width, height, fit, upscale)
    if plan.same:
        return image.copy()
    inner = resample(image, plan.inner_width, plan.inner_height, resampling)
    if (plan.inner_width, plan.inner_height) == (plan.width, plan.height):
        return inner
    if fit == "cover":
        return crop(inner, plan.left, plan.top, plan.width, plan.height)
    out = create(plan.width, plan.height, background)
    out[plan.top : plan.top + plan.inner_height, plan.left : plan.left + plan.inner_width] = inner
    return out


def max_long_edge(image: Raster, size: int, resampling: str = "bilinear") -> Raster:
    G.check_length(size, "maxLongEdge.size")
    G.check_kernel(resampling, "maxLongEdge.resampling")
    plan = G.Resize.capped(image.shape[1], image.shape[0], int(size))
    return image if plan.same else resample(image, plan.width, plan.height, resampling)


def rotate(image: Raster, angle: float, resampling: str = "bilinear", background: tuple[int, ...] | None = None, max_pixels: int = G.MAX_PIXELS) -> Raster:
    G.check_angle(angle)
    G.check_kernel(resampling, "rotate.resampling")
    if G.quarter_turns(angle) is not None:
        return rotate90(image, angle)
    h, w = image.shape[:2]
    plan = G.Rotation.of(w, h, angle, max_pixels)
    out = create(plan.width, plan.height, background or G.CLEAR)
    shift = 0.0 if resampling == "lanczos3" else 0.5
    starts = np.array(plan.starts(shift)).T
    see_through = has_alpha(image)
    image = np.ascontiguousarray(premultiply(image) if see_through and resampling == "bilinear" else image)
    for top in range(0, plan.height, BAND):  # a band at a time stays in the cache
        band = slice(top, top + BAND)
        steps = np.empty((2, *out[band].shape[:2]))
        steps[0], steps[1] = plan.cos, -plan.sin
        steps[:, :, 0] = starts[:, band]
        _rotated(image, out[band], *np.cumsum(steps, 2), resampling, see_through)
    return out


#: Rows that a rotation works on at once.
BAND = 32


def _rotated(image: Raster, out: Raster, sx: np.ndarray, sy: np.ndarray, resampling: str, see_through: bool) -> None:
    """Fills in those pixels of `out` whose places in the source lie inside it."""
    h, w = image.shape[:2]
    whole = image.view(np.uint32)[..., 0]  # a pixel as one number
    if resampling == "nearest":
        px, py = np.floor(sx + 0.5).astype(np.int64), np.floor(sy + 0.5).astype(np.int64)
        inside = (px >= 0) & (py >= 0) & (px < w) & (py < h)
        out[inside] = whole[py[inside], px[inside]].view(np.uint8).reshape(-1, 4)
        return
    inside = (sx >= -0.5) & (sy >= -0.5) & (sx <= w - 0.5) & (sy <= h - 0.5)
    x, y = sx[inside], sy[inside]
    if resampling == "lanczos3":
        colour, alpha = _lanczos(image, x - 0.5, y - 0.5)
        channels = [*colour.T, alpha]
    else:
        channels = _bilinear(whole, x, y, see_through)
    packed = np.zeros(len(x), np.uint32)
    for k, values in enumerate(channels):
        packed |= clamped(values).astype(np.uint32) << np.uint32(8 * k)
    numbers = out.view(np.uint32)[..., 0]
    if len(channels) == 3:
        numbers[inside] = packed | np.uint32(255 << 24)
        return
    # without a background the rest is clear already
    numbers[inside] = np.where(channels[3] > 0, packed, numbers[inside])


def _bilinear(whole: np.ndarray, x: np.ndarray, y: np.ndarray, see_through: bool) -> list[np.ndarray]:
    """Red, green, blue and, unless all pixels are opaque, alpha, from premultiplied pixels. Channel by channel, so that all runs
    over whole arrays."""
    h, w = whole.shape
    left, top = np.floor(x), np.floor(y)
    fx, fy = x - left, y - top
    left, top = left.astype(np.int32), top.astype(np.int32)
    xs = [np.clip(left + d, 0, w - 1) for d in (0, 1)]
    ys = [np.clip(top + d, 0, h - 1) * np.int32(w) for d in (0, 1)]
    flat, gx, gy = whole.reshape(-1), 1 - fx, 1 - fy
    taps = [(flat.take(ys[j] + xs[i]), u * v) for j, v in enumerate((gy, fy)) for i, u in enumerate((gx, fx))]
    out = []
    for k in range(4 if see_through else 3):
        total = None
        for pixels, weight in taps:
            term = (pixels >> np.uint32(8 * k) & np.uint32(255)) * weight
            total = term if total is None else np.add(total, term, out=total)
        out.append(total)
    if see_through:
        scale = 255 / np.where(out[3] > 0, out[3], 1)
        out[:3] = [c * scale for c in out[:3]]
    return out


def _lanczos_weight(d: np.ndarray) -> np.ndarray:
    d = np.abs(d)
    safe = np.where(d == 0, 1, d)
    value = 3 * np.sin(np.pi * safe) * np.sin(np.pi * safe / 3) / (np.pi * np.pi * safe * safe)
    return np.where(d == 0, 1.0, np.where(d >= 3, 0.0, value))


def _lanczos(image: Raster, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, w = image.shape[:2]
    share = image[..., 3] / 255
    colour, alpha, total = np.zeros((len(x), 3)), np.zeros(len(x)), np.zeros(len(x))
    top, left = np.ceil(y - 3).astype(int), np.ceil(x - 3).astype(int)
    for j in range(7):
        row = top + j
        down = np.where((row <= np.floor(y + 3)) & (row >= 0) & (row < h), _lanczos_weight(row - y), 0.0)
        for i in range(7):
            column = left + i
            weight = np.where((column <= np.floor(x + 3)) & (column >= 0) & (column < w), down * _lanczos_weight(column - x), 0.0)
            at = np.clip(row, 0, h - 1), np.clip(column, 0, w - 1)
            colour += image[at][:, :3] * share[at][:, None] * weight[:, None]
            alpha += image[at][:, 3] * weight
            total += weight
    ok = (total != 0) & (alpha != 0)
    norm = 1 / np.where(ok, total, 1)
    mean = np.where(ok, alpha * norm, 0.0)
    colour = colour * norm[:, None] * (255 / np.where(mean == 0, 1, mean))[:, None]
    return np.clip(colour, 0, 255), np.clip(mean, 0, 255)


def oriented(image: Raster, orientation: int) -> Raster:
    """The picture as its EXIF orientation says it should be seen; numbers other than 2..8 change nothing."""
    if orientation in (2, 5, 7):
        image = flip(image, horizontal=True)
    elif orientation == 4:
        image = flip(image, vertical=True)
    turn = {3: 180, 5: 270, 6: 90, 7: 90, 8: 270}.get(orientation)
    return rotate90(image, turn) if turn else image
