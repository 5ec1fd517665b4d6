"""Formats and sizes from the first bytes of a file, as column expressions over a binary column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What files begin with, as hex, strongest signature first; RIFF files also say WEBP at byte 8.
SIGNATURES = (("png", "89504E470D0A1A0A"), ("webp", "52494646"), ("jpeg", "FFD8FF"), ("gif", "47494638"), ("tiff", "49492A00"), ("tiff", "4D4D002A"), ("bmp", "424D"))


def _hex(content: Column, at: int, n: int) -> Column:
    return F.hex(F.substring(content, at + 1, n))


def big(content: Column, at: int, n: int) -> Column:
    """An unsigned big-endian number of n bytes; null where the content ends before."""
    return F.when(F.length(content) >= at + n, F.conv(_hex(content, at, n), 16, 10).cast("long"))


def little(content: Column, at: int, n: int) -> Column:
    total = None
    for k in range(n):
        byte = big(content, at + k, 1) * F.lit(1 << 8 * k).cast("long")
        total = byte if total is None else total + byte
    return total


def signed(value: Column, bits: int) -> Column:
    return F.when(value >= 1 << (bits - 1), value - (1 << bits)).otherwise(value)


def sniff(content: Column) -> Column:
    """The format's name, or null."""
    found = None
    for name, signature in SIGNATURES:
        fits = _hex(content, 0, len(signature) // 2) == signature
        if name == "webp":
            fits = fits & (_hex(content, 8, 4) == "57454250")
        found = F.when(fits, F.lit(name)) if found is None else found.when(fits, F.lit(name))
    return found


def _size(width: Column, height: Column, ok: Column) -> Column:
    return F.when(ok & (width >= 1) & (height >= 1), F.struct(width.cast("int").alias("width"), height.cast("int").alias("height")))


def png_size(content: Column) -> Column:
    """From an IHDR that comes first and whose checksum holds."""
    checksum = F.crc32(F.substring(content, 13, 17)) == big(content, 29, 4)
    return _size(big(content, 16, 4), big(content, 20, 4), (_hex(content, 8, 8) == "0000000D49484452") & checksum)


def gif_size(content: Column) -> Column:
    return _size(little(content, 6, 2), little(content, 8, 2), _hex(content, 0, 6).isin("474946383761", "474946383961") & (F.length(content) >= 13))


def bmp_size(content: Column) -> Column:
    """A negative height means rows from the top."""
    return _size(signed(little(content, 18, 4), 32), F.abs(signed(little(content, 22, 4), 32)), (little(content, 14, 4) >= 40) & (F.length(content) >= 54))


def webp_size(content: Column) -> Column:
    """By the kind of the first chunk: lossy, lossless, or extended."""
    kind = _hex(content, 12, 4)
    lossy = _size(little(content, 26, 2).bitwiseAND(0x3FFF), little(content, 28, 2).bitwiseAND(0x3FFF), _hex(content, 23, 3) == "9D012A")
    packed = little(content, 21, 4)
    lossless = _size(packed.bitwiseAND(0x3FFF) + 1, F.shiftright(packed, 14).bitwiseAND(0x3FFF) + 1, _hex(content, 20, 1) == "2F")
    extended = _size(little(content, 24, 3) + 1, little(content, 27, 3) + 1, F.length(content) >= 30)
    return F.when(kind == "56503820", lossy).when(kind == "5650384C", lossless).when(kind == "56503858", extended)


def header_size(content: Column) -> Column:
    """struct(width, height) of PNG, GIF, BMP and WebP files as stored; null for other formats and bad headers. JPEG and TIFF
    sizes lie behind a walk: sources.images.probe reads them."""
    name = sniff(content)
    return F.when(name == "png", png_size(content)).when(name == "gif", gif_size(content)).when(name == "bmp", bmp_size(content)).when(name == "webp", webp_size(content))


def too_large(width: Column, height: Column, limit: int) -> Column:
    """The message for an image of more pixels than the limit, or null."""
    pixels = width.cast("long") * height
    return F.when(pixels > limit, F.format_string(f"Image is %dx%d (%d pixels), over the {limit}-pixel limit.", width, height, pixels))


def not_an_image(content: Column) -> Column:
    """The message for a file of no known format, with its first bytes, or null."""
    shown = F.rtrim(F.regexp_replace(F.lower(_hex(content, 0, 12)), "(..)", "$1 "))
    text = F.when(F.length(content) == 0, F.lit("Not an image: the file is empty.")).otherwise(F.concat(F.lit("Not a supported image format. First bytes: "), shown))
    return F.when(sniff(content).isNull(), text)


def block_size(longest: Column, hint: Column) -> Column:
    """The largest of 8, 4, 2 and 1 at which a picture, decoded from JPEG blocks of that size, stays within the hint; 1 if none
    does, 8 without a hint."""
    size = F.when(hint.isNull(), 8)
    for n in (8, 4, 2):
        size = size.when(F.ceil(longest * n / 8) <= hint, n)
    return size.otherwise(1).cast("int")
