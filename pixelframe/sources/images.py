"""Tables of image files: reading, header probes, decoding to rasters, recipes, encoding, writing.

A raster is a struct (width, height, data) with data in rows of RGBA bytes. What goes wrong with a row goes into its `error`
column and leaves the others alone; strict=True raises it instead. Other columns of a table pass through.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ERROR, CorruptImage, ImageError, ImageTooLarge, UnsupportedFormat
from ..operators import rasters as R
from ..plans import geometry as G
from ..plans import spec as S
from .codecs import codec, jpeg, sniff

#: Rows that a function takes of an Arrow batch at once, at least and at most, and bytes of the input between; bytes of results after
#: which they are sent on, as a raster may take hundreds of megabytes.
LEAST_ROWS, MOST_ROWS, PART_BYTES, SENT_BYTES = 16, 512, 8 << 20, 32 << 20
#: Pixels of a small file, which is read with others of its kind, and of the rows that are made or turned into pixels at once.
SMALL_PIXELS, MANY_PIXELS = 4096, 1 << 16
#: Rows of a table for a task, where each stands for much work.
TASK_ROWS = 20_000
IMAGE = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("data", T.BinaryType())])
PIXELS = "y int, x int, r int, g int, b int, a int"


def read_images(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, modificationTime, length, content of the files under a path; a path that isn't there raises Spark's own error."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def from_bytes(spark: SparkSession, contents: list[bytes]) -> DataFrame:
    return spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(contents)], "image_id long, content binary")


# One image.


def _checked(content: bytes, format: str | None, max_pixels: int) -> tuple[str, int, int]:
    """The format and size of a file that may be decoded."""
    found = sniff(content)
    if format is not None and found != format:
        raise ImageError("FORMAT_MISMATCH", f"Asked to decode as {format}, but the header says {found or 'nothing we recognise'}.")
    if found is None:
        raise UnsupportedFormat(content)
    width, height = codec(found).probe(content)
    if width * height > max_pixels:
        raise ImageTooLarge(width, height, max_pixels)
    return found, width, height


def _finished(image: R.Raster | Exception, found: str, content: bytes, hint: int | None) -> R.Raster:
    """What a codec made of a file, upright and within the hint."""
    if isinstance(image, ImageError):
        raise image
    if isinstance(image, Exception):  # whatever a hostile file makes a decoder do
        raise CorruptImage(f"{found} data does not decode: {image}") from image
    if found == "jpeg":
        image = R.oriented(image, jpeg.orientation(content))
    return image if hint is None else R.max_long_edge(image, hint)


def decode_bytes(content: bytes, format: str | None = None, max_pixels: int = G.MAX_PIXELS, hint: int | None = None) -> R.Raster:
    """format: refuse any other. hint: a longest edge that the picture must not exceed, which JPEG files reach by reading less."""
    found, _, _ = _checked(content, format, max_pixels)
    module = codec(found)
    try:
        image = module.decode(content, hint) if found == "jpeg" and hint else module.decode(content)
    except Exception as e:
        image = e
    return _finished(image, found, content, hint)


def decode_many(contents: list[bytes], format: str | None = None, max_pixels: int = G.MAX_PIXELS, hint: int | None = None) -> Iterator[R.Raster | ImageError]:
    """As decode_bytes, a picture or an error for each file in order. Small ones are read together where their codec can."""
    known: list = []
    small: dict[str, list[int]] = {}
    for i, content in enumerate(contents):
        try:
            found, width, height = _checked(content, format, max_pixels)
            known.append(found)
            if width * height <= SMALL_PIXELS and hasattr(codec(found), "decode_many"):
                small.setdefault(found, []).append(i)
        except ImageError as e:
            known.append(e)
    ready: dict[int, R.Raster | Exception] = {}
    for found, places in small.items():
        files = [contents[i] for i in places]
        ready.update(zip(places, codec(found).decode_many(files, hint) if found == "jpeg" else codec(found).decode_many(files), strict=True))
    for i, (content, found) in enumerate(zip(contents, known, strict=True)):
        if isinstance(found, ImageError):
            yield found
            continue
        try:
            yield _finished(ready.pop(i), found, content, hint) if i in ready else decode_bytes(content, format, max_pixels, hint)
        except ImageError as e:
            yield e


def encode_raster(image: R.Raster, format: str, options: dict[str, Any] | None = None) -> bytes:
    module, options = codec(format), options or {}
    S.check_options(format, options)
    if image.ndim != 3 or image.shape[2] != 4 or not image.size or image.dtype != np.uint8:
        raise ImageError("ENCODE_FAILED", f"Cannot encode to {format}: not an image of RGBA bytes")
    try:
        return module.encode(image, **options)
    except ImageError:
        raise
    except Exception as e:
        raise ImageError("ENCODE_FAILED", f"Encoding to {format} failed: {e}") from e


def encode_many(images: list[R.Raster], format: str, options: dict[str, Any] | None = None) -> list[bytes | ImageError]:
    """As encode_raster, a file or an error for each picture. Small ones of a size are written together where the codec can."""
    together: dict[tuple[int, ...], list[int]] = {}
    out: list = [None] * len(images)
    try:
        module = codec(format)
        S.check_options(format, options or {})
    except ImageError as e:
        return [e] * len(images)
    if hasattr(module, "encode_many"):
        for i, image in enumerate(images):
            if image.ndim == 3 and image.shape[2] == 4 and image.dtype == np.uint8 and 0 < image.size <= 4 * SMALL_PIXELS:
                together.setdefault(image.shape, []).append(i)
    for shape, places in together.items():
        step = max(1, MANY_PIXELS // (shape[0] * shape[1]))
        for part in (places[at : at + step] for at in range(0, len(places), step)):
            try:
                for i, content in zip(part, module.encode_many(np.stack([images[i] for i in part]), **(options or {})), strict=True):
                    out[i] = content
            except Exception:  # each is asked by itself what goes wrong
                pass
    for i, image in enumerate(images):
        if out[i] is None:
            try:
                out[i] = encode_raster(image, format, options)
            except ImageError as e:
                out[i] = e
    return out


def apply_spec(image: R.Raster, spec: dict[str, Any]) -> R.Raster:
    for name, options in S.stages(spec):
        if name == "max_long_edge":
            image = R.max_long_edge(image, options["maxLongEdge"], options.get("resampling") or "bilinear")
        elif name == "rotate":
            image = R.rotate(image, **{{"maxPixels": "max_pixels"}.get(k, k): v for k, v in options.items()})
        else:
            image = getattr(R, name)(image, **options)
    return image


def _chosen(content: bytes, spec: dict[str, Any]) -> tuple[str, dict[str, Any]]:
    """The format that a file is written in, and its options."""
    chosen = spec.get("format") or {"format": sniff(content)}
    options = dict(chosen.get("options") or {})
    if "background" in spec and "background" in S.OPTIONS[chosen["format"]]:
        options = {"background": tuple(spec["background"])} | options
    return chosen["format"], options


def run_bytes(content: bytes, spec: dict[str, Any], max_pixels: int = G.MAX_PIXELS, preview: int | None = None) -> bytes:
    """A recipe over one file; without a format the result has the file's own."""
    return encode_raster(apply_spec(decode_bytes(content, None, max_pixels, preview), spec), *_chosen(content, spec))


def run_many(contents: list[bytes], spec: dict[str, Any], max_pixels: int = G.MAX_PIXELS, preview: int | None = None) -> Iterator[bytes | ImageError]:
    """As run_bytes, a file or an error for each file in order."""
    held: list[tuple[bytes, R.Raster | ImageError]] = []
    size = 0
    for content, image in zip(contents, decode_many(contents, None, max_pixels, preview), strict=True):
        if not isinstance(image, ImageError):
            try:
                image = apply_spec(image, spec)
                size += image.size
            except ImageError as e:
                image = e
        held.append((content, image))
        if size > 4 * MANY_PIXELS:
            yield from _written(held, spec)
            held, size = [], 0
    yield from _written(held, spec)


def _written(held: list[tuple[bytes, R.Raster | ImageError]], spec: dict[str, Any]) -> list[bytes | ImageError]:
    out: list = [image for _, image in held]
    by: dict[str, list[int]] = {}
    for i, (content, image) in enumerate(held):
        if not isinstance(image, ImageError):
            by.setdefault(_chosen(content, spec)[0], []).append(i)
    for places in by.values():
        for i, done in zip(places, encode_many([held[i][1] for i in places], *_chosen(held[places[0]][0], spec)), strict=True):
            out[i] = done
    return out


# Tables.


def fused(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str, columns: list[str] | None = None) -> DataFrame:
    """df.mapInArrow(run, schema), for a function that finds its columns by name, of which `columns` are all that it needs. Steps
    that follow one another at once run in one worker, and what lies between them doesn't go through the JVM."""
    before = getattr(df, "_fused", None)
    source, steps = (before[0], (*before[1], run)) if before else (df.select(*columns) if columns else df, (run,))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps:
            batches = step(batches)
        return batches

    out = source.mapInArrow(whole, schema)
    out._fused = source, steps
    return out


def spread(rows: DataFrame, count: int) -> DataFrame:
    """About `count` small rows, each of which stands for much work, over all cores, and over more tasks the more rows there are. Their
    bytes say nothing of the work: a million of them come in one or two parts of a file, or of a shuffle."""
    tasks = max(-(-count // TASK_ROWS), min(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-count // 500)))
    return rows.repartition(tasks) if tasks > 1 else rows


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    step = min(MOST_ROWS, max(LEAST_ROWS, PART_BYTES * len(batch) // max(1, batch.nbytes)))
    return (batch.slice(at, step) for at in range(0, len(batch), step))


def _each(f: Callable[[dict], dict]) -> Callable[[pa.RecordBatch], Iterator[dict | ImageError]]:
    """A function of a row for many of them."""

    def many(rows: pa.RecordBatch) -> Iterator[dict | ImageError]:
        for row in rows.to_pylist():
            try:
                yield f(row)
            except ImageError as e:
                yield e

    return many


def _mapped(df: DataFrame, drop: str, fields: list[T.StructField], many: Callable[[pa.RecordBatch], Iterator[dict | ImageError]], strict: bool) -> DataFrame:
    """The columns of df but for `drop`, and those that `many` makes of each row; its errors go into the column error."""
    new = [x.name for x in fields] + ["error"]
    kept = [x for x in df.schema.fields if x.name not in (drop, *new)]
    schema = T.StructType([*kept, *fields, T.StructField("error", ERROR)])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(x.dataType) for x in (*fields, schema["error"])]
    names = [x.name for x in kept]

    def made(part: pa.RecordBatch, done: list[dict]) -> pa.RecordBatch:
        columns = [part.column(part.schema.names.index(n)) for n in names]
        return pa.RecordBatch.from_arrays(columns + [pa.array([d.get(n) for d in done], k) for n, k in zip(new, kinds, strict=True)], names=names + new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in _parts(b)):
            failed = part.column("error") if "error" in part.schema.names else None
            before = failed.to_pylist() if failed is not None and failed.null_count < len(part) else [None] * len(part)
            results = many(part.filter(failed.is_null()) if any(before) else part)
            done, begin, size = [], 0, 0
            for i, error in enumerate(before):
                result = {"error": error} if error else next(results)
                if isinstance(result, ImageError):
                    if strict:
                        raise result
                    result = {"error": result.row()}
                done.append(result)
                size += sum(len(v["data"] if isinstance(v, dict) else v) for n in new[:-1] if isinstance(v := result.get(n), (bytes, dict)))
                if size > SENT_BYTES or i + 1 == len(before):
                    yield made(part.slice(begin, len(done)), done)
                    done, begin, size = [], i + 1, 0

    return fused(df, run, schema)


def _raster(image: R.Raster) -> dict:
    return {"width": image.shape[1], "height": image.shape[0], "data": np.ascontiguousarray(image).tobytes()}


def _array(value: dict) -> R.Raster:
    return R.from_bytes(value["width"], value["height"], value["data"])


def _contents(rows: pa.RecordBatch) -> list[bytes]:
    """Null content counts as empty."""
    return [c or b"" for c in rows.column("content").to_pylist()]


def probe(files: DataFrame, strict: bool = False) -> DataFrame:
    """format, width and height as stored, from the column content, which goes; null content counts as empty."""

    def one(row: dict) -> dict:
        content = row["content"] or b""
        found = sniff(content)
        if found is None:
            raise UnsupportedFormat(content)
        width, height = codec(found).probe(content)
        return {"format": found, "width": width, "height": height}

    integer = T.IntegerType()
    return _mapped(files, "content", [T.StructField("format", T.StringType()), T.StructField("width", integer), T.StructField("height", integer)], _each(one), strict)


def orientation(files: DataFrame) -> DataFrame:
    """orientation, 1 to 8, as the first EXIF segment of the column content says, which goes; 1 where none does."""
    return _mapped(files, "content", [T.StructField("orientation", T.IntegerType())], _each(lambda row: {"orientation": jpeg.orientation(row["content"] or b"")}), False)


def decode(files: DataFrame, format: str | None = None, max_pixels: int = G.MAX_PIXELS, hint: int | None = None, strict: bool = False) -> DataFrame:
    """The column image in place of content."""
    if hint is not None:
        G.check_length(hint, "maxLongEdge.size")

    def many(rows: pa.RecordBatch) -> Iterator[dict | ImageError]:
        for done in decode_many(_contents(rows), format, max_pixels, hint):
            yield done if isinstance(done, ImageError) else {"image": _raster(done)}

    return _mapped(files, "content", [T.StructField("image", IMAGE)], many, strict)


def transform(images: DataFrame, spec: dict[str, Any], strict: bool = False) -> DataFrame:
    """The column image after the geometry of a recipe."""
    spec = S.validate(spec)
    return _mapped(images, "image", [T.StructField("image", IMAGE)], _each(lambda row: {"image": _raster(apply_spec(_array(row["image"]), spec))}), strict)


def encode(images: DataFrame, format: str, strict: bool = False, **options: Any) -> DataFrame:
    """The column content in place of image. Options that the format doesn't have are refused before any job."""
    S.check_options(format, options)

    def many(rows: pa.RecordBatch) -> Iterator[dict | ImageError]:
        made = []
        for image in rows.column("image").to_pylist():
            try:
                made.append(_array(image))
            except ImageError as e:
                made.append(e)
        results = iter(encode_many([x for x in made if not isinstance(x, ImageError)], format, options))
        for x in made:
            done = x if isinstance(x, ImageError) else next(results)
            yield done if isinstance(done, ImageError) else {"content": done}

    return _mapped(images, "image", [T.StructField("content", T.BinaryType())], many, strict)


def run(files: DataFrame, spec: dict[str, Any] | str, max_pixels: int = G.MAX_PIXELS, preview: int | None = None, strict: bool = False) -> DataFrame:
    """A recipe over the column content, in one pass: files in, files out; works on streams as well.

    preview: read JPEG files at a size that stays within it, which changes the result's pixels; off unless asked for."""
    spec = S.validate(json.loads(spec) if isinstance(spec, str) else spec)

    def many(rows: pa.RecordBatch) -> Iterator[dict | ImageError]:
        for done in run_many(_contents(rows), spec, max_pixels, preview):
            yield done if isinstance(done, ImageError) else {"content": done}

    return _mapped(files, "content", [T.StructField("content", T.BinaryType())], many, strict)


def run_each(files: DataFrame, spec: str = "spec", strict: bool = False) -> DataFrame:
    """As run, with a recipe of its own, as JSON, in each row's column `spec`; a bad recipe is an error of its row."""

    def one(row: dict) -> dict:
        try:
            recipe = json.loads(row[spec])
        except (TypeError, ValueError):
            recipe = row[spec]
        return {"content": run_bytes(row["content"] or b"", S.validate(recipe))}

    return _mapped(files, "content", [T.StructField("content", T.BinaryType())], _each(one), strict)


def check_specs(rows: DataFrame, spec: str = "spec") -> DataFrame:
    """The column error for each row's recipe, a JSON text; text that isn't JSON counts as a string."""

    def one(row: dict) -> dict:
        try:
            recipe = json.loads(row[spec])
        except (TypeError, ValueError):
            recipe = row[spec]
        S.validate(recipe)
        return {}

    return _mapped(rows, "", [], _each(one), strict=False)


def to_pixels(images: DataFrame, identifier: str = "image_id") -> DataFrame:
    """identifier, y, x, r, g, b, a for each pixel; rows with an error have none."""
    kind = images.schema[identifier]
    names = [kind.name, "y", "x", "r", "g", "b", "a"]

    def made(keys: pa.Array, y: np.ndarray, x: np.ndarray, colours: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys, *(pa.array(v.astype(np.int32)) for v in (y, x, *colours.T))], names=names)

    def one(key: pa.Array, image: R.Raster) -> Iterator[pa.RecordBatch]:
        """A picture in bands."""
        for top in range(0, len(image), 256):
            part = image[top : top + 256]
            y, x = np.mgrid[top : top + len(part), : image.shape[1]]
            yield made(key.take(pa.array(np.zeros(x.size, np.int64))), y.ravel(), x.ravel(), part.reshape(-1, 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.filter(batch.column("image").is_valid())
            keys, shown = rows.column(identifier), rows.column("image")
            width, height = (np.asarray(shown.field(n).fill_null(0)).astype(np.int64) for n in ("width", "height"))
            data = shown.field("data")
            size = width * height
            whole = (width > 0) & (height > 0) & (np.asarray(pc.binary_length(data).fill_null(0)) == 4 * size)
            for i in np.flatnonzero(~whole)[:1].tolist():
                _array(shown[i].as_py())  # raises
            begin = 0
            while begin < len(rows):
                end = max(begin + 1, begin + int(np.searchsorted(np.cumsum(size[begin:]), MANY_PIXELS, "right")))
                if size[begin] > MANY_PIXELS:
                    yield from one(keys.slice(begin, 1), _array(shown[begin].as_py()))
                else:
                    each, wide = size[begin:end], width[begin:end]
                    of = np.repeat(np.arange(end - begin), each)
                    at = np.arange(len(of)) - (np.cumsum(each) - each)[of]
                    y = at // wide[of]
                    colours = np.frombuffer(b"".join(data.slice(begin, end - begin).to_pylist()), np.uint8).reshape(-1, 4)
                    yield made(keys.slice(begin, end - begin).take(pa.array(of)), y, at - y * wide[of], colours)
                begin = end

    schema = T.StructType([kind, *T._parse_datatype_string(PIXELS).fields])
    return fused(images, run, schema, [identifier, "image"])


def from_pixels(pixels: DataFrame, identifier: str = "image_id") -> DataFrame:
    """identifier and image of a relation of pixels. An image lacks no pixel; one that does comes out as null."""
    order = F.array_sort(F.collect_list(F.struct("y", "x", "r", "g", "b", "a")))
    whole = pixels.groupBy(identifier).agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), order.alias("p"))
    whole_pixel = lambda p: F.shiftleft(p["r"].cast("long"), 24) + F.shiftleft(p["g"], 16) + F.shiftleft(p["b"], 8) + p["a"]
    data = F.unhex(F.array_join(F.transform("p", lambda p: F.lpad(F.hex(whole_pixel(p)), 8, "0")), ""))
    image = F.struct(F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), data.alias("data"))
    return whole.select(identifier, F.when(F.size("p") == F.col("width") * F.col("height"), image).alias("image"))


def write_images(encoded: DataFrame, folder: str, name: str) -> None:
    """Writes the column content of each row without an error to `folder`, a URI that all executors reach, under the row's
    `name`. A file appears whole or not at all, and writing it again changes nothing, so lost tasks may be repeated."""
    from pyarrow import fs

    fs.FileSystem.from_uri(folder)[0].create_dir(fs.FileSystem.from_uri(folder)[1], recursive=True)

    def write(rows: Iterator) -> None:
        store, root = fs.FileSystem.from_uri(folder)
        for row in rows:
            part = f"{root}/.{uuid.uuid4().hex}"
            with store.open_output_stream(part, compression=None) as out:
                out.write(bytes(row.content))
            store.move(part, f"{root}/{row.name}")

    encoded.where(F.col("error").isNull() & F.col("content").isNotNull()).select(F.col(name).alias("name"), "content").foreachPartition(write)
