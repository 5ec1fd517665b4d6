"""What the operators share: reading tables, the shared folder, and hashed words straight from Arrow buffers."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of the parts in which functions take the Arrow batches that Spark sends (64 MB or 10,000 rows of them).
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Bytes that the vectorised word hashing takes at once; it needs about 40 bytes of memory for each.
SEGMENT = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most `rows` rows, and of at most about `size` bytes where they have more than one."""
    for batch in batches:
        left = [batch.slice(at, rows) for at in range(0, len(batch), rows)][::-1]
        while left:
            part = left.pop()
            if len(part) > 1 and part.nbytes > size:
                half = len(part) // 2
                left += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def release() -> None:
    """Gives freed memory back to the machine: Spark keeps Python workers for the next task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def in_parts(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = BATCH_ROWS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` on the parts of its batches; at the end of a partition what it freed goes back to the machine."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(parts(batches, rows))
        finally:
            release()

    return each


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for what is run inside, where memory is tight; the session's own setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


_folders: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, which all executors see; only where that is unset and all runs on one machine
    (tests), one under /tmp. It stays, as results are read from it, until `drop_folders`."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if got.isDefined():
            top = got.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            top = "file:///tmp/pixelframe-checkpoint"
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    _folders.append(f"{top}/pixelframe-{uuid.uuid4().hex}")
    return _folders[-1]


def folders() -> int:
    """How many folders there have been; `drop_folders` takes this for where to begin."""
    return len(_folders)


def folders_since(since: int) -> list[str]:
    return _folders[since:]


def drop(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_folders(spark: SparkSession, since: int = 0) -> None:
    """Deletes the folders of intermediate tables made since then. Results not yet written that read them are lost."""
    for folder in _folders[since:]:
        drop(spark, folder)
    del _folders[since:]


def written(df: DataFrame, to: str) -> DataFrame:
    """The rows, written to the shared folder and read again: cuts the lineage and survives lost executors."""
    df.write.mode("overwrite").parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)


def mark(text: Column) -> Column:
    """Tells rows of one id apart by their text, in any scan of any table; numbers of rows only hold within one."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def remainder(column: str, by: int):
    """crc32 of an id as text, modulo `by`; null ids count as remainder -1."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % by, F.lit(-1))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string or binary column as (bytes, offsets of n + 1); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def text_of(rows: pa.StructArray) -> pa.Array:
    """The field text of whole rows, as strings."""
    (name,) = [f.name for f in rows.type if f.name.lower() == "text"]  # as Spark finds columns
    column = pa.compute.struct_field(rows, name)
    return column if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.cast(pa.string())


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(by)
    return x ^ (x >> np.uint64(31))


def position_keys(n: int) -> np.ndarray:
    """A pseudo-random odd key for each byte position of a word."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_KEYS = position_keys(1 << 12)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased (A-Z) words between ASCII white space, as 64-bit multilinear hashes in text order, and the offsets of
    each document's words. Words don't cross documents."""
    hashes, begin, _ = word_spans(data, offsets)
    return hashes, np.searchsorted(begin, offsets)


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and bytes of each word between bytes of `space`. Whole texts; long ones go through in segments that
    are cut between words."""
    global _KEYS
    hashes, begins, sizes = [], [], []
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    at = 0
    while at < len(data):
        end = min(len(data), at + SEGMENT)
        if end < len(data):
            stop = space[data[at:end]] | edge[at:end]
            stop[0] = False
            last = np.flatnonzero(stop)
            if len(last):
                end = at + int(last[-1])
            else:  # a word longer than a segment
                more = np.flatnonzero(space[data[end:]] | edge[end:-1])
                end = end + int(more[0]) if len(more) else len(data)
        part = data[at:end]
        word = ~space[part]
        first = word.copy()
        first[1:] &= ~word[:-1] | edge[at + 1 : end]
        where = np.flatnonzero(word)
        if len(where):
            heads = np.flatnonzero(first[where])
            lengths = np.diff(np.append(heads, len(where)))
            starts = where[heads]
            place = np.arange(len(where)) - np.repeat(heads, lengths)
            if (longest := int(lengths.max())) > len(_KEYS):
                _KEYS = position_keys(2 * longest)
            value = _KEYS[place] * (LOWER[part[where]].astype(np.uint64) + np.uint64(1))
            hashes.append(mix(np.add.reduceat(value, heads)))
            begins.append(starts + at)
            sizes.append(lengths)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(begins), np.concatenate(sizes)
