"""WARC archives as seekable Zstandard bundles.

A bundle is a series of independent Zstandard frames that each hold a group of whole records, then a skippable frame that
maps record identifiers to (frame, offset in the frame's content, length), then the seek table of the seekable format as
the last skippable frame. Any Zstandard decoder reads a bundle as one stream of WARC records.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, batches_of, in_parts, shared_dir, written

SEEK_FRAME, RECORD_FRAME, SEEKABLE = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
#: Bytes of records in a frame, and of compressed frames in a bundle.
FRAME, BUNDLE = 256 << 10, 64 << 20
IDENTIFIER = "urn:page:"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_MANIFEST = "path string, records long, bytes long"
_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def bare_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, length: int, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has the HTTP head but not the payload."""
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{IDENTIFIER}{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in url))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {length}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{IDENTIFIER}{'' if refers_to is None else refers_to}>"]
    block = _HTTP + (b"" if revisit else payload)
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The headers and block of the record that begins at `at`, and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    begin = end + 4
    after = begin + int(headers["Content-Length"])
    if data[after : after + 4] != b"\r\n\r\n":
        raise ValueError("a WARC record doesn't end where its length says")
    return headers, data[begin:after], after + 4


class BundleWriter:
    """Collects records into frames; `close` gives the whole bundle."""

    def __init__(self, frame: int = FRAME, level: int = 3):
        self.frame, self.out, self.sizes, self.records, self.size = frame, [], [], [], 0
        self.pending, self.held, self.compressor = [], 0, zstandard.ZstdCompressor(level=level, write_content_size=True)

    def add(self, identifier: str, data: bytes) -> None:
        self.records.append((identifier, len(self.sizes), self.held, len(data)))
        self.pending.append(data)
        self.held += len(data)
        if self.held >= self.frame:
            self._flush()

    def _flush(self) -> None:
        if self.pending:
            packed = self.compressor.compress(b"".join(self.pending))
            self.out.append(packed)
            self.sizes.append((len(packed), self.held))
            self.size += len(packed)
            self.pending, self.held = [], 0

    def close(self) -> bytes:
        self._flush()
        names = "\n".join(r[0] for r in self.records).encode()
        places = np.array([r[1:] for r in self.records], "<u4").reshape(-1, 3)
        index = self.compressor.compress(struct.pack("<I", len(self.records)) + places.tobytes() + names)
        table = b"".join(struct.pack("<II", *s) for s in self.sizes)
        tail = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join([*self.out, struct.pack("<II", RECORD_FRAME, len(index)), index, struct.pack("<II", SEEK_FRAME, len(table) + len(tail)), table, tail])


class BundleReader:
    """Random access to a bundle: anything that has slices of bytes will do as `data`."""

    def __init__(self, data):
        self.data = data
        frames, _, magic = struct.unpack("<IBI", bytes(data[len(data) - 9 :]))
        if magic != SEEKABLE:
            raise ValueError("no seek table at the end")
        begin = len(data) - 9 - 8 * frames
        self.sizes = np.frombuffer(bytes(data[begin : len(data) - 9]), "<u4").reshape(-1, 2).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes[:, 0])])
        at = int(self.starts[-1])
        kind, length = struct.unpack("<II", bytes(data[at : at + 8]))
        if kind != RECORD_FRAME:
            raise ValueError("no record map after the frames")
        raw = zstandard.ZstdDecompressor().decompress(bytes(data[at + 8 : at + 8 + length]))
        (n,) = struct.unpack_from("<I", raw)
        self.places = np.frombuffer(raw, "<u4", 3 * n, 4).reshape(-1, 3).astype(np.int64)
        self.names = raw[4 + 12 * n :].decode().split("\n") if n else []

    def frame(self, k: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(bytes(self.data[int(self.starts[k]) : int(self.starts[k + 1])]))

    def get(self, identifier: str) -> bytes:
        """The first record of that identifier, from its frame alone."""
        frame, offset, length = self.places[self.names.index(identifier)]
        return self.frame(int(frame))[int(offset) : int(offset + length)]

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        for k in range(len(self.sizes)):
            data = self.frame(k)
            for frame, offset, _ in self.places[np.searchsorted(self.places[:, 0], k) : np.searchsorted(self.places[:, 0], k, "right")]:
                headers, block, _ = parse(data, int(offset))
                yield headers, block


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)

        def closed(bundle: BundleWriter) -> pa.RecordBatch:
            # a name of its own for each attempt: the manifest names only those whose task was counted
            name = f"{uuid.uuid4().hex}.warc.zst"
            data = bundle.close()
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(data)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(bundle.records)]), pa.array([len(data)])], names=["path", "records", "bytes"])

        bundle = BundleWriter()
        for batch in batches:
            for page_id, url, html, revisit, refers_to, digest, length in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                payload = b"" if revisit or html is None else html
                bundle.add(f"{IDENTIFIER}{'' if page_id is None else page_id}", record(page_id, url, payload, base64.b32encode(digest).decode(), length, refers_to, revisit))
                if bundle.size >= BUNDLE:
                    yield closed(bundle)
                    bundle = BundleWriter()
        if bundle.records:
            yield closed(bundle)

    return run


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html (bytes, null for revisits), revisit, refers_to, digest, length. Of the rows with equal payloads of at least `least`
    bytes, the one with the smallest page_id (null ids last, then the first read) is no revisit."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.monotonically_increasing_id().alias("uid")).withColumns({"digest": F.unhex(F.sha1("html")), "length": F.octet_length("html").cast("long")})
    alike = rows.where(F.col("length") >= least).groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull(), "page_id", "uid")).alias("first"), F.count(F.lit(1)).alias("n"))
    # as a table of its own, so that a digest with very many rows is split by the join
    first = written(alike.where("n > 1").select("digest", "first"), f"{shared_dir(pages.sparkSession)}/repeated")
    revisit: Column = F.coalesce((F.col("length") >= least) & (F.col("first.uid") != F.col("uid")), F.lit(False))
    met = rows.join(first, "digest", "left").withColumn("revisit", revisit)
    return met.select("page_id", "url", F.when(~F.col("revisit"), F.col("html")).alias("html"), "revisit", F.when(F.col("revisit"), F.col("first.page_id")).alias("refers_to"), "digest", "length")


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes the rows of `pages` (page_id, url, html) as bundles into `folder`, a URI that all executors reach, and gives
    the manifest (path, records, bytes). Null html is an empty payload, null urls are left out of the record. Bundles
    that the manifest doesn't name come from attempts that were lost."""
    spark = pages.sparkSession
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(f"{root}/bundles", recursive=True)
    with batches_of(spark, BATCH_ROWS):
        with_revisits(pages, least).mapInArrow(in_parts(_writer(f"{folder}/bundles")), _MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def number(text: str) -> int | None:
        return int(text) if (text := text[1:-1].removeprefix(IDENTIFIER)) else None

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for data in batch.column("content"):
            rows = []
            for headers, block in BundleReader(data.as_py()).records():
                digest, length = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"])
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                revisit = headers["WARC-Type"] == "revisit"
                if not revisit and (bare_digest(payload) != digest or len(payload) != length):
                    raise ValueError(f"the payload of {headers['WARC-Record-ID']} isn't what its digest says")
                rows.append((number(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), length, digest, headers["WARC-Type"], number(headers["WARC-Refers-To"]) if revisit else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names) if rows else pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds], names=names)


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the bundles that the manifest names; payloads are held against their digests."""
    spark = manifest.sparkSession
    if manifest.isEmpty():
        return spark.createDataFrame([], _RECORD)
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(f"{folder}/bundles")
    named = content.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(manifest.select(F.col("path").alias("name")), "name", "left_semi")
    return named.select("content").mapInArrow(in_parts(_reader, 1), _RECORD)


def archive_and_read(pages: DataFrame, least: int = 0) -> DataFrame:
    """What `read_archives` gives of the archives of `pages` (page_id, url, html; nothing else is read), written to a new shared
    folder: a row for each row, of repeated ones too. Null and empty html are equal empty payloads. Pages without an id, and
    pages that share one, share a record identifier: all come back, but `BundleReader.get` gives the first of a bundle.
    Of equal payloads the smallest id is the response, then the first read. An empty table gives an empty result."""
    folder = shared_dir(pages.sparkSession)
    return read_archives(write_archives(pages, folder, least), folder)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
x AS (SELECT page_id, h, first, list_transform(range(0, 8), lambda k: ('0x' || substr(sha1(h), (5 * k + 1)::INT, 5))::INT) AS v FROM p JOIN f USING (h))
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[(k // 4 + 1)::INT] >> (15 - 5 * (k % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM x
"""
