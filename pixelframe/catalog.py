"""What formats can be read and written in this process."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .plans.spec import FORMATS
from .sources.codecs import webp


def supported_formats() -> dict[str, list]:
    """read, write, pending, unavailable; new lists each time. A codec that is loaded when needed counts as there until
    loading it has failed, is pending until it was tried, and is never tried by asking."""
    there = [f for f in FORMATS if f != "webp" or not webp.failed()]
    return {"read": list(there), "write": list(there), "pending": [] if webp.attempted() else ["webp"], "unavailable": [{"format": "webp", "reason": webp.failure()}] if webp.failed() else []}


def preload(format: str) -> None:
    """Loads a codec now; nothing to do for those that are always there."""
    if format == "webp":
        webp.load()


def preload_workers(spark: SparkSession, format: str) -> int:
    """Loads a codec in Python workers; gives how many of a few tasks could."""

    def load(rows):
        n = sum(1 for _ in rows)
        try:
            preload(format)
        except Exception:
            n = 0
        yield (n > 0,)

    tasks = spark.sparkContext.defaultParallelism
    return spark.sparkContext.parallelize(range(tasks), tasks).mapPartitions(load).map(lambda r: int(r[0])).sum()
