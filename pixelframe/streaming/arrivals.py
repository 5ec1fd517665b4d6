"""Recipes over a folder into which files arrive: the batch operators on a stream of files, without state."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import images

_FILES = "path string, modificationTime timestamp, length long, content binary"
#: Files of a batch of a query that goes on, and of one that only catches up: each batch reads and writes Spark's logs anew.
GOING_ON, CATCHING_UP = 1000, 20_000
#: Bytes that opening a file counts for when files are dealt over tasks. Spark's 4 MB would give 31 small ones to each.
OPEN_BYTES = 1 << 16


def read_arrivals(spark: SparkSession, folder: str, glob: str = "*", files_per_trigger: int = GOING_ON) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).load(folder)


def _session(spark: SparkSession) -> SparkSession:
    """A session with the settings of the given one, but for how many tasks look up and read a batch of small files: a stream reads
    these while it runs from the session that it was read with. In Spark's own way there is a task for each file, up to 10,000, to
    look it up, and one for 31 files to read them."""
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if spark.conf.isModifiable(k):
            own.conf.set(k, v)
    own.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", 4 * spark.sparkContext.defaultParallelism)
    own.conf.set("spark.sql.files.openCostInBytes", OPEN_BYTES)
    return own


def run_arrivals(spark: SparkSession, folder: str, spec: dict[str, Any] | str, out: str, checkpoint: str, once: bool = True, **options: Any) -> StreamingQuery:
    """Starts a query that writes path, modificationTime, length, content and error of each file to Parquet, exactly once;
    with `once` it ends when it has caught up.

    That one belongs to a session of its own, so `spark.streams` doesn't list it: a batch's files are looked up in a few tasks for each
    core, and small ones are read many to a task, large ones up to spark.sql.files.maxPartitionBytes to a task as ever."""
    options = {"files_per_trigger": CATCHING_UP if once else GOING_ON} | options
    done = images.run(read_arrivals(_session(spark) if once else spark, folder, **options), spec)
    writer = done.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
