"""Bounded samples of labelled rows, dealt by a hash of the id: all rows where there are few, and no more at any size, in rows
and in bytes."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_ROWS, batches_of, release, shared_dir, written

_PARTS = 1 << 20
#: Bytes of text that a sample may have in all, where whole texts go to one task.
BYTES = 16 << 20


def fitted(sample: DataFrame, fit: Callable[[pa.Table], Any]) -> Any:
    """What `fit` makes of a bounded sample with the columns order and doc_id, sorted by them, in one task: the driver gets
    the result alone, and a lost executor costs a retry."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(sample.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches([pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, schema, strict=True)], schema=schema) for b in batches], schema)
        model = fit(rows.sort_by([("order", "ascending"), ("doc_id", "ascending")]))
        del rows
        release()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model, 5)], pa.binary())], names=["model"])

    with batches_of(sample.sparkSession, BATCH_ROWS):
        found = sample.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found[0]) if found else fit(schema.empty_table())  # no row at all, no task


def labelled(documents: DataFrame, labels: DataFrame, label: str, train: Column, bound: int, size: int | None = None) -> DataFrame:
    """doc_id, text, label, order of about `bound` labelled documents for which `train` holds (a condition on doc_id). With `size`,
    as many in the order of a hash of the id as come to so many bytes, leaving out texts of over a sixteenth of that.
    The sample is drawn by id, so only its texts are shuffled. An id with several labels counts with the smallest, one
    with several texts with the first of them by its bytes; null ids and labels are left out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(train & F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    n = known.count()
    share = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(_PARTS)) < min(_PARTS, -(-bound * _PARTS // max(n, 1)))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(share)
    if size is not None:
        texts = texts.where(F.octet_length("text") <= size // 16)
    # about `bound` ids and labels, however many documents there are
    met = texts.join(F.broadcast(known.where(share)), "doc_id")
    found = met.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")).withColumn("order", F.xxhash64("doc_id", F.lit(11)))
    if size is None:
        return found
    found = written(found, f"{shared_dir(documents.sparkSession)}/sample")
    # two numbers of each of the sample's rows, to one task
    so_far = F.sum("n").over(Window.orderBy("order").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = found.select("order", F.octet_length("text").cast("long").alias("n")).withColumn("so_far", so_far).where(F.col("so_far") > size).agg(F.min("order")).first()[0]
    return found if last is None else found.where(F.col("order") < last)
