"""A training-corpus pipeline: five stages over documents, each on all that the one before kept.

All stages read the columns doc_id and text alone, whatever others are called, and all but the last return the rows that
they keep with all their columns. Null texts count as empty ones; null, repeated and tied ids are stated with each stage;
very long texts are read whole; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelframe.llm import decontaminate, jaccard, quality, sentencepiece, toxicity
from pixelframe.llm.common import drop, folders, folders_since, mark, remainder, shared_dir, table
from pixelframe.llm.queries import piece_model


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []


def _in_turn(stage: Stage) -> Stage:
    """A stage before which the intermediate tables of the one called before go: its result is written by then. Those that
    `docs` reads stay."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        files = docs.inputFiles() if _left else []
        for folder in [f for f in _left if not any(f.rpartition("/")[2] in x for x in files)]:
            drop(spark, folder)
            _left.remove(folder)
        since = folders()
        found = stage(spark, docs, sf_dir)
        _left.extend(folders_since(since))
        return found

    return run_stage


def _kept(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of docs that `decided` has by id and text: of equal ones as many as it has."""
    id_ = F.col("doc_id").cast("long")
    key = [F.coalesce(id_, F.lit(0)).alias("k"), id_.isNull().alias("no_id")]
    rows = docs.select(F.struct("*").alias("row"), *key, mark(F.col("text")).alias("mark"))
    times = decided.select(*key, "mark").groupBy("k", "no_id", "mark").agg(F.count(F.lit(1)).alias("times"))
    nth = F.row_number().over(Window.partitionBy("k", "no_id", "mark").orderBy("mark"))
    return rows.join(times, ["k", "no_id", "mark"]).withColumn("nth", nth).where(F.col("nth") <= F.col("times")).select("row.*")


@_in_turn
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network takes for toxic go, each by its text alone: repeated rows go or stay together, empty and null
    texts are windows without words. Without labels of both kinds the score is a constant, and with no labels at all
    nothing is known to be clean: 1/2, and all go."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 4).isin(0, 1, 3))
    return toxicity.accepted(docs, model)


@_in_turn
def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules take for bad go, each by its text alone: repeated rows go or stay together, empty and null texts
    have statistics of zero. Without labels of both kinds the score is a constant."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) > 0)
    return quality.accepted(docs, model)


@_in_turn
def different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the smallest id, of equal ids the first read, null ids last. Five-word shingles,
    four fifths in common. Rows that repeat in id and text are one group, whatever other columns hold; null and blank texts
    are in no group and stay."""
    return _kept(docs, jaccard.near_duplicates(docs, 5, 80).where("first"))


@_in_turn
def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words of a benchmark item in a row, or the whole of a shorter one, go; repeated rows go or stay
    together, null and empty texts stay, and an empty benchmark rejects nothing."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), marked=True)
    return _kept(docs, found.where(~F.col("contaminated")))


@_in_turn
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What a trainer reads: doc_id, the ids of each text, how many, their digest, and whether they decode to it. A row for each
    row, repeated ones too; null and empty texts have no ids."""
    rows = sentencepiece.encode(docs, piece_model(), own_rule=True)
    return rows.select("doc_id", "ids", "n_tokens", "ids_sha256", "round_trip")


STAGES = [("toxicity", toxic), ("quality", good), ("near_duplicates", different), ("decontamination", clean), ("encoding", encoded)]

#: A trained network and a fitted ensemble decide, which SQL cannot.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table documents in `sf_dir`. Each stage's result is written to a new shared folder and read
    again, so a lost executor costs one stage's tasks; what is no longer read is deleted as soon as the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        to = f"{shared_dir(spark)}/{name}"
        stage(spark, docs, sf_dir).write.parquet(to)
        docs = spark.read.parquet(to)
        if before is not None:
            drop(spark, before)
        before = to
    return STAGES[-1][1](spark, docs, sf_dir)
