"""The queries of this subpackage, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, langid, licences, ngram_lm, quality, sentencepiece, toxicity, vptree, warc
from .common import remainder, table


def op1_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_documents(table(spark, sf_dir, "documents"), ngram_lm.held_out_rows(), order=3)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    part = remainder("doc_id", 5)
    found = langid.identify(documents, langid.learn(documents, part > 0))
    return found.select("doc_id", (part == 0).alias("held_out"), "lang_pred", "score")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    part = remainder("doc_id", 5)
    scored = quality.score(documents, quality.learn(documents, table(spark, sf_dir, "labels"), part > 0))
    return scored.select("doc_id", (part == 0).alias("held_out"), "score", "predicted")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"))


def piece_model() -> str:
    """The vocabulary that the queries use; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(table(spark, sf_dir, "documents"), piece_model(), keep_ids=False, own_rule=True).select("doc_id", "n_tokens", "ids_sha256", "round_trip")


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.summary(licences.scan(table(spark, sf_dir, "documents")))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), 4, 85).select("doc_id", "n_shingles", "component_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    part = remainder("doc_id", 4)
    scored = toxicity.score(documents, toxicity.learn(documents, table(spark, sf_dir, "labels"), part.isin(0, 1, 3)))
    return scored.select("doc_id", (part == 2).alias("held_out"), "score", "predicted")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": warc.ORACLE, "op5_vptree": vptree.ORACLE, "op8_jaccard": jaccard.oracle(4, 85), "op10_decontamination": decontaminate.ORACLE}
