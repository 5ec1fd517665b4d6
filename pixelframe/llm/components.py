"""Connected components of a graph in a DataFrame, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(u, v) for each node u of `edges` (a, b) that isn't the smallest of its component; v is that smallest one. Loops
    and repeated edges don't matter. Nothing but a count and a checksum of the edges reaches the driver."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before, turn = None, 0
    while True:
        # the least neighbours are tables of their own: joins with these split a node of very many edges
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{folder}/large-{turn}")
        large = written(both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{folder}/met-{turn}")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), f"{folder}/small-{turn}")
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        e = written(small.distinct(), f"{folder}/stars-{turn}")
        for part in ("large", "met", "small"):
            drop(edges.sparkSession, f"{folder}/{part}-{turn}")
        if turn:
            drop(edges.sparkSession, f"{folder}/stars-{turn - 1}")
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            return e
        before, turn = now, turn + 1
