"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions alone.

A window of an item occurs in a document only if all its words do, so one word of it is a sufficient prefix: the one
that is rarest in the corpus. Those anchors, each with the item's words to its left and right, are joined with the
places in documents that hold the same word; the words around must then agree exactly over at least a window. A bitmap
of bounded size tells beforehand which words can be anchors at all.
"""

from __future__ import annotations

import string

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mark, shared_dir, written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bits of the bitmap of words; fuller ones only let more words through to the join.
BITS = 1 << 20
#: Bytes of anchors, with the words around them, that may be broadcast. More are joined by shuffling.
BROADCAST = 16 << 20


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words; none for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lowered, SEPARATORS), lambda w: w != "")


def _bit(word: Column) -> Column:
    return F.xxhash64(word).bitwiseAND(BITS - 1)


def _bitmap(df: DataFrame, word: str) -> Column:
    """The bitmap of a column's words as an array literal of BITS / 64 numbers, however many words there are."""
    at = df.select(_bit(F.col(word)).alias("b")).groupBy(F.shiftright("b", 6).alias("at"))
    rows = at.agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("bits"))
    out = np.zeros(BITS // 64, np.int64)
    for at, bits in rows.collect():
        out[at] = bits
    return F.lit(out)


def _may_hold(bitmap: Column, word: Column) -> Column:
    bit = _bit(word)
    return F.getbit(F.get(bitmap, F.shiftright(bit, 6).cast("int")), bit.bitwiseAND(63).cast("int")) == 1


def anchors(documents: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """anchor word, item_id, need (words of the window), left (from the anchor leftwards), right: for each item and place
    that is the rarest of some window."""
    items = benchmark.select(F.col("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0).withColumn("item", F.xxhash64("item_id", F.concat_ws(" ", "w"))).dropDuplicates(["item"])
    placed = items.select("item", F.posexplode("w").alias("pos", "word"))
    vocabulary = placed.select("word").distinct()
    held = _bitmap(vocabulary, "word")
    # counts of the benchmark's words over the whole corpus
    counted = documents.select(F.explode(F.filter(words(F.col("text")), lambda w: _may_hold(held, w))).alias("word")).groupBy("word").count()
    counts = vocabulary.join(counted, "word", "left").select("word", F.coalesce("count", F.lit(0)).alias("n"))
    ranked = placed.join(counts, "word").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "word"))).alias("r"))
    need = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(0), F.size("w") - F.col("need"))
    rarest = F.transform(starts, lambda s: F.array_min(F.transform(F.slice(F.col("r"), s + 1, F.col("need")), lambda x: F.struct(x["n"], x["word"], x["pos"]))))
    at = F.explode(F.array_distinct(F.transform(rarest, lambda x: x["pos"]))).alias("at")
    found = items.join(ranked, "item").withColumn("need", need).select("item_id", "w", "need", at)
    return found.select(F.get("w", F.col("at")).alias("anchor"), "item_id", "need", *_around(F.col("w"), F.col("at"), window))


def _around(w: Column, at: Column, window: int) -> tuple[Column, Column]:
    first = F.greatest(at - window + 1, F.lit(0))
    return F.reverse(F.slice(w, first + 1, at - first)).alias("left"), F.slice(w, at + 2, window - 1).alias("right")


def _agree(a: Column, b: Column) -> Column:
    """Words that both arrays begin with."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10, marked: bool = False) -> DataFrame:
    """Per row of `documents` (doc_id, text): n_words, n_hit (words inside an occurrence of `window` consecutive words of
    an item, or of the whole of a shorter one), n_items, items_sha256, contaminated. Null and empty texts have no words
    and no hits; items without words take no part; equal items under one id count once. Rows with equal ids stay apart,
    and further columns are not read. An empty benchmark hits nothing. marked: with mark, which tells rows of one id apart by their text (common.mark)."""
    if not 1 <= window:
        raise ValueError("window must be at least 1")
    index = written(anchors(documents, benchmark, window), f"{shared_dir(documents.sparkSession)}/anchors")
    letters = F.octet_length(F.concat_ws(" ", "anchor", "left", "right"))
    small = (index.agg(F.sum(letters + 200)).first()[0] or 0) <= BROADCAST
    held = _bitmap(index, "anchor")
    rows = documents.select(F.monotonically_increasing_id().alias("uid"), "doc_id", mark(F.col("text")).alias("mark"), words(F.col("text")).alias("w"))
    w = F.col("w")
    places = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: _may_hold(held, F.get(w, i)))
    places = F.when(F.size(w) > 0, F.transform(places, lambda i: F.struct(i.alias("at"), F.get(w, i).alias("anchor"), *_around(w, i, window))))
    candidates = rows.select("uid", "doc_id", "mark", F.size(w).cast("long").alias("n_words"), F.explode_outer(places).alias("c"))
    # words hold no blank, so a row without a candidate has a key of its own that meets nothing
    candidates = candidates.select("uid", "doc_id", "mark", "n_words", F.col("c.at").alias("at"), F.coalesce("c.anchor", F.concat(F.lit(" "), F.col("uid").cast("string"))).alias("anchor"), F.col("c.left").alias("l"), F.col("c.right").alias("r"))
    met = candidates.join(F.broadcast(index) if small else index, "anchor", "left")
    before, after = _agree(F.col("l"), F.col("left")), _agree(F.col("r"), F.col("right"))
    met = met.withColumn("before", before).withColumn("after", after).withColumn("hit", F.coalesce(F.col("before") + F.col("after") + 1 >= F.col("need"), F.lit(False)))
    run = F.when(F.col("hit"), F.struct((F.col("at") - F.col("before")).alias("a"), (F.col("at") + F.col("after")).alias("b")))
    by_row = met.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.first("mark").alias("mark"), F.max("n_words").alias("n_words"), F.collect_set(run).alias("runs"), F.collect_set(F.when(F.col("hit"), F.col("item_id").cast("string"))).alias("items"))
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(F.array_sort("runs"), start, lambda acc, x: F.struct(F.greatest(acc["last"], x["b"]).alias("last"), (acc["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"] - 1, acc["last"]))).cast("long").alias("n")))
    return by_row.select(*["mark"] * marked, "doc_id", "n_words", covered["n"].alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), i AS (SELECT item_id, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
g AS (
  SELECT DISTINCT item_id, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS g
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM i)
), p AS (SELECT uid, w, unnest(range(1, len(w) + 1)) AS s FROM d),
h AS (
  SELECT p.uid, p.s, q.k, array_to_string(list_slice(p.w, p.s, p.s + q.k - 1), ' ') AS g
  FROM p, (SELECT DISTINCT k FROM i) q WHERE p.s + q.k - 1 <= len(p.w)
), m AS (SELECT h.uid, h.s, h.k, g.item_id FROM h JOIN g ON h.k = g.k AND h.g = g.g),
c AS (SELECT uid, count(DISTINCT x) AS n_hit FROM (SELECT uid, unnest(range(s, s + k)) AS x FROM m) GROUP BY uid),
t AS (SELECT uid, count(DISTINCT item_id::VARCHAR) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM m GROUP BY uid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, c.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (uid) LEFT JOIN t USING (uid)
"""
