"""Language identification by rank-order profiles: the out-of-place distance of a text's most frequent letter n-grams to
those of each language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_parts

#: n-grams of a profile, documents a language is learnt from, longest n-gram.
PROFILE, SAMPLE, LONGEST = 300, 1000, 3
EDGE = 1  # stands before and after each word; no letter has this number
_letters: np.ndarray | None = None


def _is_letter(codes: np.ndarray) -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters[codes]


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the 1- to 3-grams of the words' letters and edges, in key order; of the whole text."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = np.concatenate([[False], _is_letter(codes), [False]])
    padded = np.full(len(codes) + 2, EDGE, np.int64)
    padded[1:-1][letter[1:-1]] = codes[letter[1:-1]]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:-1] |= letter[1:]
    s = padded[keep]
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = s != EDGE
    two = inner[:-1] | inner[1:]
    key = np.concatenate([s[inner], (s[:-1] << 21 | s[1:])[two], (s[:-2] << 42 | s[1:-1] << 21 | s[2:])[inner[1:-1]]])
    key.sort()
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[heads], np.diff(np.append(heads, len(key)))


def profile(text: str | None, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by key."""
    key, n = ngrams(text)
    return key[np.argsort(-n, kind="stable")[:size]]


class Profiles:
    """Ranked n-grams of some languages."""

    def __init__(self, ranked: dict[str, list[int]], size: int = PROFILE):
        self.size, self.languages = size, sorted(ranked)
        self.keys = np.unique(np.array([k for v in ranked.values() for k in v], np.int64))
        self.ranks = np.full((len(self.languages), len(self.keys) + 1), -1, np.int64)  # the last column: not in any profile
        for i, language in enumerate(self.languages):
            self.ranks[i, np.searchsorted(self.keys, ranked[language])] = np.arange(len(ranked[language]))

    def distances(self, grams: np.ndarray) -> np.ndarray:
        """Out-of-place distance to each language: the sum of the differences in rank; `size` for what a profile lacks."""
        at = np.minimum(np.searchsorted(self.keys, grams), max(len(self.keys) - 1, 0))
        at = np.where(self.keys[at] == grams, at, len(self.keys)) if len(self.keys) else np.zeros(len(grams), np.int64)
        ranks = self.ranks[:, at]
        return np.where(ranks < 0, self.size, np.minimum(np.abs(ranks - np.arange(len(grams))), self.size)).sum(1)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, ties to the first by name, and the share of the largest distance that it stays below."""
        grams = profile(text, self.size)
        if not len(grams) or not self.languages:
            return "und", 0.0
        distance = self.distances(grams)
        best = int(np.argmin(distance))
        return self.languages[best], float(1 - distance[best] / (self.size * len(grams)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for language, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            key, n = ngrams(text)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(key), pa.string()), pa.array(key), pa.array(n)], names=["lang", "gram", "n"])


def learn(documents: DataFrame, train: Column, sample: int = SAMPLE, size: int = PROFILE) -> Profiles:
    """Profiles from about `sample` documents of each language for which `train` holds, dealt by a hash of the id."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Profiles({}, size)
    parts = 1 << 20
    most = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, -(-sample * parts // n))))
    some = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(parts)) < most[F.col("lang")])
    grams = some.select("lang", "text").mapInArrow(in_parts(_counted), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    top = grams.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).orderBy("lang", "rank")
    ranked: dict[str, list[int]] = {}
    for language, gram in top.select("lang", "gram").collect():
        ranked.setdefault(language, []).append(gram)
    return Profiles(ranked, size)


def identify(documents: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred, score for each row of `documents` (doc_id, text; nothing else is read), from its whole text.
    `und` with score 0 where the text is null, empty or without letters, or where no language was learnt. Equal distances go
    to the first language by name. Rows are judged each by itself: repeated ones get equal answers, null ids stay null; an
    empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(in_parts(run), "doc_id long, lang_pred string, score double")
