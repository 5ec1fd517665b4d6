"""Quality as a sparse ensemble of rules: paths of boosted trees over text statistics are conjunctive rules, a lasso
logistic regression weighs them, and those that keep a weight become one Spark column expression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BATCH_ROWS, SPACE, batches_of, in_parts, shared_dir, text_of, utf8, word_hashes, written
from .jaccard import shingles
from .samples import fitted, labelled

STATISTICS = ["log_words", "word_bytes", "letters", "upper", "digits", "stops", "marks", "exclaims", "bars", "high", "lines", "distinct", "repeats", "distinct_triples", "common"]
#: Labelled rows the rules are learnt from, at most about.
SAMPLE = 20_000
#: Scores from here on are of label 1.
ACCEPTED = 0.3

_KIND = np.zeros(256, np.uint8)  # 1 letter, 2 capital, 3 digit, 4 sentence stop, 5 other mark, 6 !, 7 |, 8 not ASCII, 9 line end
for _i in range(33, 127):
    _KIND[_i] = 3 if chr(_i).isdigit() else 2 if chr(_i).isupper() else 1 if chr(_i).islower() else 5
for _chars, _kind in ((".,;:?'\"()-", 4), ("!", 6), ("|", 7), ("\n", 9)):
    _KIND[[ord(c) for c in _chars]] = _kind
_KIND[128:] = 8


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The STATISTICS of each text, as rows; a blank text has zeros."""
    n = len(offsets) - 1
    shown = ~SPACE[data]
    total = np.concatenate([[0], np.cumsum(shown)])
    size = np.maximum(total[offsets[1:]] - total[offsets[:-1]], 1)
    kind = _KIND[data]
    words, at = word_hashes(data, offsets)
    count = np.diff(at)
    some = np.maximum(count, 1)

    def of(k: int) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(kind == k)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    document = np.repeat(np.arange(n), count)

    def runs(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes of each document, and the largest count among them."""
        distinct, most = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for begin in range(0, n, 1 << 15):
            lo, hi = np.searchsorted(docs, [begin, begin + (1 << 15)])
            key = (hashes[lo:hi] >> np.uint64(16)) | ((docs[lo:hi] - begin).astype(np.uint64) << np.uint64(48))
            key.sort()
            heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            length = np.diff(np.append(heads, len(key)))
            of_doc = (key[heads] >> np.uint64(48)).astype(np.int64) + begin
            distinct += np.bincount(of_doc, minlength=n)
            np.maximum.at(most, of_doc, length)
        return distinct, most

    distinct, most = runs(words, document)
    again = np.zeros(n, np.int64)
    if len(words) > 1:
        again = np.bincount(document[1:][(words[1:] == words[:-1]) & (document[1:] == document[:-1])], minlength=n)
    triples, of_triple = shingles(words, at, 3)
    n_triples = np.maximum(np.bincount(of_triple, minlength=n), 1)
    letters = of(1) + of(2)
    columns = [np.log1p(count), size / some, letters / size, of(2) / np.maximum(letters, 1), of(3) / size, of(4) / size, of(5) / size, of(6) / size, of(7) / size, of(8) / size, of(9) / some, distinct / some, again / some, runs(triples, of_triple)[0] / n_triples, most / some]
    return np.where((count > 0)[:, None], np.stack(columns, 1), 0.0)


@dataclass
class Rule:
    """A conjunction of (statistic, True for at most / False for above, threshold), and its weight."""

    terms: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for column, at_most, threshold in self.terms:
            out &= (x[:, column] <= threshold) == at_most
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for name, at_most, threshold in ((STATISTICS[c], a, t) for c, a, t in self.terms):
            out = out & (F.col(name) <= threshold if at_most else F.col(name) > threshold)
        return out


def tree_paths(x: np.ndarray, y: np.ndarray, trees: int = 20, depth: int = 3, bins: int = 24, rate: float = 0.3) -> list[Rule]:
    """Paths from the root to every node of boosted regression trees on the logistic loss."""
    edges = [np.unique(np.quantile(x[:, c], np.linspace(0, 1, bins + 1)[1:-1])) for c in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, c], "left") for c, e in enumerate(edges)], 1)  # bin <= j: x <= e[j]
    margin, rules = np.full(len(y), np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), {}

    def grow(rows: np.ndarray, terms: tuple, g: np.ndarray, h: np.ndarray) -> None:
        best = None
        if len(terms) < depth and len(rows) >= 20:
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for c, e in enumerate(edges):
                if not len(e):
                    continue
                left_g = np.cumsum(np.bincount(binned[rows, c], g[rows], len(e) + 1))[:-1]
                left_h = np.cumsum(np.bincount(binned[rows, c], h[rows], len(e) + 1))[:-1]
                gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
                j = int(np.argmax(gain))
                if gain[j] > 1e-6 and (best is None or gain[j] > best[0]):
                    best = (gain[j], c, j)
        if best is None:
            margin[rows] += rate * g[rows].sum() / (h[rows].sum() + 1)
            return
        _, c, j = best
        low = binned[rows, c] <= j
        for at_most, part in ((True, rows[low]), (False, rows[~low])):
            path = (*terms, (c, at_most, float(edges[c][j])))
            rules[tuple(sorted(path))] = Rule(tuple(sorted(path)))
            grow(part, path, g, h)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grow(np.arange(len(y)), (), y - p, p * (1 - p))
    return list(rules.values())


def lasso(x: np.ndarray, y: np.ndarray, penalty: float = 3e-4, steps: int = 1000) -> tuple[float, np.ndarray]:
    """Intercept and weights of the L1-penalised logistic regression, by accelerated proximal gradients."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    w[0] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    ahead, momentum = w.copy(), 1.0
    size = 4 * len(y) / max(np.linalg.norm(a, 2) ** 2, 1e-9)
    for _ in range(steps):
        new = ahead - size * (a.T @ (1 / (1 + np.exp(-(a @ ahead))) - y)) / len(y)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - size * penalty, 0)
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, w, momentum = new + (momentum - 1) / after * (new - w), new, after
    return float(w[0]), w[1:]


@dataclass
class Quality:
    intercept: float = 0.0
    rules: list[Rule] = field(default_factory=list)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Quality:
        if not len(y) or y.min() == y.max():  # one label alone says nothing about the other
            return cls(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
        if not (rules := tree_paths(x, y)):
            return cls(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
        intercept, weights = lasso(np.stack([r.holds(x) for r in rules], 1).astype(float), y)
        return cls(intercept, [Rule(r.terms, float(w)) for r, w in zip(rules, weights, strict=True) if w])

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.intercept + sum((r.weight * r.holds(x) for r in self.rules), np.zeros(len(x)))

    def column(self) -> Column:
        """The score as an expression over the statistics' columns."""
        margin = F.lit(self.intercept)
        for r in self.rules:
            margin = margin + F.when(r.column(), r.weight).otherwise(0.0)
        return 1 / (1 + F.exp(-margin))


def _measured(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(*utf8(batch.column("text") if "text" in batch.schema.names else text_of(batch.column("row"))))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(np.ascontiguousarray(x[:, c])) for c in range(len(STATISTICS))], names=keep + STATISTICS)

    return run


def with_statistics(rows: DataFrame, *keep: str) -> DataFrame:
    """The columns in `keep` and the STATISTICS of the column `text`; without it, of the text in the struct `row`."""
    schema = T.StructType([*(rows.schema[c] for c in keep), *(T.StructField(s, T.DoubleType()) for s in STATISTICS)])
    return rows.mapInArrow(in_parts(_measured(list(keep))), schema)


def learn(documents: DataFrame, labels: DataFrame, train: Column, sample: int = SAMPLE) -> Quality:
    """The model from about `sample` labelled documents for which `train` holds. Null labels are left out, null texts are empty,
    repeated ids count once; without labels of both kinds (also: an empty table) the score is a constant."""
    rows = labelled(documents, labels, "quality", train, sample)
    measured = with_statistics(rows, "order", "doc_id", "label")
    return fitted(measured, lambda t: Quality.fit(np.stack([np.asarray(t.column(c)) for c in STATISTICS], 1), (np.asarray(t.column("label")) > 0).astype(float)))


def score(documents: DataFrame, model: Quality) -> DataFrame:
    """doc_id, score, predicted for each row of `documents` (doc_id, text; nothing else is read), from its whole text; null and
    blank texts have statistics of zero. Rows are scored each by itself, so repeated ones get equal scores and null ids
    stay null; an empty table gives an empty result."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = with_statistics(rows, "doc_id").withColumn("score", model.column())
    return scored.select("doc_id", "score", (F.col("score") >= ACCEPTED).cast("int").alias("predicted"))


def accepted(documents: DataFrame, model: Quality) -> DataFrame:
    """The rows of `documents` that score ACCEPTED or more, with all their columns, whatever they are called, in a new
    shared folder; scores as in `score`."""
    kept = with_statistics(documents.select(F.struct("*").alias("row")), "row").where(model.column() >= ACCEPTED).select("row.*")
    with batches_of(documents.sparkSession, BATCH_ROWS):
        return written(kept, f"{shared_dir(documents.sparkSession)}/accepted")
