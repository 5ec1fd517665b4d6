"""Toxicity by a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

A word's input is its own vector, where the training rows made it known, beside the mean vector of its runs of three and
of five characters. Every window of a text is scored, each overlapping the next by half; a logistic regression of a few of the highest
windows' logits scores the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BATCH_ROWS, batches_of, in_parts, mix, shared_dir, text_of, utf8, word_spans, written
from .samples import BYTES, fitted, labelled

#: Words of a window, of which the next one shares half; sizes of the vectors, the state and the attention.
WINDOW, VECTOR, STATE, ATTENTION = 16, 8, 8, 8
#: Buckets of character runs, known words at most, and labelled documents to learn from, about (of samples.BYTES at most).
RUNS, KNOWN, SAMPLE = 1 << 14, 1 << 15, 5000
#: Which of a text's windows, from the highest, make its score, and the least logit that counts.
RANKS, LEAST = (0, 2, 4, 6), -6.0
#: Share of known words that a training step takes for unknown, so that characters count as well.
FORGET = 0.3
#: Scores from here on are of label 1.
REJECTED = 0.3
CHUNK = 8192  # windows that go through the network at once
SPELLED = 1 << 15  # words whose character runs are made at once

#: Letters, digits and bytes beyond ASCII make words.
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass
class Texts:
    """Texts as numbers of distinct words: `code` in text order, `at` where each text begins, and for the distinct words
    their hash and the buckets of their character runs."""

    code: np.ndarray
    at: np.ndarray
    word: np.ndarray
    run: np.ndarray
    run_at: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Texts:
        hashes, begin, size = word_spans(data, offsets, _BETWEEN)
        word, first, code = np.unique(hashes, return_index=True, return_inverse=True)
        n = size[first]
        runs = np.empty(2 * int(n.sum()), np.int32)
        run_at = 2 * (np.cumsum(n) - n)
        for a in range(0, len(word), SPELLED):
            mine = n[a : a + SPELLED]
            starts = np.cumsum(mine + 2) - mine - 2
            padded = np.zeros(int((mine + 2).sum()) + 2, np.int64)  # 0 stands before and after a word
            inner = np.arange(int(mine.sum())) - np.repeat(np.cumsum(mine) - mine, mine)
            byte = data[np.repeat(begin[first[a : a + SPELLED]], mine) + inner]
            padded[np.repeat(starts + 1, mine) + inner] = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
            at = np.repeat(starts, mine) + inner
            three = (padded[at] * 257 + padded[at + 1]) * 257 + padded[at + 2]
            five = np.where(inner + 2 < np.repeat(mine, mine), (three * 257 + padded[at + 3]) * 257 + padded[at + 4] + (1 << 40), three)
            runs[run_at[a] : run_at[a] + 2 * len(at)] = mix(np.stack([three, five], 1).ravel().astype(np.uint64)) % np.uint64(RUNS)
        return cls(code.astype(np.int32), np.searchsorted(begin, offsets), word, runs, run_at)

    def windows(self, doc: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(document, first word) of each window; a text of no words has one, too."""
        n = np.diff(self.at)
        many = np.maximum(1, -(-(n - WINDOW) // (WINDOW // 2)) + 1)
        document = np.repeat(np.arange(len(n)), many)
        first = self.at[:-1][document] + (np.arange(len(document)) - np.repeat(np.cumsum(many) - many, many)) * (WINDOW // 2)
        return document, first

    def runs_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of the runs of some distinct words, end to end, and how many each has."""
        n = np.diff(np.append(self.run_at, len(self.run)))[words]
        at = np.repeat(self.run_at[words] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return self.run[at], n

    def inputs(self, document: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers (len(word) where a window goes on beyond its text) and which of them are words."""
        place = first[:, None] + np.arange(WINDOW)
        real = place < self.at[1:][document][:, None]
        code = self.code[np.minimum(place, max(len(self.code) - 1, 0))] if len(self.code) else np.zeros(place.shape, np.int64)
        return np.where(real, code, np.int32(len(self.word))), real


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """The weights, by name, and passes over batches of windows (windows, WINDOW, input)."""

    def __init__(self, known: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"words": 0.1 * rng.standard_normal((known + 1, VECTOR)).astype(np.float32), "runs": 0.1 * rng.standard_normal((RUNS, VECTOR)).astype(np.float32), "mix": draw(2 * STATE, ATTENTION), "ask": draw(ATTENTION), "out": draw(2 * STATE), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"w{side}": draw(2 * VECTOR, 3 * STATE), f"u{side}": draw(STATE, 3 * STATE), f"b{side}": np.zeros(3 * STATE, np.float32)}

    def vectors(self, texts: Texts, numbers: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Inputs of some distinct words in order, of which the last may be len(texts.word): no word, zeros."""
        out = np.zeros((len(words), 2 * VECTOR), np.float32)
        inner = words[words < len(texts.word)]
        if len(inner):
            out[: len(inner), :VECTOR] = self.p["words"][numbers[inner]]
            buckets, count = texts.runs_of(inner)
            out[: len(inner), VECTOR:] = np.add.reduceat(self.p["runs"][buckets], np.cumsum(count) - count, axis=0) / count[:, None]
        return out

    def states(self, side: str, projected: np.ndarray, real: np.ndarray, keep: list | None = None) -> np.ndarray:
        """The state after each word, from left to right (f) or right to left (b). projected: inputs times weights."""
        u, s = self.p[f"u{side}"], STATE
        h = np.zeros((len(real), s), np.float32)
        out = np.empty((len(real), WINDOW, s), np.float32)
        for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
            x, hu = projected[:, t], h @ u
            gates = _sigmoid(x[:, : 2 * s] + hu[:, : 2 * s])
            z, r = gates[:, :s], gates[:, s:]
            new = np.tanh(x[:, 2 * s :] + r * hu[:, 2 * s :])
            mask = real[:, t, None]
            after = np.where(mask, new + z * (h - new), h)
            if keep is not None:
                keep.append((t, h, hu, z, r, new, mask))
            h = out[:, t] = after
        return out

    def pooled(self, states: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, ...]:
        seen = np.tanh(states @ self.p["mix"])
        weight = np.where(real, np.exp(np.clip(seen @ self.p["ask"], -30, 30)), 0.0).astype(np.float32)
        weight /= weight.sum(1, keepdims=True) + 1e-9
        pool = (weight[:, :, None] * states).sum(1)
        return pool @ self.p["out"] + self.p["bias"][0], pool, weight, seen

    def logits(self, texts: Texts, numbers: np.ndarray, document: np.ndarray, first: np.ndarray) -> np.ndarray:
        out = np.empty(len(document), np.float32)
        for a in range(0, len(document), CHUNK):
            code, real = texts.inputs(document[a : a + CHUNK], first[a : a + CHUNK])
            used, local = np.unique(code, return_inverse=True)
            vectors, local = self.vectors(texts, numbers, used), local.reshape(code.shape)
            states = np.concatenate([self.states(side, (vectors @ self.p[f"w{side}"] + self.p[f"b{side}"])[local], real) for side in "fb"], 2)
            out[a : a + CHUNK] = self.pooled(states, real)[0]
        return out

    def gradients(self, x: np.ndarray, real: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray]:
        """Of the weighted logistic loss: by weight, and for the inputs."""
        keep = {"f": [], "b": []}
        projected = {side: x @ self.p[f"w{side}"] + self.p[f"b{side}"] for side in "fb"}
        states = np.concatenate([self.states(side, projected[side], real, keep[side]) for side in "fb"], 2)
        logit, pool, attention, seen = self.pooled(states, real)
        g = {}
        d = (weight * (_sigmoid(logit) - y) / len(y)).astype(np.float32)
        g["out"], g["bias"] = pool.T @ d, np.array([d.sum()], np.float32)
        d_pool = d[:, None] * self.p["out"]
        d_states = attention[:, :, None] * d_pool[:, None]
        d_attention = (states * d_pool[:, None]).sum(2)
        d_ask = attention * (d_attention - (attention * d_attention).sum(1, keepdims=True))
        g["ask"] = np.einsum("btk,bt->k", seen, d_ask)
        d_seen = d_ask[:, :, None] * self.p["ask"] * (1 - seen**2)
        g["mix"] = np.einsum("btk,btj->kj", states, d_seen)
        d_states += d_seen @ self.p["mix"].T
        d_x = np.zeros_like(x)
        s = STATE
        for i, side in enumerate("fb"):
            u, du = self.p[f"u{side}"], np.zeros_like(self.p[f"u{side}"])
            d_h = np.zeros((len(x), s), np.float32)
            d_projected = np.zeros_like(projected[side])
            for t, h, hu, z, r, new, mask in reversed(keep[side]):
                d_h = d_h + d_states[:, t, i * s : (i + 1) * s]
                d_after = np.where(mask, d_h, 0)
                d_new = d_after * (1 - z) * (1 - new**2)
                d_z = d_after * (h - new) * z * (1 - z)
                d_r = d_new * hu[:, 2 * s :] * r * (1 - r)
                d_hu = np.concatenate([d_z, d_r, d_new * r], 1)
                d_projected[:, t] = np.concatenate([d_z, d_r, d_new], 1)
                du += h.T @ d_hu
                d_h = np.where(mask, d_after * z, d_h) + d_hu @ u.T
            g[f"u{side}"], g[f"b{side}"] = du, d_projected.sum((0, 1))
            g[f"w{side}"] = np.einsum("btk,btj->kj", x, d_projected)
            d_x += d_projected @ self.p[f"w{side}"].T
        return g, d_x


class Toxicity:
    """A trained network, the hashes of its known words, and the weights from a text's highest logits to its score."""

    def __init__(self, known: np.ndarray, network: Network | None, weights: np.ndarray):
        self.known, self.network, self.weights = known, network, weights

    @classmethod
    def constant(cls, label: np.ndarray) -> Toxicity:
        return cls(np.zeros(0, np.uint64), None, np.array([np.log((label.sum() + 1) / (len(label) - label.sum() + 1))]))

    def numbers(self, texts: Texts) -> np.ndarray:
        """The row of each distinct word's vector; row 0 is for all unknown ones."""
        if not len(self.known) or not len(texts.word):
            return np.zeros(len(texts.word), np.int64)
        at = np.minimum(np.searchsorted(self.known, texts.word), len(self.known) - 1)
        return np.where(self.known[at] == texts.word, at + 1, 0)

    def highest(self, texts: Texts) -> np.ndarray:
        """The logits of the places RANKS among each text's windows, cut to a range; a text of fewer windows has the least there."""
        document, first = texts.windows()
        logits = self.network.logits(texts, self.numbers(texts), document, first)
        order = np.lexsort((-logits, document))
        rank = np.arange(len(order)) - np.searchsorted(document[order], document[order])
        out = np.full((len(texts.at) - 1, len(RANKS)), LEAST)
        for column, wanted in enumerate(RANKS):
            pick = order[rank == wanted]
            out[document[pick], column] = np.clip(logits[pick], LEAST, -2 * LEAST)
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.network is None:
            return np.full(len(offsets) - 1, _sigmoid(self.weights[-1]))
        return _sigmoid(self.highest(Texts.of(data, offsets)) @ self.weights[:-1] + self.weights[-1])


def fit(texts: Texts, label: np.ndarray, epochs: int = 12, seed: int = 3) -> Toxicity:
    """Learns from whole texts with labels 0 and 1. A toxic text doesn't say where it is toxic, so its positive windows are
    those that hold its words of the highest log odds; negatives are windows of clean texts, first any, then also those
    that the network takes for toxic."""
    label = np.asarray(label)
    if not len(label) or label.min() == label.max():
        return Toxicity.constant(label)
    rng = np.random.default_rng(seed)
    # every fourth text weighs the windows' logits; the network doesn't see it
    apart = np.arange(len(label)) % 4 == 3
    if len(np.unique(label[apart])) < 2 or len(np.unique(label[~apart])) < 2:
        apart[:] = False
    own = label[~apart]
    # in how many texts of either label words and character runs stand
    by, runs = np.zeros((2, len(texts.word))), np.zeros((2, RUNS))
    for i in np.flatnonzero(~apart):
        word = np.unique(texts.code[texts.at[i] : texts.at[i + 1]])
        by[label[i], word] += 1
        runs[label[i], np.unique(texts.runs_of(word)[0])] += 1
    tell = lambda n: np.log((n[1] + 0.5) / (own.sum() + 1)) - np.log((n[0] + 0.5) / (len(own) - own.sum() + 1))
    odds, often = tell(by), by.sum(0)
    # a word is as strong as its strongest run
    strong = np.where(often >= 3, odds, -9.0)
    if len(texts.word):
        strong = np.maximum(strong, np.maximum.reduceat(np.where(runs.sum(0) >= 5, tell(runs), -9.0)[texts.run], texts.run_at))
    candidates = np.lexsort((texts.word, -often))[:KNOWN]
    candidates = np.sort(candidates[often[candidates] >= 3])  # texts.word is sorted, so the hashes are, too
    model = Toxicity(texts.word[candidates], Network(len(candidates)), np.zeros(len(RANKS) + 1))
    net, numbers = model.network, model.numbers(texts)
    net.p["words"][1:, 0] = odds[candidates] / 4

    document, first = texts.windows()
    starts = np.searchsorted(document, np.arange(len(label) + 1))
    top = np.array([strong[texts.code[a:b]].max(initial=-np.inf) for a, b in zip(texts.at, texts.at[1:], strict=False)])
    peak = np.concatenate([np.append(strong, -9.0)[texts.inputs(document[a : a + CHUNK], first[a : a + CHUNK])[0]].max(1) for a in range(0, len(document), CHUNK)])
    positive = np.flatnonzero((label[document] == 1) & ~apart[document] & (peak >= top[document] - 1e-9) & (peak > 0))
    clean = np.flatnonzero((label[document] == 0) & ~apart[document])
    negative = rng.permutation(clean)[: 8 * max(len(positive), 500)]
    toxic = np.flatnonzero((label[document] == 1) & ~apart[document])
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    steps = 0

    def train(positive: np.ndarray, negative: np.ndarray, epochs: int) -> None:
        nonlocal steps
        rows = np.concatenate([positive, negative])
        # one word over and over: what a single vector may add up to
        alone = texts.code[rng.choice(len(texts.code), len(negative) // 4)] if len(texts.code) else np.zeros(0, np.int64)
        alone = alone[strong[alone] < 0.5]
        code, real = texts.inputs(document[rows], first[rows])
        filled = np.concatenate([code, np.repeat(alone[:, None], WINDOW, 1)])
        shown = np.concatenate([real, np.ones((len(alone), WINDOW), bool)])
        y = np.append(np.ones(len(positive)), np.zeros(len(negative) + len(alone))).astype(np.float32)
        share = np.where(y == 1, 0.5 * len(y) / max(len(positive), 1), 0.5 * len(y) / max(len(y) - len(positive), 1)).astype(np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for a in range(0, len(order), 256):
                pick = order[a : a + 256]
                words = filled[pick]
                used, local = np.unique(words, return_inverse=True)
                local = local.reshape(words.shape)
                inner = used < len(texts.word)
                buckets, lengths = texts.runs_of(used[inner])
                vectors = np.zeros((len(used), 2 * VECTOR), np.float32)
                row = np.where(rng.random(int(inner.sum())) < FORGET, 0, numbers[used[inner]])
                vectors[inner, :VECTOR] = net.p["words"][row]
                if len(lengths):
                    vectors[inner, VECTOR:] = np.add.reduceat(net.p["runs"][buckets], np.cumsum(lengths) - lengths, axis=0) / lengths[:, None]
                grads, d_x = net.gradients(vectors[local], shown[pick], y[pick], share[pick])
                d_vector = np.zeros_like(vectors)
                np.add.at(d_vector, local.ravel(), d_x.reshape(-1, 2 * VECTOR))
                for name, index, d in (("words", row, d_vector[inner, :VECTOR]), ("runs", buckets, np.repeat(d_vector[inner, VECTOR:] / np.maximum(lengths, 1)[:, None], lengths, axis=0))):
                    grads[name] = np.zeros_like(net.p[name])
                    np.add.at(grads[name], index, d)
                    grads[name] += 1e-6 * net.p[name]
                steps += 1
                for k, g in grads.items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    net.p[k] -= 0.01 * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)

    if not len(positive):
        return Toxicity.constant(label)
    train(positive, negative, epochs)
    for _ in range(2):  # then the most toxic windows of toxic texts, and windows of clean ones that look toxic
        logits = net.logits(texts, numbers, document[clean], first[clean])
        negative = np.union1d(negative, clean[np.argsort(-logits, kind="stable")[: len(negative) // 4]])
        logits = net.logits(texts, numbers, document[toxic], first[toxic])
        order = np.lexsort((-logits, document[toxic]))
        rank = np.arange(len(order)) - np.searchsorted(document[toxic][order], document[toxic][order])
        positive = toxic[order[(rank < 1) | (rank < 3) & (logits[order] > 0)]]
        train(positive, negative, max(1, epochs // 2))
    rest = apart if apart.any() else np.ones(len(label), bool)
    model.weights = _logistic(model.highest(texts)[rest], label[rest])
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights and intercept of a logistic regression, by Newton's method with a little ridge."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = _sigmoid(a @ w)
        h = a.T @ (a * (p * (1 - p))[:, None]) / len(y) + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, a.T @ (p - y) / len(y) + ridge * w)
    return w


def learn(documents: DataFrame, labels: DataFrame, train: Column, sample: int = SAMPLE) -> Toxicity:
    """The model from about `sample` labelled documents for which `train` holds, of samples.BYTES at most, in one task. Null labels
    are left out, null texts are empty, repeated ids count once; without labels of both kinds (also: an empty table) the
    score is a constant."""
    rows = labelled(documents, labels, "toxic", train, sample, BYTES).select("doc_id", "text", "label", "order")
    return fitted(rows, lambda t: fit(Texts.of(*utf8(t.column("text"))), (np.asarray(t.column("label")) > 0).astype(np.int64)))


def score(documents: DataFrame, model: Toxicity) -> DataFrame:
    """doc_id, score, predicted for each row of `documents` (doc_id, text; nothing else is read), from all windows of its whole
    text, very long ones as well. Null and empty texts are one window without words. Rows are scored each by itself, so
    repeated ones get equal scores and null ids stay null; an empty table gives an empty result."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(*utf8(batch.column("text"))))], names=["doc_id", "score"])

    return rows.mapInArrow(in_parts(run), "doc_id long, score double").withColumn("predicted", (F.col("score") >= REJECTED).cast("int"))


def accepted(documents: DataFrame, model: Toxicity) -> DataFrame:
    """The rows of `documents` that score below REJECTED, with all their columns, whatever they are called, in a new shared
    folder; scores as in `score`."""
    row = T.StructField("row", documents.schema, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.scores(*utf8(text_of(batch.column("row"))))
            yield batch.filter(pa.array(score < REJECTED))

    kept = documents.select(F.struct("*").alias("row")).mapInArrow(in_parts(run), T.StructType([row])).select("row.*")
    with batches_of(documents.sparkSession, BATCH_ROWS):
        return written(kept, f"{shared_dir(documents.sparkSession)}/accepted")
