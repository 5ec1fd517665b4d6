"""Language-model scores of order 2 or 3 from Elias-Fano tries, built and queried shard by shard.

Words are 64-bit hashes. Each word w goes with the two before it, u and v, to the cell (class of v, class of w) of a square
grid that grows with the input, so that a hot word is spread over a row or column of cells; within a document equal
triples travel once with their count. Each cell builds the trie of its training n-grams, memory-maps it and looks its triples
up: words, pairs, and triples under their prefix, named by their place among the children of their context's suffix.
Pairs that very many documents hold would still meet in one cell: the commonest pairs and triples, a bounded number at any
size, are counted beside the words and go in a trie of their own to all mappers, which score them on the spot. Other triples that
end in a common pair go to the cell (class of u, class of w), which counts them and takes the pair's count from that list.

P(w|v) = (1 - a) c(vw) / c(v) + a P(w), P(w) = (c(w) + 1) / (N + V + 1); a = 1 where v never occurred as a context.
P(w|uv) = (c(uvw) + m P(w|v)) / (c(uv) + m): a cell knows all of the numerator of its own pair's word and, as it has all of
the pair's occurrences, the denominator of the word after it, so one shuffle does. A text's first word has P(w|v) alone.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, batches_of, in_parts, mix, release, remainder, shared_dir, utf8, word_hashes, written
from .elias_fano import NgramTrie, Quantiser

BEGIN, END = np.uint64(0x1), np.uint64(0x2)
#: Tokens that a mapper gathers before it sends them, and pairs that a cell is planned for.
GATHER, CELL = 4_000_000, 3_500_000
#: Rows of a cell whose trie is built at once.
ROWS = 3 << 18
#: A pair is common that a SHARE-th of the documents of a sample of about SAMPLE of them have, and LEAST of them. There are at
#: most SHARE times as many of these as a document has pairs. Which ones are found changes who scores them, not the counts.
SAMPLE, SHARE, LEAST = 1 << 15, 512, 64
_SCORED = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, known_log double, score double"


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of a batch's texts, each with its END, and how many each text has."""
    words, at = word_hashes(*utf8(batch.column("text")))
    n = np.diff(at) + 1
    ends = np.zeros(len(words) + len(n), bool)
    ends[np.cumsum(n) - 1] = True
    tokens = np.empty(len(ends), np.uint64)
    tokens[ends], tokens[~ends] = END, words
    return tokens, n


def _before(tokens: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The token before each, within its text."""
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[np.cumsum(n) - n] = BEGIN
    return out


def _pair(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(before * np.uint64(0x9E3779B97F4A7C15) ^ word)


def _first(before: np.ndarray, n: np.ndarray, order: int) -> np.ndarray:
    """The token before the one before each; BEGIN where there is none, and everywhere in a model of pairs."""
    return _before(before, n) if order > 2 else np.full(len(before), BEGIN)


def _triple(first: np.ndarray, before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _pair(_pair(first, before), word)


def _tallied(order: int):
    """Pairs (and triples) of a sample's documents, and in how many of a part's documents each stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tallied(key, first, before, word, of, triple):
            order = np.lexsort((of, key))
            key, of = key[order], of[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
            order, key = order[new], key[new]
            _, at, count = np.unique(key, return_index=True, return_counts=True)
            at, count = order[at[count > 1]], count[count > 1]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), triple)), *(pa.array(x[at].view(np.int64)) for x in (first, before, word)), pa.array(count)], names=["triple", "first", "before", "word", "n"])

        for batch in batches:
            tokens, n = _tokens(batch)
            before, of = _before(tokens, n), np.repeat(np.arange(len(n)), n)
            yield tallied(_pair(before, tokens), np.full(len(tokens), BEGIN), before, tokens, of, False)
            if order > 2:
                inner = before != BEGIN
                grams = [x[inner] for x in (_first(before, n, order), before, tokens)]
                yield tallied(_triple(*grams), *grams, of[inner], True)

    return run


def _common_grams(rows: DataFrame, n: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The common pairs (before, word) and triples (first, before, word), each by their hash."""
    part = 1 << 20
    some = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(part)) < min(part, -(-SAMPLE * part // max(n, 1))))
    tallied = some.select("text").mapInArrow(in_parts(_tallied(order)), "triple boolean, first long, before long, word long, n long").groupBy("triple", "first", "before", "word").agg(F.sum("n").alias("n"))
    with batches_of(rows.sparkSession, BATCH_ROWS):
        found = tallied.where(F.col("n") >= max(LEAST, min(n, SAMPLE) // SHARE)).select("triple", "first", "before", "word").collect()
    pairs = np.array([tuple(r)[2:] for r in found if not r[0]], np.int64).reshape(-1, 2).view(np.uint64)
    triples = np.array([tuple(r)[1:] for r in found if r[0]], np.int64).reshape(-1, 3).view(np.uint64)
    return pairs[np.argsort(_pair(*pairs.T))], triples[np.argsort(_triple(*triples.T))]


def _common_pairs(rows: DataFrame, n: int) -> np.ndarray:
    return _common_grams(rows, n, 2)[0]


def _found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of those asked for stand in the sorted keys, and the places of these."""
    if not len(keys):
        return np.zeros(len(asked), bool), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    known = keys[at] == asked
    return known, at[known]


def _counts(common: np.ndarray, triples: np.ndarray, order: int):
    """(word, its training count, tokens, training documents) by batch; word 0 carries the totals. Common pairs and, after
    them, triples are counted as well, by their place in the list."""
    keys, longer = _pair(*common.T), _triple(*triples.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(len(keys) + len(longer), np.int64)

        def flush(parts):
            word, n = np.unique(np.concatenate([p[0] for p in parts]), return_counts=True)
            some = np.flatnonzero(pairs)
            zero = np.zeros(len(n) + len(some), np.int64)
            out = pa.RecordBatch.from_arrays([pa.array(np.append(np.repeat(False, len(n) + 1), np.repeat(True, len(some)))), pa.array(np.concatenate([word.view(np.int64), [0], some])), pa.array(np.concatenate([n, [0], pairs[some]])), pa.array(np.insert(zero, len(n), sum(p[1] for p in parts))), pa.array(np.insert(zero, len(n), sum(p[2] for p in parts)))], names=["pair", "word", "n", "tokens", "documents"])
            pairs[:] = 0
            return out

        parts, held = [], 0
        for batch in batches:
            tokens, n = _tokens(batch)
            train = ~np.asarray(batch.column("held_out"))
            keep = np.repeat(train, n)
            parts.append((tokens[keep], len(tokens), int(train.sum())))
            if len(keys):
                before = _before(tokens, n)
                hot, at = _found(keys, _pair(before[keep], tokens[keep]))
                pairs += np.bincount(at, minlength=len(pairs))
                if len(longer):
                    _, at = _found(longer, _triple(*(x[keep][hot] for x in (_first(before, n, order), before, tokens))))
                    pairs += np.bincount(len(keys) + at, minlength=len(pairs))
            held += len(parts[-1][0])
            if held >= GATHER:
                yield flush(parts)
                parts, held = [], 0
        if parts:
            yield flush(parts)

    return run


def _classes(words: np.ndarray, side: int) -> np.ndarray:
    return ((words >> np.uint64(20)) % np.uint64(side)).astype(np.int64)


def _packed(*arrays: np.ndarray) -> bytes:
    """The arrays, compressed; first bytes of numbers, then second bytes and so on, as the upper ones are much alike."""
    head = struct.pack("<i", len(arrays)) + b"".join(struct.pack("<2sq", a.dtype.str[1:].encode(), len(a)) for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays))


def _unpacked(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,), at, out = struct.unpack_from("<i", raw), 4, []
    kinds = [struct.unpack_from("<2sq", raw, at + 10 * k) for k in range(n)]
    at += 10 * n
    for kind, length in kinds:
        dtype = np.dtype("<" + kind.decode())
        planes = np.frombuffer(raw, np.uint8, dtype.itemsize * length, at).reshape(dtype.itemsize, length)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype))
        at += dtype.itemsize * length
    return out


def _narrow(a: np.ndarray) -> np.ndarray:
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64)


@dataclass
class Model:
    """The corpus totals and the parameters."""

    n_train: int
    n_words: int
    n_documents: int
    share: float
    bits: int
    order: int
    strength: float


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and each one's place among them."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    which = np.empty(len(keys), np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - 1
    return keys[new], which


class Grams:
    """Different triples of word numbers in lexicographic order, their prefixes (`heads`) and suffixes (`pairs`) as different
    numbers first * width + second, and each triple's place in these."""

    def __init__(self, first: np.ndarray, before: np.ndarray, word: np.ndarray, width: int):
        """`which`: the place of each row given among the triples."""
        self.width = np.int64(width)
        self.heads, head = _numbered(first * self.width + before)
        keys, self.which = _numbered(head * self.width + word)
        del head
        self.head, self.word = (x.astype(np.int32) for x in np.divmod(keys, self.width))
        del keys
        self.before = (self.heads % self.width).astype(np.int32)[self.head]
        self.pairs, self.pair = _numbered(self.before * self.width + self.word)


class Scores:
    """Scores of n-grams over some words (the place of each is its number) from the trie of the training n-grams. Its levels are
    the words with their log10 P(w), the pairs with their log10 P(w|v) and, as a context, log10 (c(vw) + m), and the triples with
    log10 (c(uvw) + m P(w|v)). Pairs that only begin a triple are nodes without a score: they are scored in another cell."""

    def __init__(self, words: np.ndarray, count: np.ndarray, grams: Grams, pairs: np.ndarray, triples: np.ndarray, model: Model):
        """pairs, triples: the training counts of those of `grams`."""
        self.grams, self.model = grams, model
        width = grams.width
        context = count.copy()
        context[words == BEGIN] = model.n_documents
        self.inner = (words != BEGIN)[grams.before] if model.order > 2 else np.zeros(len(grams.word), bool)
        unigram = (count + 1) / float(model.n_train + model.n_words + 1)
        self.trie = NgramTrie(len(words), model.bits)
        alone = Quantiser(np.log10(unigram), model.bits)
        self.alone = alone.value(alone.code(np.log10(unigram)))
        self.back = np.where(context > 0, np.log10(model.share), 0.0)
        have = np.flatnonzero(pairs)
        before, word = grams.pairs[have] // width, grams.pairs[have] % width
        p = np.zeros(len(pairs))
        p[have] = (1 - model.share) * pairs[have] / context[before] + model.share * unigram[word]
        long = np.flatnonzero(self.inner & (triples > 0))
        # heads are in order along the triples
        used = grams.heads[grams.head[long][np.diff(grams.head[long], prepend=-1) > 0]]
        nodes = np.sort(np.concatenate([grams.pairs[have], used]))
        nodes = nodes[np.diff(nodes, prepend=-1) > 0]
        at = np.searchsorted(nodes, grams.pairs)
        scores, contexts = np.full(len(nodes), np.log10(p[have].min()) if len(have) else 0.0), np.full(len(nodes), np.log10(model.strength))
        scores[at[have]], contexts[at[have]] = np.log10(p[have]), np.log10(pairs[have] + model.strength)
        self.trie.add_level(np.stack([nodes // width, nodes % width], 1), scores, contexts)
        if model.order > 2:
            parents = np.searchsorted(nodes, grams.heads)[grams.head[long]]
            names = (at - np.searchsorted(nodes, grams.pairs // width * width))[grams.pair[long]]
            del nodes, at, scores, contexts
            self.trie.add_level(np.broadcast_to(np.int64(0), (len(long), 3)), np.log10(triples[long] + model.strength * p[grams.pair[long]]), places=(parents, names))

    def of(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each pair its log10 P(w|v) and its log10 (c(vw) + m); for each triple the first of these, or the log10 of the
        numerator of P(w|uv) where it has two words before it."""
        grams, width, m = self.grams, self.grams.width, np.log10(self.model.strength)
        before, word = grams.pairs // width, grams.pairs % width
        node = self.trie.children(2, before, word)
        alone = self.alone[word] + self.back[before]
        contexts = np.full(len(node), m)
        known = node >= 0
        alone[known], contexts[known] = self.trie.values(2, node[known]), self.trie.values(2, node[known], 1)
        score = alone[grams.pair]
        if self.model.order > 2:
            name = np.where(known, node - self.trie.levels[0][0].access(before), -1)  # among the children of the context's suffix
            parents = self.trie.children(2, grams.heads // width, grams.heads % width)
            score[self.inner] += m
            for i in range(0, len(score), 1 << 17):
                part = slice(i, i + (1 << 17))
                place = self.trie.children(3, np.where(self.inner[part], parents[grams.head[part]], -1), name[grams.pair[part]])
                found = np.flatnonzero(place >= 0)
                score[i + found] = self.trie.values(3, place[found])
        return alone, contexts, score


class Common:
    """The common pairs and triples with their scores, from a trie over their own words."""

    def __init__(self, pairs: np.ndarray, seen: np.ndarray, triples: np.ndarray, longer: np.ndarray, words: np.ndarray, count: np.ndarray, model: Model):
        self.pairs, self.seen, self.triples, self.longer = pairs, seen, triples, longer
        self.words, self.count, self.model = words, count, model
        self.keys, self.long_keys = _pair(*pairs.T), _triple(*triples.T)
        self.scores: tuple | None = None

    def _scored(self) -> tuple:
        """The training count of each pair's word, its log10 P(w|v) and context; the numerator's log10 of each triple."""
        pairs, triples = np.searchsorted(self.words, self.pairs), np.searchsorted(self.words, self.triples)
        # a pair stands as a triple too, after BEGIN, so that all are pairs of the trie; with no count, as such it is none
        begin = np.searchsorted(self.words, BEGIN)
        grams = Grams(*np.concatenate([triples, np.insert(pairs, 0, begin, 1)]).T, len(self.words))
        long, short = grams.which[: len(triples)], grams.pair[grams.which[len(triples) :]]
        seen2, seen3 = np.zeros(len(grams.pairs), np.int64), np.zeros(len(grams.word), np.int64)
        seen2[short], seen3[long] = self.seen, self.longer
        alone, contexts, score = Scores(self.words, self.count, grams, seen2, seen3, self.model).of()
        return self.count[pairs[:, 1]], alone[short], np.where(self.pairs[:, 1] == END, 0.0, contexts[short]), score[long]

    def scored(self, first: np.ndarray, before: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which of the tokens end common pairs and which of them are thereby done; of the former the training count of the word, and
        what is known of the score."""
        known, at = _found(self.keys, _pair(before, word))
        if not len(at):
            return known, known, np.zeros(0, np.int64), np.zeros(0)
        if self.scores is None:  # in each process
            self.scores = self._scored()
        count, alone, contexts, longer = self.scores
        if self.model.order == 2:
            return known, known, count[at], alone[at]
        first, before, word = first[known], before[known], word[known]
        score, done = -contexts[at], before == BEGIN
        score[done] += alone[at[done]]
        common, place = _found(self.long_keys, _triple(first, before, word))
        score[common] += longer[place]
        all_done = known.copy()
        all_done[known] = done | common
        return known, all_done, count[at], score

    def __getstate__(self) -> dict:
        return self.__dict__ | {"scores": None}


def _pairs(side: int, common: Common):
    def numbers(width: int, *columns: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The different numbers below `width` of some columns, frequent ones first, and the columns in places of this list."""
        if 8 * len(columns[0]) < width:
            known, both = np.unique(np.concatenate(columns), return_inverse=True)
        else:
            place = np.zeros(width, np.int32)
            for c in columns:
                place[c] = 1
            known = np.flatnonzero(place)
            place[known] = np.arange(len(known))
            both = place[np.concatenate(columns)]
        n = np.bincount(both, minlength=len(known))
        order = np.argsort((n < 32).astype(np.uint8) + (n < 8) + (n < 3), kind="stable")
        place = np.empty(len(known), np.int64)
        place[order] = np.arange(len(known))
        return known[order], np.split(place[both], len(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts):
            words = np.concatenate([p[0] for p in parts])
            lengths, uid, ids, flags, *done = (np.concatenate([p[k] for p in parts]) for k in range(1, 8))
            hot, ready = (np.concatenate([p[k] for p in parts]) for k in (8, 9))
            parts.clear()
            # what is known of the documents themselves, and what mappers score, goes in a blob of its own, to any cell
            own = _packed(*(x[1:] for x in (uid, ids, flags, lengths, *done)))
            each, code = _numbered(words)
            del words
            release()
            # the word before a document's first token is BEGIN, whose number is 0 as no hash is smaller
            begins = np.cumsum(lengths) - lengths

            def shifted(x):
                out = np.empty_like(x)
                out[1:] = x[:-1]
                out[begins] = 0
                return out

            before = shifted(code)
            first = shifted(before) if common.model.order > 2 else np.zeros_like(before)
            left = np.flatnonzero(~ready)
            document = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)[left]
            first, before, code, hot = first[left], before[left], code[left], hot[left]
            del left, ready
            width = len(each)
            if len(lengths) * float(width) ** 2 >= 2**62:
                order = np.lexsort((first, code, before, document))
            else:
                key = (document * np.int64(width) + before) * width + code
                order = np.argsort(key)
                key = key[order]
                # among equal ones by the first word
                same = key[1:] == key[:-1]
                tied = np.flatnonzero(np.append(same, False) | np.append(False, same)) if len(key) else order
                order[tied] = order[tied][np.lexsort((first[order[tied]], key[tied]))]
                del key, same, tied
            document, first, before, code, hot = document[order], first[order], before[order], code[order], hot[order]
            new = np.ones(len(order), bool)
            new[1:] = (document[1:] != document[:-1]) | (before[1:] != before[:-1]) | (code[1:] != code[:-1]) | (first[1:] != first[:-1])
            n = np.diff(np.append(np.flatnonzero(new), len(order))).astype(np.int32)
            document, first, before, code, hot = document[new], first[new], before[new], code[new], hot[new]
            del order, new
            release()
            kind = _classes(each, side)
            cell = (kind[np.where(hot, first, before)] * side + kind[code]).astype(np.uint16 if side < 256 else np.uint32)
            order = np.argsort(cell, kind="stable")
            cut = np.searchsorted(cell[order], np.arange(side * side + 1))
            out = ([], [])
            for k in range(side * side):
                mine = order[cut[k] : cut[k + 1]]
                if len(mine):
                    d = document[mine]
                    step = np.diff(d, prepend=d[:1]) > 0
                    docs = d[np.append(0, np.flatnonzero(step))]
                    known, columns = numbers(width, first[mine], before[mine], code[mine])
                    out[0].append(k)
                    out[1].append(_packed(np.diff(uid[docs], prepend=0), flags[docs], np.diff(each[known], prepend=np.uint64(0)), step.view(np.uint8), *map(_narrow, columns), _narrow(n[mine])))
                if len(out[0]) == 8 or k == side * side - 1 and out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(np.zeros(len(out[0]), np.int32)), pa.array(out[1], pa.binary())], names=["cell", "kind", "blob"])
                    out = ([], [])
            yield pa.RecordBatch.from_arrays([pa.array([int(uid[-1]) * 31 % side**2], pa.int64()), pa.array([3], pa.int32()), pa.array([own], pa.binary())], names=["cell", "kind", "blob"])

        parts, held = [], 0
        for batch in batches:
            tokens, n = _tokens(batch)
            ids = batch.column("doc_id")
            flags = np.asarray(batch.column("held_out")).astype(np.uint8) + 2 * np.asarray(ids.is_null()).astype(np.uint8)
            if not parts:  # gives BEGIN number 0; as it is done, nothing of it is sent
                parts.append((np.array([BEGIN]), np.array([1]), np.array([-1]), np.array([0]), np.array([0], np.uint8), *(np.zeros(1, k) for k in (np.int64, float, float)), np.array([False]), np.array([True])))
            before = _before(tokens, n)
            hot, ready, count, score = common.scored(_first(before, n, common.model.order), before, tokens)
            of = np.repeat(np.arange(len(n)), n)[hot]
            done = [np.bincount(of, count > 0, len(n)).astype(np.int64), np.bincount(of, np.log10(count + 1.0), len(n)), np.bincount(of, score, len(n))]
            parts.append((tokens, n, np.asarray(batch.column("uid")), np.asarray(ids.fill_null(0)), flags, *done, hot, ready))
            held += len(tokens)
            if held >= GATHER:
                yield from flush(parts)
                parts, held = [], 0
        if parts:
            yield from flush(parts)

    return run


def _by_class(side: int):
    def run(key: tuple, vocabulary: pa.Table) -> pa.Table:
        """A class of the vocabulary, for each cell of its row (kind 1) and of its column (kind 2)."""
        word, n = (np.asarray(vocabulary.column(c)) for c in ("word", "n"))
        word = word.view(np.uint64)
        order = np.argsort(word)
        word, n = word[order], n[order]
        blob = _packed(np.diff(word, prepend=np.uint64(0)), _narrow(n))
        k = int(key[0].as_py())
        cells = [k * side + j for j in range(side)] + [i * side + k for i in range(side)]
        return pa.table({"cell": pa.array(cells, pa.int64()), "kind": pa.array([1] * side + [2] * side, pa.int32()), "blob": pa.array([blob] * (2 * side), pa.binary())})

    return run


def _cell(common: Common):
    model = common.model

    def looked_up(words: np.ndarray, blobs: list[bytes]) -> np.ndarray:
        if not blobs:
            return np.zeros(len(words), np.int64)
        steps, n = _unpacked(blobs[0])
        have = np.cumsum(steps)
        at = np.minimum(np.searchsorted(have, words), len(have) - 1)
        return np.where(have[at] == words, n[at].astype(np.int64), 0)

    def scored(words: np.ndarray, count: np.ndarray, grams: Grams, n: np.ndarray, train: np.ndarray) -> Iterator[np.ndarray]:
        """Of rows with these grams, n times each, whether the word is known, its log10 (count + 1) and the score."""
        longer = np.bincount(grams.which, weights=np.where(train, n, 0), minlength=len(grams.word)).astype(np.int64)
        seen = np.bincount(grams.pair, weights=longer, minlength=len(grams.pairs)).astype(np.int64)
        before, word = grams.pairs // grams.width, grams.pairs % grams.width
        # mappers have counted these, and taken off the contexts that they are
        hot, at = _found(common.keys, _pair(words[before], words[word]))
        seen[hot] = common.seen[at]
        _, contexts, score = Scores(words, count, grams, seen, longer, model).of()
        if model.order > 2:
            score -= np.where(hot | (words[word] == END), 0.0, contexts)[grams.pair]
        plain = np.where(hot, 0.0, np.log10(count + 1.0)[word])[grams.pair]
        known = (~hot & (count > 0)[word])[grams.pair]
        return (n * x[grams.which] for x in (known, plain, score))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """All rows of a pair are in one shard of the cell, which has a trie of its own."""
        release()  # what the cell before freed
        kind, blobs = np.asarray(rows.column("kind")), rows.column("blob")
        mine = [int(k) for k in np.flatnonzero(kind == 0)]
        names = ["uid", "doc_id", "held_out", "n_tokens", "n_known", "known_log", "score"]
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

        def told(uid, doc, held, n, *sums) -> pa.Table:
            return pa.table([pa.nulls(len(uid), t) if x is None else x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip((uid, doc, held, n, *sums), types, strict=True)], names=names)

        done = [told(*(np.zeros(0, t.to_pandas_dtype()) for t in types))]
        for k in np.flatnonzero(kind == 3):
            uid, doc, flag, *sums = _unpacked(blobs[int(k)].as_py())
            done.append(told(uid, pa.array(doc, mask=flag & 2 > 0), flag & 1 > 0, *sums))
        if not mine:
            return pa.concat_tables(done)
        vocabulary = [[blobs[int(k)].as_py() for k in np.flatnonzero(kind == side)] for side in (1, 2)]
        got, rows_before, words_before = [], 0, 0
        dictionary = []
        for k in mine:
            uid, flag, words, step, first, before, word, n = _unpacked(blobs[k].as_py())
            got.append((np.cumsum(uid), flag, np.cumsum(step, dtype=np.int32) + np.int32(rows_before), *(x.astype(np.int32) + np.int32(words_before) for x in (first, before, word)), n.astype(np.int32)))
            dictionary.append(np.cumsum(words))
            rows_before, words_before = rows_before + len(uid), words_before + len(words)
        uid, flag, row, first, before, word, n = (np.concatenate([g[k] for g in got]) for k in range(7))
        del got
        dictionary = np.concatenate(dictionary)
        words, code = _numbered(dictionary)
        del dictionary
        # the class of a word's column, or of its row: as a context it may be in the row alone
        count = np.maximum(looked_up(words, vocabulary[0]), looked_up(words, vocabulary[1]))
        known, at = _found(common.words, words)
        count[known] = common.count[at]
        first, before, word = code[first], code[before], code[word]
        del code
        shards = -(-len(row) // ROWS)
        shard = ((before * np.int64(31) + word) % shards).astype(np.uint16)
        train, sums = flag & 1 == 0, [np.zeros(len(uid)) for _ in range(3)]
        for k in range(shards):
            release()
            some = np.flatnonzero(shard == k)
            at = row[some]
            for total, x in zip(sums, scored(words, count, Grams(first[some], before[some], word[some], len(words)), n[some], train[at]), strict=True):
                total += np.bincount(at, weights=x, minlength=len(uid))
        return pa.concat_tables([*done, told(uid, None, None, None, sums[0].astype(np.int64), *sums[1:])])

    return run


def score_documents(documents: DataFrame, held_out, share: float = 0.5, bits: int = 16, order: int = 2, strength: float = 2.0) -> DataFrame:
    """Scores of each row of `documents` (doc_id, text; other columns are not read) under the model of the rows where the
    column `held_out` is false. A text's tokens are its words, lower-cased, and one end; null and empty texts have the end
    alone. Rows with equal ids are scored apart; a null id stays null. An empty table gives an empty result, and where no
    row may be learnt from every word is unknown.

    order: 2 or 3; share: weight of the unigram in the pairs' interpolation; strength: how many occurrences of its context the
    pair's probability counts as in that of a triple (m above); bits: of a quantised probability."""
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    spark = documents.sparkSession
    to = shared_dir(spark)
    rows = documents.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    pairs, triples = _common_grams(rows, rows.count(), order)
    counted = rows.select("text", "held_out").mapInArrow(in_parts(_counts(pairs, triples, order)), "pair boolean, word long, n long, tokens long, documents long")
    with batches_of(spark, BATCH_ROWS):
        counts = written(counted.groupBy("pair", "word").agg(*(F.sum(c).alias(c) for c in ("n", "tokens", "documents"))), f"{to}/vocabulary")
    vocabulary = counts.where(~F.col("pair"))
    totals = vocabulary.agg(F.sum("n"), F.sum((F.col("n") > 0).cast("long")), F.sum("tokens"), F.sum("documents")).first()
    n_train, n_words, n_tokens, n_documents = (int(x or 0) for x in totals)
    model = Model(n_train, n_words, n_documents, share, bits, order, strength)
    common = _looked_up(pairs, triples, counts, model)
    side = max(6, int(np.ceil(np.sqrt(n_tokens / CELL))))
    blobs = rows.mapInArrow(in_parts(_pairs(side, common)), "cell long, kind int, blob binary")
    known = vocabulary.where("n > 0").select(F.expr(f"pmod(shiftrightunsigned(word, 20), {side})").alias("class"), "word", "n")
    spread = known.groupBy("class").applyInArrow(_by_class(side), "cell long, kind int, blob binary")
    scored = blobs.unionByName(spread).groupBy("cell").applyInArrow(_cell(common), _SCORED)
    floor = float(np.log10(n_train + n_words + 1))
    found = scored.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "known_log", "score")))
    found = found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), (F.col("known_log") - F.col("n_tokens") * F.lit(floor)).alias("base_score"), "score")
    with batches_of(spark, BATCH_ROWS):
        return written(found, f"{to}/scores")


def _looked_up(pairs: np.ndarray, triples: np.ndarray, counts: DataFrame, model: Model) -> Common:
    """The common pairs and triples with their training counts and those of their words."""
    words = np.unique(np.concatenate([[BEGIN], pairs.reshape(-1), triples.reshape(-1)]))
    wanted = counts.sparkSession.createDataFrame(pa.table({"word": pa.array(words.view(np.int64))}))
    got = counts.where(~F.col("pair") & (F.col("n") > 0)).join(F.broadcast(wanted), "word", "left_semi").select("word", "n").collect()
    count = np.zeros(len(words), np.int64)
    if got:
        count[np.searchsorted(words, np.array([r[0] for r in got], np.int64).view(np.uint64))] = [r[1] for r in got]
    seen = np.zeros(len(pairs) + len(triples), np.int64)
    for at, n in counts.where("pair").select("word", "n").collect():
        seen[at] = n
    return Common(pairs, seen[: len(pairs)], triples, seen[len(pairs) :], words, count, model)


def held_out_rows():
    return remainder("doc_id", 7) == 2
