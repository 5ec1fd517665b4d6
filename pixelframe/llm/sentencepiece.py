"""SentencePiece encoding and decoding with a model's pieces and scores: by the merges of a BPE model, or the segmentation of
the largest total score, which is the rule of unigram models.

Merges never cross two neighbours that no piece holds, so the parts between such places are merged apart, and longer texts are
cut at them. For the largest total there may be no such place near by. A text longer than a few chunks is cut anywhere. A chunk yields a transfer matrix in the max-plus semiring: the best
score from each number of its first characters that a piece from the left covers to each number of characters beyond its
end that its last piece covers. The matrices of a document combine associatively, give the states at the cuts, and then
each chunk is traced back by itself, from state to state. Scores are integers, with a fraction in fixed point, whose low bits are pseudo-random, by piece and
place in the word, so sums don't depend on the order of addition and two segmentations as good as never tie.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, batches_of, in_parts, mix, shared_dir, written

#: Characters of a chunk, and of texts that go in chunks.
CHUNK, GIANT = 1 << 14, 1 << 16
#: Bytes of segments and their ids that a worker remembers, and what one takes besides its characters.
REMEMBERED, OVERHEAD = 32 << 20, 200
#: Characters of a part up to which merges look through all neighbours.
SHORT = 48
SPACE = "▁"
_NONE = np.iinfo(np.int64).min // 4
_LOWEST, _BITS, _MASK = -(1 << 20), 20, (1 << 20) - 1
#: Words, and finer: letters apart from other characters, for models none of whose pieces has both.
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_FINE = re.compile(rf"{SPACE}*[^\W\d_¹²³¼½¾]+|{SPACE}*(?:[\d_¹²³¼½¾]|[^\w{SPACE}])+|{SPACE}+")
_LETTER = re.compile(r"[^\W\d_¹²³¼½¾]")
_loaded: dict[str, Pieces] = {}


class _Memory(dict):
    """The ids of segments, as bytes: those asked for lately, in two generations of half of REMEMBERED."""

    def __init__(self, ids_of: Callable[[str], list[int]]):
        super().__init__()
        self.ids_of, self.before, self.held = ids_of, {}, 0

    def __missing__(self, segment: str) -> bytes:
        got = self.before.get(segment)
        if got is None:
            got = _bytes(self.ids_of(segment))
        self.held += OVERHEAD + len(segment) + len(got)
        if 2 * self.held > REMEMBERED:
            self.before = dict(self)
            self.clear()
            self.held = OVERHEAD + len(segment) + len(got)
        self[segment] = got
        return got

    def forget(self) -> None:
        self.clear()
        self.before, self.held = {}, 0


def _bytes(ids: list[int]) -> bytes:
    return np.array(ids, "<i4").tobytes() if len(ids) > 8 else struct.pack(f"<{len(ids)}i", *ids)


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol buffer."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if raw[at - 1] < 128:
                return value, at

    at = 0
    while at < len(raw):
        tag, at = number(at)
        value, end = number(at) if tag & 7 in (0, 2) else (0, at + (4 if tag & 7 == 5 else 8))
        if tag & 7 == 2:
            at, end = end, end + value
        yield tag >> 3, value if tag & 7 == 0 else raw[at:end]
        at = end


def is_bpe(path: str) -> bool:
    """Whether the model says that its pieces are to be merged."""
    with open(path, "rb") as f:
        return any(k == 2 and dict(_fields(v)).get(3) == 2 for k, v in _fields(f.read()))


def _types(path: str) -> set[int]:
    """The types that pieces have."""
    with open(path, "rb") as f:
        return {dict(_fields(v)).get(3, 1) for k, v in _fields(f.read()) if k == 1}


class Pieces:
    """The vocabulary of a .model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        for probe in ("", " a  b ", "ﬁ Ａ\n\tx"):
            if model.normalize(probe) != normalise(probe):
                raise ValueError("only models that change no characters are read")
        n = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        low = (mix(np.arange(n, dtype=np.uint64) + np.uint64(1)) & np.uint64((1 << _BITS) - 1)).astype(np.int64)
        scores = [max(model.get_score(i), _LOWEST) for i in range(n)]
        unknown = min([scores[i] for i in normal], default=0) - 10
        # as many bits of the fraction as leave the sums of a chunk within 60
        highest = max([abs(scores[i]) for i in normal] + [abs(unknown)])
        self.fraction = 1 << min(20, 60 - _BITS - CHUNK.bit_length() - int(highest).bit_length())
        self.unknown = int(round(unknown * self.fraction)) << _BITS
        self.scored = [(i, scores[i], int(low[i]) | 1) for i in normal]
        self.longest = max((len(self.names[i]) for i in normal), default=1)
        #: Neighbours within some piece; between any others every path has a node.
        self.pairs = {self.names[i][k : k + 2] for i in normal for k in range(len(self.names[i]) - 1)}
        if any(pair[1] == SPACE != pair[0] for pair in self.pairs):
            raise ValueError("pieces across words aren't read")
        apart = not any(bool(_LETTER.match(a)) != bool(_LETTER.match(b)) for a, b in self.pairs if SPACE not in (a, b))
        self.segments = (_FINE if apart else _WORD).findall
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(not model.is_byte(i) for i in self.byte_ids):
            raise ValueError("the model has no bytes to fall back on")
        self.content = [b"" if model.is_control(i) or model.is_unknown(i) else name.encode() for i, name in enumerate(self.names)]
        for b, i in enumerate(self.byte_ids):
            self.content[i] = bytes([b])
        self.memory = _Memory(lambda word: self.word(word)[0])
        #: What merging makes, by rank: the order of scores, the highest first.
        order = {s: k for k, s in enumerate(sorted({scores[i] for i in normal}, reverse=True))}
        self.ranks = {self.names[i]: order[scores[i]] for i in normal}
        self.ids = {self.names[i]: i for i in normal}
        self.merged = _Memory(self.merge)
        self.plain_types = _types(path) <= {1, 2, 3, 6}

    @cached_property
    def arcs(self) -> dict[str, tuple[int, int, int] | None]:
        """Pieces, and (None) what some piece begins with."""
        out: dict[str, tuple[int, int, int] | None] = {}
        for i, _, _ in self.scored:
            for k in range(1, len(self.names[i])):
                out.setdefault(self.names[i][:k], None)
        for i, score, low in self.scored:
            out[self.names[i]] = (i, int(round(score * self.fraction)) << _BITS, low)
        return out

    @classmethod
    def of(cls, path: str) -> Pieces:
        """The pieces, read once in each process."""
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def arcs_from(self, text: str, at: int, place: int) -> list[tuple[int, int, int]]:
        """(length, id, score) of the pieces at that place, which is the `place`-th of its word; without one of a single
        character, -1 for its bytes."""
        out, arcs = [], self.arcs
        for end in range(at + 1, min(len(text), at + self.longest) + 1):
            piece = text[at:end]
            if piece not in arcs:
                break
            if (got := arcs[piece]) is not None:
                out.append((end - at, got[0], got[1] + (got[2] * (place + 1) & _MASK)))
        if not out or out[0][0] != 1:
            out.append((1, -1, self.unknown))
        return out

    def parts(self, text: str) -> list[str]:
        """The text, cut wherever every path has a node."""
        cuts = [0, *(k for k in range(1, len(text)) if text[k - 1 : k + 1] not in self.pairs), len(text)]
        return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def lattice(self, text: str, n: int, place: int) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """The arcs from each of the first n characters; the first is the `place`-th of its word."""
        origin = -place
        for at in range(n):
            if at and text[at - 1 : at + 1] not in self.pairs:
                origin = at
            yield at, self.arcs_from(text, at, at - origin)

    def spelled(self, text: str, found: list[tuple[int, int, int]]) -> list[int]:
        """Ids of (begin, end, id) in order, with the bytes of characters that have no piece."""
        out: list[int] = []
        for begin, end, i in found:
            if i >= 0:
                out.append(i)
            else:
                out.extend(self.byte_ids[b] for b in text[begin:end].encode("utf-8", "surrogatepass"))
        return out

    def best(self, text: str, n: int | None = None, start: int = 0, end: int = 0, place: int = 0) -> tuple[list[int], int]:
        """Ids and score of the best path through text[:n] whose first `start` characters are covered already and whose last
        piece ends `end` characters beyond."""
        n = len(text) if n is None else n
        score: list[int | None] = [None] * (n + self.longest + 1)
        back: list[tuple[int, int] | None] = [None] * len(score)
        score[start] = 0
        for at, arcs in self.lattice(text, n, place):
            if (so_far := score[at]) is None:
                continue
            for length, i, s in arcs:
                if score[at + length] is None or so_far + s > score[at + length]:
                    score[at + length] = so_far + s
                    back[at + length] = (at, i)
        at, found = n + end, []
        while at != start:
            begin, i = back[at]
            found.append((begin, at, i))
            at = begin
        return self.spelled(text, found[::-1]), score[n + end]

    def word(self, text: str) -> tuple[list[int], int]:
        """As `best`, for a whole word: nearly all time goes here."""
        n, longest, arcs, pairs, unknown = len(text), self.longest, self.arcs, self.pairs, self.unknown
        score, back, ids, origin = [0] + [_NONE] * n, [0] * (n + 1), [-1] * (n + 1), 0
        for at in range(n):
            so_far = score[at]
            if text[at - 1 : at + 1] not in pairs:
                origin = at
            place = at - origin + 1
            if text[at] not in arcs or arcs[text[at]] is None:
                if so_far + unknown > score[at + 1]:
                    score[at + 1], back[at + 1], ids[at + 1] = so_far + unknown, at, -1
            for end in range(at + 1, min(n, at + longest) + 1):
                piece = text[at:end]
                if piece not in arcs:
                    break
                if (got := arcs[piece]) is not None:
                    value = so_far + got[1] + (got[2] * place & _MASK)
                    if value > score[end]:
                        score[end], back[end], ids[end] = value, at, got[0]
        at, found = n, []
        while at:
            found.append((back[at], at, ids[at]))
            at = back[at]
        return self.spelled(text, found[::-1]), score[n]

    def merge(self, text: str) -> list[int]:
        """Ids of a part by merges: of the neighbours that make a piece, those of the highest score, the leftmost first."""
        if not self.plain_types:
            raise ValueError("merges aren't read with pieces that are unused or the user's")
        ranks, n = self.ranks, len(text)
        if n <= SHORT:
            symbols, none = list(text), len(ranks)
            pairs = [ranks.get(a + b, none) for a, b in zip(symbols, symbols[1:], strict=False)]
            while pairs and (least := min(pairs)) < none:
                k = pairs.index(least)
                symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
                del pairs[k]
                if k:
                    pairs[k - 1] = ranks.get(symbols[k - 1] + symbols[k], none)
                if k < len(pairs):
                    pairs[k] = ranks.get(symbols[k] + symbols[k + 1], none)
            ids, out = self.ids, []
            for symbol in symbols:
                if (i := ids.get(symbol)) is not None:
                    out.append(i)
                else:
                    out.extend(self.byte_ids[b] for b in symbol.encode("utf-8", "surrogatepass"))
            return out
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the symbol that begins at each place; 0: none does
        heap = [(rank, k, k + 2) for k in range(n - 1) if (rank := ranks.get(text[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, a, c = heapq.heappop(heap)
            b = ends[a]
            # both symbols must still be those that the entry was made of
            if not b or b >= c or ends[b] != c:
                continue
            ends[a], ends[b] = c, 0
            if c < n:
                before[c] = a
                if (rank := ranks.get(text[a : ends[c]])) is not None:
                    heapq.heappush(heap, (rank, a, ends[c]))
            if a and (rank := ranks.get(text[before[a] : c])) is not None:
                heapq.heappush(heap, (rank, before[a], c))
        found, at = [], 0
        while at < n:
            found.append((at, ends[at], self.ids.get(text[at : ends[at]], -1)))
            at = ends[at]
        return self.spelled(text, found)

    def encode(self, text: str | None, merges: bool = False) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        memory = self.merged if merges else self.memory
        return b"".join([memory[part] for part in self.segments(normalise(text or ""))])

    def forget(self) -> None:
        self.memory.forget()
        self.merged.forget()

    def decode(self, ids: bytes) -> str:
        content = self.content
        text = b"".join([content[i] for i in np.frombuffer(ids, "<i4").tolist()]).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text

    def transfer(self, text: str, n: int, place: int) -> np.ndarray:
        """The matrix of a chunk text[:n], whose first character is the `place`-th of its word; the rest of the text is the
        beginning of what follows."""
        k = self.longest
        cuts = [i for i in range(max(k - 1, 1), n) if text[i - 1 : i + 1] not in self.pairs]
        until = cuts[0] if cuts else n
        best = np.full((until + k + 1, k), _NONE, np.int64)
        for i in range(k):
            best[min(i, until + k), i] = 0
        for at, arcs in self.lattice(text, until, place):
            for length, _, s in arcs:
                np.maximum(best[at + length], np.maximum(best[at] + s, _NONE), out=best[at + length])
        if not cuts:
            return np.maximum(best[n : n + k].T, _NONE)
        middle = sum(self.word(part)[1] for part in self.parts(text[cuts[0] : cuts[-1]]))
        tail = np.full(n - cuts[-1] + k + 1, _NONE, np.int64)
        tail[0] = 0
        rest = text[cuts[-1] :]
        for at, arcs in self.lattice(rest, n - cuts[-1], 0):
            for length, _, s in arcs:
                tail[at + length] = max(tail[at + length], tail[at] + s)
        return np.maximum(np.maximum(best[until][:, None] + middle, _NONE) + tail[n - cuts[-1] : n - cuts[-1] + k], _NONE)


def normalise(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def cut(text: str, size: int, pieces: Pieces) -> Iterator[tuple[str, int, int]]:
    """Chunks of a normalised text, each with the characters that a piece may reach beyond it; how many are its own; and
    the place of its first one after the last node that all paths have."""
    for c in range(0, len(text), size):
        word = c
        while word and text[word - 1 : word + 1] in pieces.pairs:
            word -= 1
        yield text[c : c + size + pieces.longest], min(size, len(text) - c), c - word


def cut_apart(text: str, size: int, pieces: Pieces) -> Iterator[str]:
    """Parts of a normalised text that no merge crosses, of `size` characters or up to the next such place."""
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text) and text[end - 1 : end + 1] in pieces.pairs:
            end += 1
        yield text[at:end]
        at = end


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of matrices; associative."""
    return np.maximum((a[:, :, None] + b[None]).max(1), _NONE)


def cut_states(matrices: list[np.ndarray]) -> list[int]:
    """The best path's state before the first chunk and after each: 0 at both ends of a document. The scores of the states
    come from the prefix products, by pairwise combination."""

    def prefixes(m: list[np.ndarray]) -> list[np.ndarray]:
        if len(m) == 1:
            return m
        pairs = prefixes([level_of(product(m[i], m[i + 1])) for i in range(0, len(m) - 1, 2)])
        return [m[0] if i == 0 else pairs[i // 2] if i % 2 else level_of(product(pairs[i // 2 - 1], m[i])) for i in range(len(m))]

    def level_of(m: np.ndarray) -> np.ndarray:
        """A matrix less its largest entry: only differences matter, and sums stay small."""
        return np.maximum(m - m.max(), _NONE)

    level = [level_of(m) for m in matrices]
    start = np.full(len(level[0]), _NONE, np.int64)
    start[0] = 0
    before = [start, *(p[0] for p in prefixes(level)[:-1])]
    states = [0]
    for c in range(len(matrices) - 1, 0, -1):
        states.append(int(np.argmax(before[c] + level[c][:, states[-1]])))
    return [0, *states[::-1]]


def _reading(path: str, run: Callable[[Pieces, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """`run` with the pieces, on parts of the batches; what was remembered goes at the end of a partition."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(path)
        try:
            yield from run(pieces, batches)
        finally:
            pieces.forget()

    return in_parts(each)


def _row(pieces: Pieces, text: str | None, ids: bytes, keep: bool) -> tuple:
    return (np.frombuffer(ids, "<i4") if keep else None, len(ids) // 4, hashlib.sha256(ids).hexdigest(), pieces.decode(ids) == (text or ""))


_KINDS = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.string(), pa.bool_()]
_NAMES = ["uid", "doc_id", "ids", "n_tokens", "ids_sha256", "round_trip"]
_ENCODED = "uid long, doc_id long, ids array<int>, n_tokens long, ids_sha256 string, round_trip boolean"


def _table(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_KINDS)]


def _whole(path: str, keep: bool, merges: bool):
    def run(pieces: Pieces, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for uid, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rows.append((uid, doc_id, *_row(pieces, text, pieces.encode(text, merges), keep)))
                if len(rows) == 256:
                    yield pa.RecordBatch.from_arrays(_table(rows), names=_NAMES)
                    rows = []
            yield pa.RecordBatch.from_arrays(_table(rows), names=_NAMES)

    return _reading(path, run)


def _cut(path: str):
    def run(pieces: Pieces, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                text = normalise(text)
                for c, (part, n, place) in enumerate(cut(text, CHUNK, pieces)):
                    yield pa.RecordBatch.from_arrays([pa.array([uid], pa.int64()), pa.array([doc_id], pa.int64()), pa.array([c], pa.int64()), pa.array([n], pa.int64()), pa.array([place], pa.int64()), pa.array([part], pa.string())], names=["uid", "doc_id", "chunk", "n", "place", "text"])

    return _reading(path, run)


def _cut_apart(path: str):
    def run(pieces: Pieces, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for c, part in enumerate(cut_apart(normalise(text), CHUNK, pieces)):
                    yield pa.RecordBatch.from_arrays([pa.array([uid], pa.int64()), pa.array([doc_id], pa.int64()), pa.array([c], pa.int64()), pa.array([part], pa.string()), pa.array([len(part)], pa.int64())], names=["uid", "doc_id", "chunk", "text", "n"])

    return _reading(path, run)


def _merged(path: str):
    def run(pieces: Pieces, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [b"".join([pieces.merged[part] for part in pieces.segments(text)]) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, "ids"])

    return _reading(path, run)


def _matrices(path: str):
    def run(pieces: Pieces, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pieces.transfer(*row).tobytes() for row in zip(*(batch.column(c).to_pylist() for c in ("text", "n", "place")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("chunk"), pa.array(found, pa.binary())], names=["uid", "chunk", "matrix"])

    return _reading(path, run)


def _states(key: tuple, rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("chunk")
    matrices = [np.frombuffer(m.as_py(), np.int64) for m in rows.column("matrix")]
    side = int(np.sqrt(len(matrices[0])))
    states = cut_states([m.reshape(side, side) for m in matrices])
    return pa.table({"uid": rows.column("uid"), "chunk": rows.column("chunk"), "start": pa.array(states[:-1], pa.int64()), "end": pa.array(states[1:], pa.int64())})


def _traced(path: str):
    def run(pieces: Pieces, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_bytes(pieces.best(*row)[0]) for row in zip(*(batch.column(c).to_pylist() for c in ("text", "n", "start", "end", "place")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), batch.column("chunk"), batch.column("text"), batch.column("n"), pa.array(found, pa.binary())], names=["uid", "doc_id", "chunk", "text", "n", "ids"])

    return _reading(path, run)


def _joined(path: str, keep: bool):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        pieces = Pieces.of(path)
        rows = rows.sort_by("chunk")
        ids = b"".join(rows.column("ids").to_pylist())
        text = "".join(t[:n] for t, n in zip(rows.column("text").to_pylist(), rows.column("n").to_pylist(), strict=True))
        return pa.Table.from_arrays(_table([(rows.column("uid")[0].as_py(), rows.column("doc_id")[0].as_py(), *_row(pieces, text.replace(SPACE, " ")[1:], ids, keep))]), names=_NAMES)

    return run


def encode(documents: DataFrame, model: str, keep_ids: bool = True, giant: int = GIANT, own_rule: bool = False) -> DataFrame:
    """uid, doc_id, ids, n_tokens, ids_sha256, round_trip for each row of `documents` (doc_id, text; nothing else is read).
    ids are those of the largest total score under the pieces of the file `model`, which all executors have; with `own_rule`
    those that the library gives for the model, which are others if it is a BPE model. Characters without a piece become bytes. ids_sha256 is over them as little-endian 32-bit numbers; round_trip says whether they
    decode to the text again (a text that holds U+2581 reads a space there). Null and empty texts have no ids. Rows with
    equal ids are encoded apart; uid numbers them in the order read. Texts of more than `giant` characters go in chunks."""
    spark, folder = documents.sparkSession, shared_dir(documents.sparkSession)
    rows = documents.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    long = F.coalesce(F.length("text") > giant, F.lit(False))
    merges = own_rule and is_bpe(model)
    whole = rows.where(~long).mapInArrow(_whole(model, keep_ids, merges), _ENCODED)
    if merges:
        parts = rows.where(long).mapInArrow(_cut_apart(model), "uid long, doc_id long, chunk long, text string, n long").repartition("uid", "chunk")
        found = parts.mapInArrow(_merged(model), "uid long, doc_id long, chunk long, text string, n long, ids binary")
        with batches_of(spark, BATCH_ROWS):
            return written(whole.unionByName(found.groupBy("uid").applyInArrow(_joined(model, keep_ids), _ENCODED)), f"{folder}/encoded")
    chunks = written(rows.where(long).mapInArrow(_cut(model), "uid long, doc_id long, chunk long, n long, place long, text string"), f"{folder}/chunks")
    matrices = chunks.mapInArrow(_matrices(model), "uid long, chunk long, matrix binary")
    states = matrices.groupBy("uid").applyInArrow(_states, "uid long, chunk long, start long, end long")
    traced = chunks.join(states, ["uid", "chunk"]).select("uid", "doc_id", "chunk", "text", "n", "place", "start", "end").mapInArrow(_traced(model), "uid long, doc_id long, chunk long, text string, n long, ids binary")
    with batches_of(spark, BATCH_ROWS):
        return written(whole.unionByName(traced.groupBy("uid").applyInArrow(_joined(model, keep_ids), _ENCODED)), f"{folder}/encoded")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """The columns of `encoded` and `text` from its column ids; null ids give null."""

    def run(pieces: Pieces, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [None if ids is None else pieces.decode(_bytes(ids)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=[*batch.schema.names, "text"])

    return encoded.mapInArrow(_reading(model, run), ", ".join(f"`{c}` {k}" for c, k in (*encoded.dtypes, ("text", "string"))))
