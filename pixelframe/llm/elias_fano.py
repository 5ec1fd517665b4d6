"""Elias-Fano sequences and an n-gram trie over them, in files that are memory-mapped.

A level holds, for all its nodes in order, the child identifiers relative to their context, made monotone by adding the
last value of the range before, and pointers to each node's range of children. From the third level on a child is named
by its position among the children of its context's suffix, not by its word number. Probabilities are codes of a
uniform quantiser.
"""

from __future__ import annotations

import tempfile

import numpy as np

_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: Places or values that are looked up at once, so that what is worked out for them stays in a core's cache.
AT_ONCE = 1 << 14


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """`bits` low bits of each value, end to end in 64-bit words; one spare word at the end."""
    out = np.zeros(len(values) * bits // 64 + 2, np.uint64)
    for i in range(0, len(values) if bits else 0, AT_ONCE):  # begins with a word of its own
        part, to = values[i : i + AT_ONCE], out[i * bits // 64 :]
        at = np.arange(len(part), dtype=np.uint64) * np.uint64(bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        to[word[first]] = np.bitwise_or.reduceat(part << shift, first)
        over = shift + np.uint64(bits) > np.uint64(64)
        to[word[over] + 1] |= part[over] >> (np.uint64(64) - shift[over])  # one value at most reaches into a word
    return out


class EliasFano:
    """A non-decreasing sequence of integers below 2**62, in about 2 + log2(universe / n) bits each."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.bits, self.low, self.high, self.ones, self.zeros = n, bits, low, high, ones, zeros

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = _pack(values & np.uint64((1 << bits) - 1), bits)
        upper = (values >> np.uint64(bits)).view(np.int64)
        length = n + (int(upper[-1]) if n else 0) + 2
        flags = np.zeros(-(-length // 64) * 64, np.uint8)
        upper += np.arange(n)
        flags[upper] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        count = np.bitwise_count(high).astype(np.int64)
        ones = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        return cls(n, bits, low, high, ones, np.arange(len(high) + 1, dtype=np.int64) * 64 - ones)

    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high, self.ones, self.zeros]

    def _select(self, rank: np.ndarray, flip: bool) -> np.ndarray:
        """Place of the bit of that rank (from 0): ones, or with `flip` zeros."""
        directory = self.zeros if flip else self.ones
        word = np.searchsorted(directory, rank, "right") - 1
        left = rank - directory[word]
        bits = self.high[word]
        if flip:
            bits = ~bits
        place = np.zeros(len(rank), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            below = bits & np.uint64((1 << half) - 1)
            count = np.bitwise_count(below).astype(np.int64)
            up = left >= count
            left = np.where(up, left - count, left)
            bits = np.where(up, bits >> np.uint64(half), below)
            place += np.where(up, half, 0)
        return word * 64 + place

    def _lows(self, at: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(at), np.int64)
        bit = at.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        got = self.low[word] >> shift
        over = (shift + np.uint64(self.bits)) > np.uint64(64)
        if over.any():
            got[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return (got & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def access(self, at: np.ndarray) -> np.ndarray:
        at = np.asarray(at, np.int64)
        if not len(at):
            return np.zeros(0, np.int64)
        if len(at) > AT_ONCE:
            return np.concatenate([self.access(at[i : i + AT_ONCE]) for i in range(0, len(at), AT_ONCE)])
        return ((self._select(at, False) - at) << self.bits) | self._lows(at)

    def find(self, value: np.ndarray) -> np.ndarray:
        """Successor search: the first place whose value is at least that; n where there is none."""
        value = np.asarray(value, np.int64)
        if len(value) > AT_ONCE:
            return np.concatenate([self.find(value[i : i + AT_ONCE]) for i in range(0, len(value), AT_ONCE)])
        out = np.full(len(value), self.n, np.int64)
        if not self.n or not len(value):
            return out
        upper, low = value >> self.bits, value & ((1 << self.bits) - 1)
        inside = np.flatnonzero(upper < self.zeros[-1])
        upper, low = upper[inside], low[inside]
        begin = np.where(upper > 0, self._select(np.maximum(upper - 1, 0), True) - np.maximum(upper - 1, 0), 0)
        end = np.minimum(self._select(upper, True) - upper, self.n)
        at, left = begin.copy(), np.arange(len(begin))
        while len(left):  # a bucket holds about one value; a long one is halved
            wide = end[left] - at[left]
            left = left[wide > 0]
            if not len(left):
                break
            mid = (at[left] + end[left]) >> 1
            less = self._lows(mid) < low[left]
            at[left] = np.where(less, mid + 1, at[left])
            end[left] = np.where(less, end[left], mid)
        out[inside] = at
        return out


def mapped(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """The arrays, from a memory-mapped file that no longer has a name: it goes when the last view goes, and pages that
    aren't in use need no memory."""
    import mmap

    with tempfile.TemporaryFile() as f:
        places = []
        for a in arrays:
            f.seek(-(-f.tell() // 8) * 8)
            places.append((f.tell(), a.dtype, a.shape))
            a.tofile(f) if a.size else None
        f.flush()
        size = f.seek(0, 2)
        if not size:
            return arrays
        view = mmap.mmap(f.fileno(), size, access=mmap.ACCESS_READ)
    return [np.frombuffer(view, d, int(np.prod(s)), p).reshape(s) if np.prod(s) else np.zeros(s, d) for p, d, s in places]


class Quantiser:
    """Codes of `bits` bits for values between the least and the largest of a level."""

    def __init__(self, values: np.ndarray, bits: int):
        self.least = float(values.min()) if len(values) else 0.0
        self.step = (float(values.max()) - self.least) / ((1 << bits) - 1) if len(values) else 0.0
        self.kind = np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.uint32

    def code(self, values: np.ndarray) -> np.ndarray:
        if not self.step:
            return np.zeros(len(values), self.kind)
        return np.rint((values - self.least) / self.step).astype(self.kind)

    def value(self, codes: np.ndarray) -> np.ndarray:
        return self.least + codes.astype(np.float64) * self.step


class NgramTrie:
    """Levels of n-grams with quantised values. Level 1 is the words 0..width-1; level k holds the k-grams that exist,
    each under its first k-1 words. Every suffix of an n-gram from the third level on must itself be an n-gram."""

    def __init__(self, width: int, bits: int = 16):
        self.width, self.bits = width, bits
        self.levels: list[tuple[EliasFano, EliasFano]] = []
        self.codes: list[list[np.ndarray]] = []
        self.quantisers: list[list[Quantiser]] = []

    def add_level(self, grams: np.ndarray, values: np.ndarray, *more: np.ndarray, places: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """grams: rows of word numbers, without repeats, in lexicographic order; values and more: numbers for each.
        places: where the builder knows them, each gram's prefix in the level above and its last word as named there."""
        k = grams.shape[1]
        parents, name = places or (grams[:, 0] if k == 2 else self.nodes(grams[:, :-1]), self._relative(grams))
        if len(parents) and parents.min() < 0:
            raise ValueError("an n-gram's prefix is missing from the level above")
        above = self.width if k == 2 else len(self.codes[-1][0])
        counts = np.bincount(parents, minlength=above) if len(parents) else np.zeros(above, np.int64)
        pointers = np.concatenate([[0], np.cumsum(counts)])
        last = np.zeros(above, np.int64)
        ends = pointers[1:][counts > 0] - 1
        last[counts > 0] = name[ends] + 1
        base = np.concatenate([[0], np.cumsum(last)])[:-1]
        quantisers = [Quantiser(v, self.bits) for v in (values, *more)]
        parts = [EliasFano.build(pointers), EliasFano.build(base[parents] + name + 1)]
        views = iter(mapped([a for p in parts for a in p.arrays()] + [q.code(v) for q, v in zip(quantisers, (values, *more), strict=True)]))
        self.levels.append(tuple(EliasFano(p.n, p.bits, *(next(views) for _ in range(4))) for p in parts))
        self.codes.append(list(views))
        self.quantisers.append(quantisers)

    def _relative(self, grams: np.ndarray) -> np.ndarray:
        """Each gram's last word, as named in its level; -1 where the suffix isn't in the trie."""
        if grams.shape[1] == 2:
            return grams[:, 1].astype(np.int64)
        suffix = self.nodes(grams[:, 1:])
        context = grams[:, 1] if grams.shape[1] == 3 else self.nodes(grams[:, 1:-1])
        start = self.levels[grams.shape[1] - 3][0].access(np.maximum(context, 0))
        return np.where(suffix >= 0, suffix - start, -1)

    def nodes(self, grams: np.ndarray) -> np.ndarray:
        """The place of each gram in its level, or -1."""
        k = grams.shape[1]
        if k == 1:
            return grams[:, 0].astype(np.int64)
        parents = self.nodes(grams[:, :-1])
        name = self._relative(grams)
        return self.children(k, parents, name)

    def children(self, k: int, parents: np.ndarray, name: np.ndarray) -> np.ndarray:
        """The places in level k of the children with these names of nodes of the level above, or -1."""
        pointers, children = self.levels[k - 2]
        if len(parents) > 4 * AT_ONCE:
            return np.concatenate([self.children(k, parents[i : i + 4 * AT_ONCE], name[i : i + 4 * AT_ONCE]) for i in range(0, len(parents), 4 * AT_ONCE)])
        out = np.full(len(parents), -1, np.int64)
        known = np.flatnonzero((parents >= 0) & (name >= 0))
        if not len(known) or not children.n:
            return out
        mine = parents[known]
        if (mine[1:] >= mine[:-1]).all():
            new = np.diff(mine, prepend=-1) > 0
            each, back = mine[new], np.cumsum(new) - 1
        else:
            each, back = np.unique(mine, return_inverse=True)
        begin, end = pointers.access(each), pointers.access(each + 1)
        base = np.where(begin > 0, children.access(np.maximum(begin - 1, 0)), 0)
        want = base[back] + name[known] + 1
        at = children.find(want)
        fits = at < end[back]
        fits[fits] = children.access(at[fits]) == want[fits]
        out[known[fits]] = at[fits]
        return out

    def values(self, k: int, nodes: np.ndarray, which: int = 0) -> np.ndarray:
        """The values of nodes of level k; which: of those that the level was given."""
        return self.quantisers[k - 2][which].value(self.codes[k - 2][which][nodes])
