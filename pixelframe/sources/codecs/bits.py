"""Numbers of any width end to end in bytes."""

from __future__ import annotations

import numpy as np


def _words(values: np.ndarray, lengths: np.ndarray, high_first: bool) -> tuple[np.ndarray, int]:
    """64-bit words of the numbers, and how many bits there are; a number lies in one word or on the edge of two."""
    values, lengths = np.asarray(values).astype(np.uint64), np.asarray(lengths, np.int64)
    end = np.cumsum(lengths)
    total = int(end[-1]) if len(end) else 0
    out = np.zeros(total // 64 + 2, np.uint64)
    word, place = (end - lengths) >> 6, (end - lengths) & 63
    over = np.flatnonzero(place + lengths > 64)
    if high_first:
        left = 64 - place - lengths
        np.bitwise_or.at(out, word, np.where(left >= 0, values << np.maximum(left, 0).astype(np.uint64), values >> np.maximum(-left, 0).astype(np.uint64)))
        np.bitwise_or.at(out, word[over] + 1, values[over] << (64 + left[over]).astype(np.uint64))
    else:
        np.bitwise_or.at(out, word, values << place.astype(np.uint64))
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (64 - place[over]).astype(np.uint64))
    return out, total


def low_first(values: np.ndarray, lengths: np.ndarray) -> bytes:
    """From the lowest bit of each byte on; zeros fill the last one."""
    words, total = _words(values, lengths, False)
    return words.astype("<u8").tobytes()[: -(-total // 8)]


def high_first(values: np.ndarray, lengths: np.ndarray, fill: int = 0) -> bytes:
    """From the highest bit of each byte on; `fill` is what the last one is filled with."""
    words, total = _words(values, lengths, True)
    data = bytearray(words.astype(">u8").tobytes()[: -(-total // 8)])
    if fill and total % 8:
        data[-1] |= (1 << (8 - total % 8)) - 1
    return bytes(data)
