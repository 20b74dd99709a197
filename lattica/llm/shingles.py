"""Hashed word shingles of texts, computed over many bytes at once."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_STRIDE = 1 << 16


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(0, n - 1), base, np.uint64))])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every bit depends on every other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of all texts, in order, and the n + 1 offsets of the texts' words.

    A word is a run of bytes other than the six ASCII white-space characters; A-Z count as a-z.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets[:-1]] = True
    first = ~space
    first[1:] &= space[:-1] | edge[1:-1]
    last = ~space
    last[:-1] &= space[1:] | edge[1:-1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    low = np.where((data >= 65) & (data <= 90), data + 32, data)
    terms = BYTE[low]
    # sums of byte * base**place, by stretches, so that the powers are few
    powers, back = _powers(BASE, _STRIDE), _powers(_INVERSE, _STRIDE)
    where = np.arange(len(data))
    terms *= powers[where & (_STRIDE - 1)]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
    value = (sums[end] - sums[begin]) * back[begin & (_STRIDE - 1)]
    for k in np.flatnonzero((begin >> 16) != ((end - 1) >> 16)):  # words over the end of a stretch
        part = BYTE[low[begin[k] : end[k]]]
        value[k] = np.sum(part * _powers(BASE, len(part)))
    return mix(value ^ (end - begin).astype(np.uint64)), np.searchsorted(begin, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of `size` words of each text, as int64, and the texts' offsets; shorter texts give all their words as one."""
    word, cut = words(data, offsets)
    counts = np.diff(cut)
    out = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    ends = np.cumsum(out)
    start = np.repeat(cut[:-1] - (ends - out), out) + np.arange(ends[-1] if len(ends) else 0)
    value = np.zeros(len(start), np.uint64)
    longest = np.repeat(np.minimum(counts, size), out)
    for k in range(size):
        have = k < longest
        value[have] = mix(value[have] * np.uint64(0xA24BAED4963EE407) + word[start[have] + k])
    return mix(value ^ longest.astype(np.uint64)).view(np.int64), np.concatenate([[0], ends]).astype(np.int64)
