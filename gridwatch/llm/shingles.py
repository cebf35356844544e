"""Words and word shingles of many texts at once, as 64-bit hashes.

A word is a run of bytes other than space and \\t-\\r, after lower-casing A-Z. Words get a polynomial
hash over random byte values, read off one running sum for a whole slice of texts. A shingle is five
words in a row; a text of one to four words has itself as its one shingle. Sets compare by these
64-bit hashes: two different shingles are taken for one with a chance of about 2**-60 a pair.
"""

from __future__ import annotations

import numpy as np

from .common import LOWER_BYTES, mix, random_words

K = 5
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = random_words(256, 7)
_BASE = 0x9E3779B97F4A7C15 | 5
_STEP = random_words(K, 11) | np.uint64(1)
_LENGTH = random_words(K + 1, 13)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE and its inverse modulo 2**64, to the powers 0 to n - 1 at least."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            a = np.full(size, np.uint64(base), np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"][:n], _powers["down"][:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of each text, and how many words the texts before each text have (one more entry than texts).

    ``between``: for each byte value, whether it separates words."""
    data = LOWER_BYTES[data]
    word = ~between[data]
    if not word.any():
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power(len(data) + 1)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=run[1:])
    h = mix((run[b] - run[a]) * down[a] + (b - a).astype(np.uint64))
    return h, np.searchsorted(a, starts)


def shingle_hashes(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of all texts in order, repeats included, and where each text's begin (one more entry than texts)."""
    n = np.diff(at)
    count = np.where(n >= K, n - K + 1, np.minimum(n, 1))
    out_at = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(out_at[-1], np.uint64)
    if len(words) >= K:
        size = len(words) - K + 1
        h = np.zeros(size, np.uint64)
        for i in range(K):
            h += words[i : i + size] * _STEP[i]
        text = np.repeat(np.arange(len(n)), n)
        whole = text[:size] == text[K - 1 :]
        out[np.repeat(n >= K, count)] = mix(h[whole] + _LENGTH[K])
    for m in range(1, K):
        few = np.flatnonzero(n == m)
        h = np.full(len(few), _LENGTH[m])
        for i in range(m):
            h += words[at[few] + i] * _STEP[i]
        out[out_at[few]] = mix(h)
    return out, out_at


def shingle_sets(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles in ascending order, and where they begin (one more entry than texts)."""
    h, at = shingle_hashes(*word_hashes(data, starts))
    parts = [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    return (np.concatenate(parts) if parts else h), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
