"""Words and word shingles of texts as 64-bit hashes, vectorised over bytes.

A word's hash is a keyed polynomial of its bytes modulo 2^64, taken from
prefix sums, then mixed; a shingle's hash folds its words' hashes.  The cost
is a few numpy passes over the text, without a Python object per word.
"""

from __future__ import annotations

import numpy as np

_M = np.uint64(0x9E3779B97F4A7C15)
_A = np.uint64(0xD6E8FEB86659FD93)
#: Polynomial base (odd, so that it has an inverse modulo 2^64) and byte keys.
_BASE = 0xA0761D6478BD642F
_BYTE = np.random.default_rng(20260302).integers(0, 2 ** 64, 256, dtype=np.uint64)

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(32))) * _A
    h = (h ^ (h >> np.uint64(32))) * _A
    return h ^ (h >> np.uint64(32))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def word_spans(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of bytes that are not ASCII white space."""
    solid = np.empty(len(b) + 2, bool)
    solid[0] = solid[-1] = False
    np.logical_not(_BLANK[b], out=solid[1:-1])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    return edge[::2], edge[1::2]


def span_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes; equal spans have equal hashes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * up[:len(b)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _M)


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z lower-cased."""
    b = _LOWER[np.frombuffer(text.encode(), np.uint8)]
    return span_hashes(b, *word_spans(b))


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words, in order; with fewer words, of the
    whole sequence; none without words."""
    if not len(words):
        return words
    k = min(n, len(words))
    h = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        h = (h * _M) ^ words[j:len(words) - k + 1 + j]
        h = (h ^ (h >> np.uint64(29))) * _A
    return mix(h)
