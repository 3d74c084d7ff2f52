"""Words and word shingles of whole texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_PIECE = (1 << 18) - 2
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER = _LOWER.astype(np.uint64) + U(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    x *= U(0xA0761D6478BD642F)
    x ^= x >> U(32)
    return x


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of each at least."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(18, int(n - 1).bit_length())
        _powers[:] = [np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(size, b, dtype=np.uint64))), dtype=np.uint64) for b in (U(_BASE), U(pow(_BASE, -1, 1 << 64)))]
    return _powers[0], _powers[1]


def _piece(data: np.ndarray) -> np.ndarray:
    """Hashes of the words in data."""
    up, down = _tables(len(data) + 1)
    edge = np.diff(np.concatenate(([0], (~_SPACE[data]).view(np.int8), [0])))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_LOWER[data] * up[: len(data)], out=sums[1:])
    return mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """One number a word (a run of bytes other than ASCII white space, A-Z lower-cased), in text order."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if len(data) <= _PIECE:
        return _piece(data)
    parts, start = [], 0
    while start < len(data):
        end = min(start + _PIECE, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        parts.append(_piece(data[start:end]))
        start = end
    return np.concatenate(parts)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of the whole sequence if there are fewer words; empty without words."""
    words = word_hashes(text) if text else np.zeros(0, dtype=np.uint64)
    if not len(words):
        return words
    if len(words) < k:
        window = np.zeros(1, dtype=np.uint64)
        for i in range(len(words)):
            window = window * U(_BASE) + words[i : i + 1] * U(2 * i + 3)
        return mix(window + U(len(words)))
    out = np.zeros(len(words) - k + 1, dtype=np.uint64)
    for i in range(k):
        out = out * U(_BASE) + words[i : len(words) - k + 1 + i] * U(2 * i + 3)
    out = np.sort(mix(out + U(k)))
    return out[np.concatenate(([True], out[1:] != out[:-1]))]
