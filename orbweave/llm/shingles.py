"""Hashes of words and of word n-grams, over whole blocks of texts at once.

A word is a maximal run of bytes other than space and \\x09-\\x0D, with A-Z lower-cased. Its hash is a polynomial over
random 64-bit values of its bytes, finished by a mixer; an n-gram's hash is a polynomial over its words' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once (a longer text is a block of its own).
BLOCK_BYTES = 1 << 17

U = np.uint64
_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = _VALUE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = 0xD6E8FEB86659FD93


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n - 1, base, np.uint64))]) if n > 1 else np.ones(n, np.uint64)


_power = _powers(_BASE, 1 << 16)
_unpower = _powers(_INVERSE, 1 << 16)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts ``data[bounds[i]:bounds[i + 1]]``, and where each text's words begin."""
    global _power, _unpower
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    if n > len(_power):
        _power, _unpower = _powers(_BASE, 2 * n), _powers(_INVERSE, 2 * n)
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = bounds[:-1][bounds[:-1] < n]
    begins[edge] = inside[edge]
    ends = np.zeros(n + 1, bool)
    ends[1:] = inside
    ends[1:n] &= ~inside[1:]
    cut = bounds[1:][bounds[1:] > 0]
    ends[cut] = inside[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * _power[:n])])
    return mix((total[end] - total[start]) * _unpower[start]), np.searchsorted(start, bounds)


def grams(word: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of one text's words; of the whole sequence if it has fewer than n."""
    m = len(word)
    if not m:
        return word
    k = min(n, m)
    out = word[: m - k + 1].copy()
    step = _STEP
    for i in range(1, k):
        out += word[i : m - k + 1 + i] * U(step)
        step = step * _STEP % (1 << 64)
    if m < n:
        out += U(m * 0x632BE59BD9B4E019 % (1 << 64))
    out = np.sort(mix(out))
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, word hashes, word bounds) for blocks of consecutive texts; nulls are empty."""
    texts = pa.array(texts, pa.string()) if not isinstance(texts, pa.Array) else texts
    texts = texts.fill_null("").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
        w, b = words(raw[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])
        yield at, w, b
        at = to


def gram_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text in order its sorted distinct n-gram hashes."""
    for _, w, b in blocks(texts):
        for i in range(len(b) - 1):
            yield grams(w[b[i] : b[i + 1]], n)
