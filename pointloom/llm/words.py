"""Hashes of all words of a text in a few numpy passes."""

from __future__ import annotations

import numpy as np

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_CODES = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, 256, np.uint64)
_CHUNK = 1 << 20
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(33))


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 2**64)
        steps = np.full(max(n, 1 << 14), base, np.uint64)
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind]


def _chunk_hashes(b: np.ndarray) -> np.ndarray:
    blank = _BLANK[b]
    edge = np.diff(np.concatenate(([True], blank, [True])).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_CODES[b] * _power("up", len(b))[: len(b)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power("down", len(b))[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash for each word, in order; words are runs of bytes that aren't ASCII blanks."""
    b = np.frombuffer(text, np.uint8)
    if len(b) <= _CHUNK:
        return _chunk_hashes(b)
    out, at = [], 0
    while at < len(b):  # chunks end at blanks, so that memory stays in proportion to a chunk
        end = min(len(b), at + _CHUNK)
        while end < len(b) and not _BLANK[b[end]]:
            step = np.flatnonzero(_BLANK[b[end : end + _CHUNK]])
            end = end + int(step[0]) if len(step) else min(len(b), end + _CHUNK)
        out.append(_chunk_hashes(b[at:end]))
        at = end
    return np.concatenate(out)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the text's k-word shingles, A-Z lower-cased.

    A text of fewer words is one shingle, the whole sequence; one without words has none.
    """
    h = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(h):
        return h
    k = min(k, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + h[j : len(h) - k + 1 + j])
    return np.unique(out)
