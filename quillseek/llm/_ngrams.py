"""Hashed word n-grams of many texts at once.

The texts of a batch are one byte buffer.  The polynomial hash of a word is a difference of two prefix sums, made
comparable by the inverse power of its place, so that all words of the buffer are hashed in a few array operations.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x100000001B3
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1
_LOWER = np.arange(256, dtype=np.uint64) + 1
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that aren't ASCII letters or digits.
NOT_ALPHANUMERIC = np.array([not (chr(b).isalnum() and b < 128) for b in range(256)])

_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.ones(size, np.uint64)
        done = 1
        while done < size:  # doubling: the next `done` powers are the first ones times base^done
            have[done : 2 * done] = have[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words(texts: list[str], outside: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the A-Z-lower-cased words of all texts in order, and the number of words of each text.  outside: which bytes
    are between words; a space is one of them."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    buffer = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    edges = np.flatnonzero(np.diff(outside[buffer].view(np.int8)))
    starts, stops = edges[0::2] + 1, edges[1::2] + 1
    n = len(buffer)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LOWER[buffer] * _powers_of(_BASE, n), dtype=np.uint64)])
    hashes = mix((sums[stops] - sums[starts]) * _powers_of(_INVERSE, n)[starts])
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1) + 1
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts, ends)]))
    return hashes, counts


def pairs(texts: list[str], outside: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all pairs of adjacent words, and the text that each is in."""
    one, counts = words(texts, outside)
    text = np.repeat(np.arange(len(texts)), counts)
    inner = np.flatnonzero(text[1:] == text[:-1])
    with np.errstate(over="ignore"):
        return mix(one[inner] * np.uint64(0x9E3779B97F4A7C15) + one[inner + 1]), text[inner]


def features(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (of 2^bits) of all words and word pairs, text by text: words first, then pairs; the number of features of each text."""
    one, counts = words(texts)
    if not len(one):
        return np.zeros(0, np.int64), counts
    text = np.repeat(np.arange(len(texts)), counts)
    inner = np.flatnonzero(text[1:] == text[:-1])
    with np.errstate(over="ignore"):
        two = mix(one[inner] * np.uint64(0x9E3779B97F4A7C15) + one[inner + 1])
    both = np.concatenate([one, two]) >> np.uint64(64 - bits)
    order = np.argsort(np.concatenate([text, text[inner]]), kind="stable")
    return both[order].astype(np.int64), counts + np.maximum(counts - 1, 0)
