"""Words and word shingles of many texts at once, as numpy arrays over their bytes.

A word is a run of letters, digits and bytes beyond ASCII, with A-Z lower-cased. Hashes are
polynomials over the bytes modulo 2^64, mixed afterwards; they depend on the words alone.
"""

from __future__ import annotations

import numpy as np

SHINGLE = 5

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)

_CODE = np.zeros(256, np.uint64)
for _b in range(256):
    _c = chr(_b)
    if _b >= 128 or _c.isalnum():
        _CODE[_b] = np.uint64((ord(_c.lower()) if _b < 128 else _b) * 0xD6E8FEB86659FD93 % (1 << 64))
_IS_WORD = _CODE != 0

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    """The first n powers of the base or of its inverse."""
    own = _powers[kind]
    if len(own) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            own = np.full(size, np.uint64(_BASE if kind == "up" else _INVERSE))
            own[0] = 1
            own = np.multiply.accumulate(own)
        if size <= 1 << 23:
            _powers[kind] = own
    return own[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits spread over the whole number, so that any part of it, or its order, can be used."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


#: A code for every byte, for hashes of raw text.
RAW = mixed(np.arange(1, 257, dtype=np.uint64))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each range of a row of numbers, by differences of running sums."""
    n = len(values)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _power("up", n), out=sums[1:])
        h = (sums[ends] - sums[starts]) * _power("down", n + 1)[starts]
        return mixed(h + (ends - starts).astype(np.uint64) * _ODD)


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the index of each text's first word (and their number)."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = _IS_WORD[data]
    opens, closes = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    opens[inner] = inside[inner + 1]
    closes[inner - 1] = inside[inner]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the index of each text's first word (and their number)."""
    starts, ends, first = word_places(data, offsets)
    return range_hashes(_CODE[data], starts, ends), first


def shingles(hashes: np.ndarray, first: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of k words within a text; a text of fewer words is one shingle.

    Returns the hashes and the index of each text's first shingle (and their number).
    """
    counts = np.diff(first)
    each = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    begin = np.concatenate([[0], np.cumsum(each)])
    text = np.repeat(np.arange(len(counts)), each)
    at = first[:-1][text] + np.arange(len(text)) - begin[:-1][text]
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    left = counts[text]
    out = np.zeros(len(text), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            own = padded[at + j]
            own[left <= j] = 0
            out = out * np.uint64(_BASE) + own
    return mixed(out), begin
