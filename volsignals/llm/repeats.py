"""Anchors and windows of repeated byte strings, as numpy kernels over many texts at once."""

from __future__ import annotations

import numpy as np

from volsignals.llm import shingles as sh

#: Length of a string that counts as repeated, and of the prefix by which suffixes are ordered.
LENGTH, PREFIX = 400, 200
#: Prefixes in a string.
SPAN = LENGTH - PREFIX + 1


def _sliding(x: np.ndarray, w: int, better: np.ufunc, worst: int) -> np.ndarray:
    """Best of each w values in a row, by running bests of blocks of w from both ends."""
    n = len(x)
    rows = -(-(n + w) // w)
    padded = np.full(rows * w, worst, x.dtype)
    padded[:n] = x
    grid = padded.reshape(rows, w)
    ahead = better.accumulate(grid, axis=1).ravel()
    behind = better.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return better(behind[:n], ahead[w - 1 : w - 1 + n])


class Hashed:
    """Running sums of a slice of texts, from which any string's hash follows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(sh.RAW[data] * sh._power("up", len(data)), out=self.sums[1:])
        self.down = sh._power("down", len(data) + 1)

    def strings(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return sh.mixed((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def anchors(self) -> np.ndarray:
        """Places whose prefix has the smallest hash of any string of ``LENGTH`` that holds it.

        Equal strings have their anchors at equal places.
        """
        n = len(self.data)
        if n < LENGTH:
            return np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            h = (self.sums[PREFIX:] - self.sums[:-PREFIX]) * self.down[: n + 1 - PREFIX]
        h = sh.mixed(h) | np.uint64(1)
        least = _sliding(h, SPAN, np.minimum, 0xFFFFFFFFFFFFFFFF)
        # strings that would leave their text have no say
        ends = np.repeat(self.offsets[1:], np.diff(self.offsets))[: len(h)]
        least[np.arange(len(h)) + LENGTH > ends] = 0
        # the strings that hold place p begin at p - SPAN + 1 .. p
        most = _sliding(np.concatenate([np.zeros(SPAN - 1, np.uint64), least]), SPAN, np.maximum, 0)[: len(h)]
        return np.flatnonzero(most == h)
