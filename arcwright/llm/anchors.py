"""Content-defined anchors: positions that any two occurrences of a string of ``size`` bytes have in common.

A string of ``size`` bytes holds size - k + 1 substrings of k bytes; those with the least hash are its anchors.  Whether
a position is an anchor of some string follows from the bytes of that string alone, so equal strings of ``size`` bytes
have equal anchors in the same places.  About one position in (size - k + 2) / 2 is one.
"""

from __future__ import annotations

import numpy as np
from . import common as C



class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.base = 0xD1342543DE82EF95
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)
        self.byte = C.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    @staticmethod
    def _grow(have: np.ndarray, base: int, n: int) -> np.ndarray:
        while len(have) < n:
            step = np.uint64(pow(base, len(have), 1 << 64))
            with np.errstate(over="ignore"):
                have = np.concatenate([have, have * step])
        return have

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        self.up, self.down = self._grow(self.up, self.base, n), self._grow(self.down, self.inverse, n)
        return self.up, self.down


_POWERS = _Powers()


def length(size: int) -> int:
    """Bytes of an anchor for strings of ``size``: long enough to be rare, short enough to lie far apart."""
    return max(1, size // 2 - 1)


def _sliding(x: np.ndarray, w: int, best) -> np.ndarray:
    """best over each w consecutive values, len(x) - w + 1 of them, by doubling."""
    n, have = x, 1
    while have * 2 <= w:
        n = best(n[:-have], n[have:])
        have *= 2
    rest = w - have
    return best(n[: len(n) - rest], n[rest:]) if rest else n


def anchors(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of anchors and hashes of their bytes; no string crosses a document's edge."""
    k = length(size)
    w, n = size - k + 1, len(data) - k + 1
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n < w:
        return none
    at = np.arange(n)
    up, down = _POWERS.of(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_POWERS.byte[data] * up[: len(data)], out=sums[1:])
        h = C.mix((sums[k:] - sums[:-k]) * down[:n])
    least = _sliding(h, w, np.minimum)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        least[max(a, b - size + 1) : b] = 0  # strings that would cross the edge
    wide = np.zeros(n + w - 1, np.uint64)
    wide[w - 1 : w - 1 + len(least)] = least
    most = _sliding(wide, w, np.maximum)[:n]
    chosen = at[(h == most) & (most > 0)]
    return chosen, h[chosen]


def strings(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Anchors in the order of the text: hash, document, and the first and last start of the strings that they are the
    anchor of.  Each string has one anchor; only where two of equal bytes are near may it be counted to both."""
    pos, h = anchors(data, offsets, size)
    doc = np.searchsorted(offsets, pos, "right") - 1
    low, high = offsets[doc], offsets[doc + 1] - size
    if len(pos) > 1:
        beside = doc[1:] == doc[:-1]
        # the lesser of two neighbours is the anchor of all strings that hold it, the left one if they are equal
        edge = np.where(h[1:] < h[:-1], pos[1:] - (size - length(size)), pos[:-1] + 1)
        low[1:] = np.where(beside, np.maximum(low[1:], edge), low[1:])
        high[:-1] = np.where(beside, np.minimum(high[:-1], edge - 1), high[:-1])
    some = high >= low
    return h[some], doc[some], low[some], high[some]
