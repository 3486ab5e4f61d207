"""Words of many texts at once, as 64-bit numbers, and rolling hashes of word sequences.

A word is a longest run of bytes other than blank and the controls 9 to 13, which is what ``bytes.split()`` gives.
A batch's texts are hashed together, so the cost per text is small however short it is.  A batch is half a megabyte of
texts, or one longer text; per byte it takes about 10 bytes of memory, so a text of 100 MB takes one gigabyte.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

#: Fixed odd multiplier of the rolling hashes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes, or words, that are hashed at a time; longer stretches are taken in parts, with the same result.
PART = 1 << 18


def _powers_of(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


_UP, _DOWN = _powers_of(BASE, PART + 64), _powers_of(INVERSE, PART + 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n <= len(_UP):
        return _UP[:n], _DOWN[:n]
    return _powers_of(BASE, n), _powers_of(INVERSE, n)  # a word longer than a part


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _spans(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of the values from ``first`` up to ``last``, each."""
    up, down = _powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))


@dataclass
class Batch:
    """Words of several texts: their hashes, and for each text its first word and number of words."""

    hashes: np.ndarray
    first: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, data: list[bytes], fold: bool = False) -> Batch:
        """fold: A to Z count as a to z."""
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        raw = np.frombuffer(b" ".join(data) + b" ", np.uint8)
        if fold:
            raw = LOWER[raw]
        edge = np.flatnonzero(np.diff(BLANK[raw].view(np.int8), prepend=np.int8(1)))
        begin, end = edge[::2], edge[1::2]
        starts = np.cumsum(sizes + 1) - sizes - 1
        first = np.searchsorted(begin, starts)
        count = np.diff(np.append(first, len(begin)))
        hashes, i = np.empty(len(begin), np.uint64), 0
        while i < len(begin):
            a = int(begin[i])
            j = max(i + 1, int(np.searchsorted(end, a + PART, side="right")))
            hashes[i:j] = _spans(raw[a : int(end[j - 1])].astype(np.uint64) + np.uint64(1), begin[i:j] - a, end[i:j] - a)
            i = j
        return cls(hashes, first, count)

    def runs(self, k: int, salt: int = 0) -> np.ndarray:
        """Hash of the ``k`` words from each word on; of no use where fewer are left in the text."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        out = np.empty(n, np.uint64)
        for i in range(0, n, PART - k):
            h = self.hashes[i : min(n, i + PART - k) + k - 1]
            at = np.arange(len(h) - k + 1)
            out[i : i + len(at)] = _spans(mix(h ^ np.uint64(salt)) if salt else h, at, at + k)
        return out


def window_min(x: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` neighbours."""
    n = len(x) - size + 1
    if n <= 0:
        return x[:0]
    width = 1
    while width * 2 <= size:
        x = np.minimum(x[: len(x) - width], x[width:])
        width *= 2
    return np.minimum(x[:n], x[size - width : size - width + n])


def window_max(x: np.ndarray, size: int) -> np.ndarray:
    return ~window_min(~x, size)


def chunks(data: Iterable[bytes], most: int = 1 << 19) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in lists of about ``most`` bytes, each with the number of its first text."""
    out: list[bytes] = []
    at = size = 0
    for i, x in enumerate(data):
        out.append(x)
        size += len(x)
        if size >= most:
            yield at, out
            out, at, size = [], i + 1, 0
    if out:
        yield at, out
