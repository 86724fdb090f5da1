"""Vectorised work on Arrow string columns: words, and hashes of words and of runs of words.

All hashes are polynomials over 64-bit integers with an odd base, so the hash of any run follows
from two prefix sums. They depend on the content alone: equal runs hash alike in every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that one step works on; bounds the arrays, not the texts (a longer text is one step).
STEP = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the splitmix finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    up = np.full(n, _BASE, dtype=np.uint64)
    down = np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(max(STEP + 1, 1 << max(n - 1, 1).bit_length()))
    return up[:n], down[:n]


class Runs:
    """Hashes of the runs of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[:-1], dtype=np.uint64, out=self.sums[1:])

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def of(self, length: int) -> np.ndarray:
        """Hash of the run of this length from every start that has one."""
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.down[:n] if n > 0 else np.zeros(0, dtype=np.uint64)


class Words:
    """Words of some texts: ``hashes`` of all in order, ``at`` the first word of each text (and the
    total), ``first`` the index of the first text among the column's."""

    def __init__(self, first: int, data: np.ndarray, bounds: np.ndarray):
        self.first, self.n = first, len(bounds) - 1
        space = _SPACE[data]
        before, after = np.ones(len(data), dtype=bool), np.ones(len(data), dtype=bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        inner = bounds[(bounds > 0) & (bounds < len(data))]
        before[inner] = True
        after[inner - 1] = True
        self.start = np.flatnonzero(~space & before)
        self.end = np.flatnonzero(~space & after) + 1
        self.at = np.searchsorted(self.start, bounds)
        self.hashes = mix(Runs(_BYTES[data]).between(self.start, self.end) + (self.end - self.start).astype(np.uint64))

    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def left(self) -> np.ndarray:
        """How many words each word's text has from it on."""
        return np.repeat(self.at[1:], self.counts()) - np.arange(len(self.hashes))

    def owner(self) -> np.ndarray:
        """Index in the column of each word's text."""
        return np.repeat(np.arange(self.first, self.first + self.n), self.counts())


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; nulls are empty texts."""
    texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bounds = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, dtype=np.int64)
    return bounds, np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)


def words(texts: pa.Array) -> Iterator[Words]:
    """The column's words, in steps of about ``STEP`` bytes. A word is a longest run without ASCII white space."""
    bounds, data = utf8(texts)
    lo = 0
    while lo < len(bounds) - 1:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + STEP, side="right")) - 1)
        yield Words(lo, data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
        lo = hi


def long(h: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's signed ones."""
    return h.view(np.int64)
