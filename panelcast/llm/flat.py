"""Texts of a batch as one byte array, their words, and rolling hashes over both.

All hashes are 64 bits wide, come out alike in every process, and depend on
content only. ``PREFIX`` sums of byte codes times powers of an odd number give the
hash of any byte range by one subtraction and one multiplication.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)
_STEP = U(0xD6E8FEB86659FD93)
_INVERSE = U(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = np.asarray(x, dtype=U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def draw(keys: np.ndarray, number: int) -> np.ndarray:
    """The ``number``-th pseudo-random 64-bit value that belongs to each key."""
    return mix(keys + U((int(_ODD) * (number + 1)) % (1 << 64)))


#: One code per byte value, never zero.
CODES = mix(np.arange(1, 257, dtype=U) * _ODD) | U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers = np.ones(1, dtype=U)
_inverses = np.ones(1, dtype=U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the step and of its inverse."""
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << int(n - 1).bit_length()
        _powers = np.concatenate([[U(1)], np.full(size - 1, _STEP, dtype=U)]).cumprod(dtype=U)
        _inverses = np.concatenate([[U(1)], np.full(size - 1, _INVERSE, dtype=U)]).cumprod(dtype=U)
    return _powers[:n], _inverses[:n]


class Flat:
    """``data``: all bytes; ``bounds``: where each text starts, and the end of the last."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        self.bounds = bounds
        self._prefix: np.ndarray | None = None

    @classmethod
    def of(cls, texts: pa.Array, lower: bool = False) -> Flat:
        """Null texts count as empty."""
        texts = pa.compute.fill_null(texts.cast(pa.large_binary()), b"")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
        return cls(whole[bounds[0] : bounds[-1]], bounds - bounds[0], lower)

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1

    @property
    def prefix(self) -> np.ndarray:
        if self._prefix is None:
            power, _ = powers(max(1, len(self.data)))
            self._prefix = np.zeros(len(self.data) + 1, dtype=U)
            np.cumsum(CODES[self.data] * power[: len(self.data)], out=self._prefix[1:])
        return self._prefix

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the byte ranges from ``starts`` up to ``ends``."""
        _, inverse = powers(len(self.data) + 1)
        return mix((self.prefix[ends] - self.prefix[starts]) * inverse[starts])

    def words(self) -> Words:
        n = len(self.data)
        solid = ~SPACE[self.data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.bounds] = True
        left = edge[:n].copy()
        left[1:] |= ~solid[:-1]
        right = edge[1:].copy()
        right[:-1] |= ~solid[1:]
        starts, ends = np.flatnonzero(solid & left), np.flatnonzero(solid & right) + 1
        return Words(self, starts, ends, np.searchsorted(starts, self.bounds))


class Words:
    """``starts``, ``ends``: byte ranges; ``bounds``: the first word of each text, and the end."""

    def __init__(self, flat: Flat, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray):
        self.flat, self.starts, self.ends, self.bounds = flat, starts, ends, bounds
        self.counts = np.diff(bounds)
        self.texts = np.repeat(np.arange(flat.rows), self.counts)
        self.hashes = flat.hashes(starts, ends)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of ``n`` words inside one text, and the windows' hashes."""
        size = len(self.starts) - n + 1
        if size <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U)
        first = np.flatnonzero(self.texts[:size] == self.texts[n - 1 :])
        joined = np.zeros(size, dtype=U)
        for k in range(n):
            joined = joined * _STEP + self.hashes[k : k + size]
        return first, mix(joined[first])

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Text numbers and hashes of the distinct shingles, ordered by both.

        A text with fewer than ``n`` words has its whole sequence as one shingle, one
        without words has none.
        """
        first, keys = self.windows(n)
        owners = self.texts[first]
        short = np.flatnonzero((self.counts > 0) & (self.counts < n))
        if len(short):
            whole = np.zeros(len(short), dtype=U)
            for k in range(n - 1):
                has = self.counts[short] > k
                at = np.where(has, self.bounds[short] + k, 0)
                whole = np.where(has, whole * _STEP + self.hashes[at], whole)
            owners = np.concatenate([owners, short])
            keys = np.concatenate([keys, mix(whole ^ self.counts[short].astype(U))])
        order = np.lexsort((keys, owners))
        owners, keys = owners[order], keys[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
        return owners[new], keys[new]


def positions(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers of all ranges of ``lengths`` from ``starts``, one after another."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return np.arange(total, dtype=np.int64) + shift
