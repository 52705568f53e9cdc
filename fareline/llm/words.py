"""Words of many texts as arrays of hashes.

A word is a run of bytes other than space and the control characters 9 to 13, which is
what ``bytes.split()`` gives. Hashes are 64 bits wide and depend on the bytes alone, so
they are equal in every task and session.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

U64 = np.uint64
_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
_STEP = U64(0x9E3779B97F4A7C15)
_GRAM = _random.integers(1, 2**63, 64, dtype=U64) * U64(2) + U64(1)
_POWERS = np.ones(1, dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finaliser)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 2 * len(_POWERS)), _STEP, dtype=U64)
        steps[0] = 1
        _POWERS = np.cumprod(steps, dtype=U64)
    return _POWERS


class Words(NamedTuple):
    """``hashes`` of all words in order; those of text i are at ``bounds[i]:bounds[i + 1]``."""

    hashes: np.ndarray
    bounds: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def spans(run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one places of the runs of true values."""
    edges = np.diff(np.concatenate(([False], run, [False])).astype(np.int8))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each run."""
    lengths = ends - starts
    if not len(starts):
        return np.empty(0, dtype=U64)
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    inside = data[np.repeat(starts, lengths) + place]
    parts = _BYTE[inside] * _powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(parts, first))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array with a line feed after each, and where each text begins."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    begins = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
    return data, begins


def split(texts: list[bytes]) -> Words:
    if not texts:
        return Words(np.empty(0, dtype=U64), np.zeros(1, dtype=np.int64))
    data, begins = joined(texts)
    starts, ends = spans((data != 32) & ((data < 9) | (data > 13)))
    return Words(run_hashes(data, starts, ends), np.searchsorted(starts, begins))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k words in a row; the caller leaves out those that cross texts."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=U64)
    out = np.zeros(n, dtype=U64)
    for j in range(k):
        out += hashes[j : j + n] * _GRAM[j]
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
