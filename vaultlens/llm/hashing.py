"""64-bit hashes of word runs in a text, with NumPy over its bytes."""

from __future__ import annotations

import hashlib

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A random odd number for each byte value, from a fixed seed.
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _powers_to(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``size`` of each."""
    global _powers
    if len(_powers[0]) < size:
        size = max(size, 2 * len(_powers[0]), 1 << 16)
        made = []
        for factor in (_BASE, _INVERSE):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _powers = made[0], made[1]
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_runs(words: list[bytes], size: int) -> np.ndarray:
    """A hash for each run of ``size`` consecutive words, in order.

    Fewer words make one run, no words none. Equal runs have equal hashes; a run
    is hashed as its words joined by blanks.
    """
    if not words:
        return np.zeros(0, np.uint64)
    joined = np.frombuffer(b" ".join(words), np.uint8)
    powers, inverses = _powers_to(len(joined) + 1)
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum(_BYTES[joined] * powers[: len(joined)], out=sums[1:])
    blanks = np.flatnonzero(joined == 32)
    starts = np.concatenate(([0], blanks + 1))
    ends = np.concatenate((blanks, [len(joined)]))
    size = min(size, len(starts))
    first, last = starts[: len(starts) - size + 1], ends[size - 1 :]
    return mixed((sums[last] - sums[first]) * inverses[first])


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word runs of a text, A-Z in lower case."""
    return np.unique(word_runs(text.lower().split(), size))


def digest(values: np.ndarray) -> bytes:
    """128 bits of a sorted set of hashes."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()
