"""Vectorised 64-bit hashes of the words of a text and of their prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes hashed at once; longer texts go by pieces that end between words.
PIECE = 1 << 20
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    table = _powers.get(base)
    if table is None or len(table) < n:
        steps = np.full(max(n, 1 << 15), base, np.uint64)
        steps[0] = 1
        table = _powers[base] = np.multiply.accumulate(steps)
    return table[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, shifts): bytes i .. j - 1 hash to (sums[j] - sums[i]) * shifts[i], wherever they stand."""
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _power(_BASE, len(raw)), out=sums[1:])
    return sums, _power(_BASE_INVERSE, len(raw))


class Words:
    """Words of a stretch of text whose separators are spaces: start, stop and their hashes."""

    def __init__(self, data: bytes, at: int, end: int):
        raw = np.frombuffer(data, np.uint8, end - at, at)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], raw == 0x20, [True]]).view(np.int8)))
        self.start, self.stop = edge[::2], edge[1::2]
        self._run, self._shift = hash_sums(raw)

    def hashes(self) -> np.ndarray:
        return self._between(self.start, self.stop)

    def prefixes(self, length: int) -> np.ndarray:
        """Hashes of the first `length` bytes of the words that are at least so long."""
        start = self.start[self.stop - self.start >= length]
        return self._between(start, start + length)

    def _between(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self._run[stop] - self._run[start]) * self._shift[start])


def stretches(data: bytes) -> Iterator[Words]:
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield Words(data, at, end)
        at = end
