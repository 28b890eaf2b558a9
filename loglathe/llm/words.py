"""Words and word shingles of texts as 64-bit hashes, whole Arrow columns at a time.

Words are runs of bytes other than the six ASCII white-space bytes, with A-Z in lower case. A null
text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse, modulo 2**64, at least ``n`` of each."""
    for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
        have = _powers[k]
        while len(have) < n:
            factor = np.uint64(pow(base, len(have), 1 << 64))
            have = np.concatenate([have, have * factor])
        _powers[k] = have
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some consecutive rows: hash, first and end byte of each, and ``bounds``, the
    place of each row's first word (one more entry than rows)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data = _LOWER[data]
        n = len(data)
        inside = ~_SPACE[data]
        begins = np.zeros(n + 1, bool)
        begins[offsets] = True
        gap = np.ones(n + 1, bool)
        gap[1:] = ~inside
        first = inside & (gap[:-1] | begins[:-1])
        gap[:-1] = ~inside
        gap[-1] = True
        last = inside & (gap[1:] | begins[1:])
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        power, inverse = _power(n + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[:n], out=self._sums[1:])
        self._inverse = inverse
        self.hashes = self.hash_until(self.ends)

    def hash_until(self, ends: np.ndarray) -> np.ndarray:
        """Hashes of the words cut off before ``ends`` (their lengths count as well)."""
        raw = (self._sums[ends] - self._sums[self.starts]) * self._inverse[self.starts]
        return mix(raw + (ends - self.starts).astype(np.uint64) * np.uint64(_BASE))


def _views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and 64-bit offsets of a string column; nulls are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``size`` bytes each (a longer text makes a run of its own)."""
    _, offsets = _views(column)
    start, rows = 0, len(column)
    while start < rows:
        end = int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1
        end = min(rows, max(end, start + 1))
        yield start, end
        start = end


def words(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, their words) for the rows of a string column, in bounded runs."""
    data, offsets = _views(column)
    for start, end in chunks(column, size):
        own = offsets[start : end + 1]
        yield start, end, Words(data[own[0] : own[-1]], own - own[0])


def shingle_sets(found: Words, width: int) -> Iterator[np.ndarray]:
    """Each row's distinct shingle hashes, sorted. Fewer words than ``width`` make one shingle."""
    h = found.hashes
    joined = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width):
        joined = joined * np.uint64(_BASE) + h[k : k + len(joined)]
    joined = mix(joined)
    bounds = found.bounds.tolist()
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= width:
            row = np.sort(joined[a : b - width + 1])
            keep = np.empty(len(row), bool)
            keep[0] = True
            np.not_equal(row[1:], row[:-1], out=keep[1:])
            yield row[keep]
        elif b > a:
            short = np.array([b - a], np.uint64)
            for k in range(a, b):
                short = mix(short * np.uint64(_BASE) + h[k : k + 1])
            yield short
        else:
            yield np.zeros(0, np.uint64)
