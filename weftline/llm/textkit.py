"""Vectorised words, hashes and shingles over the bytes of an Arrow text column.

All functions take whole texts.  A batch is walked in slices of bounded bytes,
so that memory follows the slice (or the longest single text), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 17
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_COMBINE = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

# bytes 0x09-0x0D and 0x20 separate words
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        m = 1 << max(19, (n - 1).bit_length())
        out = np.empty(m, np.uint64)
        out[0] = 1
        k = 1
        while k < m:
            out[k : 2 * k] = out[:k] * np.uint64(pow(base, k, 1 << 64))
            k *= 2
        if m <= 1 << 21:
            _powers[base] = out
        have = out
    return have[:n]


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) for runs of rows of about ``limit`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class Words:
    """Words of a slice, ``[^\\x20\\x09-\\x0D]+`` unless told otherwise, with A-Z lower-cased in the hashes."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR):
        self.offsets, n = offsets, len(raw)
        inside = np.empty(n + 1, bool)
        np.logical_not(separator[raw], out=inside[:n])
        inside[n] = False
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n + 1, bool)
        before[0] = False
        before[1:] = inside[:n]
        self.start = np.flatnonzero(inside & (~before | edge))
        after_edge = np.empty(n + 1, bool)
        after_edge[:n] = edge[1:] | ~inside[1:]
        after_edge[n] = False
        self.end = np.flatnonzero(inside & after_edge) + 1
        self.bound = np.searchsorted(self.start, offsets)
        self.hash = self._hashes(LOWER[raw])

    def _hashes(self, low: np.ndarray) -> np.ndarray:
        n = len(low)
        if not len(self.start):
            return np.zeros(0, np.uint64)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[low] * powers(_BASE, n), out=total[1:])
        h = (total[self.end] - total[self.start]) * powers(_BASE_INV, n)[self.start]
        return mix(h + (self.end - self.start).astype(np.uint64))

    def per_row(self) -> np.ndarray:
        return np.diff(self.bound)


def combine(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` consecutive values."""
    m = len(h) - width + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m] * _COMBINE[0]
    for j in range(1, width):
        out += h[j : j + m] * _COMBINE[j]
    return mix(out)


def combine_all(h: np.ndarray) -> np.uint64:
    """One hash of a whole short sequence, its length included."""
    s = np.uint64(len(h))
    for x, c in zip(h, _COMBINE, strict=False):
        s = s + x * c
    return mix(np.array([s], np.uint64) ^ np.uint64(0x5851F42D4C957F2D))[0]


def shingle_sets(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of each row, sorted: (values, row offsets).

    A row of fewer words than ``width`` has its whole sequence as one shingle,
    a row without words has none.
    """
    with np.errstate(over="ignore"):
        every = combine(words.hash, width)
        parts, sizes = [], []
        for a, b in zip(words.bound[:-1], words.bound[1:], strict=True):
            if b - a >= width:
                part = np.sort(every[a : b - width + 1])
                if len(part) > 1:
                    part = part[np.concatenate(([True], part[1:] != part[:-1]))]
            elif b > a:
                part = np.array([combine_all(words.hash[a:b])], np.uint64)
            else:
                part = every[:0]
            parts.append(part)
            sizes.append(len(part))
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), offsets


def crc32_u32(ids: np.ndarray) -> int:
    import zlib

    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())
