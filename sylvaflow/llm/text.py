"""Vectorised word and shingle hashing over Arrow batches.

Words are maximal runs of bytes outside space and 0x09-0x0D, so UTF-8 texts need
no decoding. A word's 64-bit hash comes from a polynomial over its bytes, taken
from one running sum over the batch; no Python loop sees a single word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes handled at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between batches."""
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 64)
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        with np.errstate(over="ignore"):
            have = _POWERS[name] = np.multiply.accumulate(factors)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def as_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def by_bytes(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` text bytes each, at least one row; no slice of an empty batch."""
    if not batch.num_rows:
        return
    sizes = np.diff(offsets(as_strings(batch.column(column))))
    group = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def offsets(texts: pa.LargeStringArray) -> np.ndarray:
    """Byte offsets of the rows in the value buffer."""
    raw = np.frombuffer(texts.buffers()[1], np.int64) if len(texts) else np.zeros(1, np.int64)
    return raw[texts.offset : texts.offset + len(texts) + 1]


class Words:
    """Words of a slice: start, end (byte positions in `data`), hash, and first word of each row."""

    def __init__(self, column: pa.Array, lower: bool = True):
        texts = as_strings(column)
        at = offsets(texts)
        buffer = texts.buffers()[2]
        data = np.frombuffer(buffer, np.uint8)[at[0] : at[-1]] if buffer is not None and len(texts) else np.zeros(0, np.uint8)
        self.data, self.rows = data, at - at[0]
        inside = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[self.rows] = True
        before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.concatenate([inside[1:], [False]]) if len(data) else inside
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, self.rows)
        table = _LOWER if lower else _BYTE
        with np.errstate(over="ignore"):
            self._total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(table[data] * _powers("up", _R, len(data)), out=self._total[1:])
        self.hash = self.spans(self.start, self.end)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges, equal for equal bytes."""
        with np.errstate(over="ignore"):
            part = (self._total[end] - self._total[start]) * _powers("down", _R_INV, len(self.data) + 1)[start]
            return mix(part + np.uint64(0x51ED270B) * (end - start).astype(np.uint64))

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def shingles(hashes: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words within a row, and the first of each row. A row with fewer
    words, but one at least, has its whole sequence as one."""
    counts = np.diff(first)
    number = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    start = np.zeros(len(number) + 1, np.int64)
    np.cumsum(number, out=start[1:])
    word = np.repeat(first[:-1] - start[:-1], number) + np.arange(start[-1])
    with np.errstate(over="ignore"):
        out = np.zeros(len(word), np.uint64)
        full = np.repeat(counts >= size, number)
        for j in range(size):
            out[full] = out[full] * _R + hashes[word[full] + j]
        for row in np.flatnonzero((counts > 0) & (counts < size)):
            value = np.uint64(counts[row])
            for h in hashes[first[row] : first[row + 1]]:
                value = value * _R + h
            out[start[row]] = value
    return mix(out), start


def distinct(values: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and the first of each row."""
    row = np.repeat(np.arange(len(start) - 1), np.diff(start))
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[keep], np.searchsorted(row[keep], np.arange(len(start)))


def list_array(values: np.ndarray, start: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(values, kind))
