"""Whole Arrow batches of text as arrays of word hashes, without a Python object per word.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r; A-Z count as a-z. Every word gets a
64-bit polynomial hash from prefix sums over the batch's bytes, so one pass of numpy serves all
documents of a slice. Slices hold about SLICE bytes and never part of a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over the output."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x ^= x >> U(27)
    x *= U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_BYTE[65:91] = _BYTE[97:123]
_BASE, _INVERSE = 0x9E3779B97F4A7C13, pow(0x9E3779B97F4A7C13, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * SLICE)
        _powers[:] = [np.cumprod(np.r_[U(1), np.full(size, b, U)]) for b in (U(_BASE), U(_INVERSE))]
    return _powers[0], _powers[1]


class Words:
    """Words of some documents: hash, first byte and end of each (bytes count within the slice), and at[d]:at[d+1] the words of document d."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        b, o = data[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)
        n = len(b)
        self.bytes, self.offsets = b, o
        solid = ~_SPACE[b]
        cut = np.zeros(n + 1, bool)
        cut[o] = True
        first, last = solid.copy(), solid.copy()
        if n:
            first[1:] &= ~solid[:-1] | cut[1:n]
            last[:-1] &= ~solid[1:] | cut[1:n]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        power, inverse = _power_tables(n + 1)
        total = np.zeros(n + 1, U)
        np.cumsum(_BYTE[b] * power[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start])
        self.at = np.searchsorted(self.start, o)


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary() if pa.types.is_large_binary(column.type) else pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def slices(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, their words) for runs of rows of about SLICE bytes."""
    data, offsets = text_arrays(column)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
        yield row, stop, Words(data, offsets[row : stop + 1])
        row = stop


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each document, and where each document's begin (one entry more).

    A document of fewer words has its whole sequence as one shingle; one without words has none.
    """
    count = np.diff(w.at)
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    at = np.r_[0, np.cumsum(n)]
    doc = np.repeat(np.arange(len(n)), n)
    pos = np.arange(at[-1]) - at[doc] + w.at[doc]
    length = np.minimum(count, size)[doc]
    h = np.zeros(len(pos), U)
    padded = np.r_[w.hash, np.zeros(size, U)]
    for j in range(size):
        h = h * U(0xD1342543DE82EF95) + np.where(j < length, padded[pos + j], U(j + 1))
    h = mix(h + length.astype(U))
    for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        h[s:e].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], np.r_[0, np.cumsum(np.bincount(doc[keep], minlength=len(n)))]
