"""Texts cut into chunks, and a table that makes what a chunk stands for once.

Chunks repeat: a task keeps a table of the distinct ones. Each slice of texts is cut where a space begins a chunk, the
chunks are numbered by their place in the table, only new ones are worked on, and what belongs to a text is taken from
the table by these numbers. No Python object is made for a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tracewright.llm.words import text_arrays

#: Bytes of text that are cut at once, and distinct chunks and their bytes that a task keeps at most; when more come the table starts anew.
SLICE, KEEP, KEEP_BYTES = 8 << 20, 500_000, 32 << 20


def marked(column: pa.Array) -> pa.Array:
    """Each text with a space before it; null and empty texts are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    return pc.if_else(pc.equal(pc.binary_length(column), 0), column, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string())))


def slices(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of about SLICE bytes each; a text is never cut."""
    _, offsets = text_arrays(column)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
        yield row, column.slice(row, stop - row)
        row = stop


def cut(texts: pa.Array, starts) -> tuple[pa.Array, np.ndarray]:
    """The chunks of all texts as one binary array, and at: text i has chunks at[i]:at[i+1]. starts(bytes) marks the bytes where a chunk may begin; a text's first byte always begins one."""
    data, offsets = text_arrays(texts)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    first = starts(data)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    place = np.flatnonzero(first)
    edges = np.r_[place, len(data)].astype(np.int64)
    chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(place), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
    return chunks, np.searchsorted(place, offsets)


def before_spaces(data: np.ndarray) -> np.ndarray:
    """Where a space follows another byte."""
    out = data == 32
    out[1:] &= data[:-1] != 32
    return out


_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[10, *range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def beside_letters(data: np.ndarray) -> np.ndarray:
    """Where an ASCII mark or line end follows an ASCII letter, and where such a letter follows a line end that stands alone behind a visible ASCII character."""
    letter = _LETTER[data]
    out = np.zeros(len(data), bool)
    out[1:] = letter[:-1] & _MARK[data[1:]]
    out[2:] |= (data[:-2] > 32) & (data[:-2] < 127) & (data[1:-1] == 10) & letter[2:]
    return out


class Table:
    """Distinct chunks and what make(chunks) gives for them: a dict of arrays with an entry a chunk."""

    def __init__(self, make):
        self.make = make
        self._empty()

    def _empty(self) -> None:
        self.chunks, self.parts, self.n, self.size = pa.array([], pa.large_binary()), [], 0, 0

    def full(self) -> bool:
        return self.n > KEEP or self.size > KEEP_BYTES

    def start_anew(self) -> None:
        self._empty()

    def numbers(self, chunks: pa.Array) -> np.ndarray:
        """Each chunk's place in the table, after new ones have been added."""
        d = chunks.dictionary_encode()
        found = pc.index_in(d.dictionary, value_set=self.chunks)
        fresh = d.dictionary.filter(pc.is_null(found))
        place = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        place[place < 0] = self.n + np.arange(len(fresh))
        if len(fresh) or not self.parts:
            self.parts.append(self.make(fresh))
            self.chunks = pa.concat_arrays([self.chunks, fresh])
            self.n, self.size = self.n + len(fresh), self.size + int(pc.sum(pc.binary_length(fresh)).as_py() or 0)
        return place[d.indices.to_numpy()]

    def column(self, name: str):
        """All entries of one array that make() gives."""
        parts = [p[name] for p in self.parts]
        return pa.concat_arrays(parts) if isinstance(parts[0], pa.Array) else np.concatenate(parts)


def binary(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """A binary array of the bytes of data between edges."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(np.ascontiguousarray(edges, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def joined(values: pa.Array, numbers: np.ndarray, at: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The values of the numbered entries end to end, and where each text's part begins (one entry more)."""
    taken = values.take(pa.array(numbers))
    data, edges = text_arrays(taken)
    return memoryview(np.ascontiguousarray(data)), edges[at]
