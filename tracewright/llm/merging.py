"""Merging of symbol pairs by rank, for many short sequences at once.

A vocabulary is a table of pairs: which two neighbouring symbols join, how early, and into what. In each round every
sequence joins its earliest pair, the leftmost of equal ones, until no pair is left; one round is a few numpy calls
over all sequences that still change. Sequences of over WIDTH symbols go one by one through a heap, so that a text
without a blank costs n log n.
"""

from __future__ import annotations

import heapq

import numpy as np

#: Symbols of the longest sequence that is merged together with others.
WIDTH = 64
_NONE = np.iinfo(np.int32).max


class Merges:
    """left, right: ids of symbols; rank: lower joins earlier; new: id of the joined symbol. Of a repeated pair the lowest rank counts."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, new: np.ndarray):
        key = np.asarray(left, np.int64) << 32 | np.asarray(right, np.int64)
        order = np.lexsort((rank, key))
        order = order[np.r_[True, np.diff(key[order]) > 0]] if len(order) else order
        self.key, self.rank, self.new = key[order], np.asarray(rank, np.int32)[order], np.asarray(new, np.int32)[order]
        self._one: dict[int, tuple[int, int]] | None = None
        # open addressing, a quarter full at most
        self._bits = max(4, (4 * len(self.key)).bit_length())
        self._slots = np.full(1 << self._bits, -1, np.int32)
        todo = np.arange(len(self.key), dtype=np.int32)
        at = self._slot(self.key)
        while len(todo):
            free = self._slots[at] < 0
            self._slots[at[free]] = todo[free]  # of several for one slot the last stays
            lost = self._slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & ((1 << self._bits) - 1)
        self._keys = np.where(self._slots >= 0, self.key[self._slots] if len(self.key) else -1, -1)

    def _look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the table, or -1."""
        shape, key = left.shape, (left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF).ravel()
        at = self._slot(key)
        held = self._keys[at]
        out = np.where(held == key, self._slots[at], np.int32(-1))
        far = np.flatnonzero((held != key) & (held >= 0))
        while len(far):
            at[far] = (at[far] + 1) & ((1 << self._bits) - 1)
            held = self._keys[at[far]]
            hit = held == key[far]
            out[far[hit]] = self._slots[at[far[hit]]]
            far = far[~hit & (held >= 0)]
        out[key < 0] = -1
        return out.reshape(shape)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def __call__(self, symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merged sequences of symbols[at[i]:at[i+1]], flat, and where each begins (one entry more)."""
        symbols = np.asarray(symbols, np.int32)
        size = np.diff(at)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (sequences, their sizes, ids)
        low = 0
        for width in (1, 2, 4, 6, 8, 12, 16, 24, 32, WIDTH):
            rows = np.flatnonzero((size > low) & (size <= width))
            low = width
            if len(rows):
                out.append(self._together(symbols, at[:-1][rows], size[rows], rows, width))
        for i in np.flatnonzero(size > WIDTH):
            ids = self._alone(symbols[at[i] : at[i + 1]].tolist())
            out.append((np.array([i]), np.array([len(ids)]), np.array(ids, np.int32)))
        count = np.zeros(len(size), np.int64)
        for rows, n, _ in out:
            count[rows] = n
        ends = np.r_[0, np.cumsum(count)]
        flat = np.empty(ends[-1], np.int32)
        for rows, n, ids in out:
            flat[np.repeat(ends[rows] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(len(ids))] = ids
        return flat, ends

    def _together(self, symbols, start, size, rows, width):
        col = np.arange(width)
        live = col < size[:, None]
        ids = np.where(live, symbols[np.minimum(start[:, None] + col, len(symbols) - 1)], -1)
        if width == 1:
            return rows, size, ids[:, 0]
        n = size.copy()
        pair = np.where(live[:, 1:], self._look(ids[:, :-1], ids[:, 1:]), -1)
        rank = np.where(pair >= 0, self.rank[pair], _NONE) if len(self.rank) else np.full(pair.shape, _NONE, np.int32)
        todo = np.flatnonzero(rank.min(1) < _NONE)
        while len(todo):
            r = rank[todo]
            j = r.argmin(1)
            t, each = ids[todo], np.arange(len(todo))
            made = self.new[self._look(t[each, j], t[each, j + 1])]
            step = col + (col > j[:, None])
            t = np.where(step < width, np.take_along_axis(t, np.minimum(step, width - 1), 1), -1)
            t[each, j] = made
            gap = col[:-1] + (col[:-1] >= j[:, None])
            r = np.where(gap < width - 1, np.take_along_axis(r, np.minimum(gap, width - 2), 1), _NONE)
            for k, ok in ((j - 1, j > 0), (j, (j + 1 < width) & (t[each, np.minimum(j + 1, width - 1)] >= 0))):
                e = each[ok]
                k = k[ok]
                p = self._look(t[e, k], t[e, k + 1])
                r[e, k] = np.where(p >= 0, self.rank[p], _NONE)
            last = ~((j + 1 < width) & (t[each, np.minimum(j + 1, width - 1)] >= 0)) & (j < width - 1)
            r[each[last], j[last]] = _NONE
            ids[todo], rank[todo] = t, r
            n[todo] -= 1
            todo = todo[r.min(1) < _NONE]
        return rows, n, ids[col < n[:, None]]

    def _alone(self, ids: list[int]) -> list[int]:
        if self._one is None:
            self._one = dict(zip(self.key.tolist(), zip(self.rank.tolist(), self.new.tolist(), strict=True), strict=True))
        find, n = self._one.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found[0], i, ids[i], ids[i + 1], found[1]) for i in range(n - 1) if (found := find(ids[i] << 32 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := find(new << 32 | ids[k]):
                    heapq.heappush(heap, (found[0], i, new, ids[k], found[1]))
            if (h := before[i]) >= 0 and (found := find(ids[h] << 32 | new)):
                heapq.heappush(heap, (found[0], h, ids[h], new, found[1]))
        return [x for x in ids if x >= 0]
