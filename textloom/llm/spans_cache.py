"""Results by byte span, so that each distinct span of a worker's texts is computed once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from textloom.llm.arrow_text import short_hashes

_U = np.uint64


class HashTable:
    """Different 64-bit keys, none of them 0, to int32 values; numpy probes for many keys at once. Keys should be hashes."""

    def __init__(self, size: int = 1 << 16):
        self.keys, self.values, self.used = np.zeros(size, np.uint64), np.zeros(size, np.int32), 0

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Different keys, none of them in the table."""
        self.used += len(keys)
        if 2 * self.used > len(self.keys):
            held = self.keys > 0
            old = self.keys[held], self.values[held]
            size = 1 << int(np.ceil(np.log2(4 * self.used)))
            self.keys, self.values = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._insert(*old)
        self._insert(keys, values)

    def _insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        mask = len(self.keys) - 1
        at = (keys >> _U(20)).astype(np.int64) & mask
        while len(keys):
            free = self.keys[at] == 0
            self.keys[at[free]], self.values[at[free]] = keys[free], values[free]
            lost = self.keys[at] != keys  # taken before, or by another of these
            keys, values, at = keys[lost], values[lost], (at[lost] + 1) & mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 if unknown."""
        mask = len(self.keys) - 1
        at = (keys >> _U(20)).astype(np.int64) & mask
        held = self.keys.take(at)
        value = np.where(held == keys, self.values.take(at), np.int32(-1))
        on = np.flatnonzero((held != keys) & (held != 0))
        own, at = keys[on], (at[on] + 1) & mask
        while len(on):
            held = self.keys.take(at)
            same = held == own
            value[on[same]] = self.values[at[same]]
            go = ~same & (held != 0)
            on, own, at = on[go], own[go], (at[go] + 1) & mask
        return value


class SpanCache:
    """Maps spans to rows of results; compute(list of spans) gives all results one after another and the number of each span's.

    Spans are known by a 64-bit hash (which takes in their length), in an open-addressed table that numpy probes for all spans at once (among a million spans two
    of a kind are expected once in some 10**7 tables). The cache empties when it holds `limit` spans; what was computed doesn't depend on it.
    """

    def __init__(self, compute: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], dtype: type, limit: int = 400_000):
        self.compute, self.dtype, self.limit = compute, dtype, limit
        self.clear()

    def clear(self) -> None:
        self.rows, self.size = HashTable(), 0
        self.flat, self.used = np.zeros(1 << 16, self.dtype), 0
        self.first, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)

    def _add(self, keys: np.ndarray, results: np.ndarray, n: np.ndarray) -> np.ndarray:
        rows, total = np.arange(self.size, self.size + len(n), dtype=np.int32), len(results)
        while self.size + len(n) > len(self.first):
            self.first, self.n = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.n))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.first[rows], self.n[rows] = self.used + np.cumsum(n) - n, n
        self.flat[self.used : self.used + total] = results
        self.used += total
        self.size += len(n)
        self.rows.add(keys, rows)
        return rows

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All results, span after span, and the number of each span's."""
        if not len(starts):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        if self.size > self.limit:
            self.clear()
        keys = np.maximum(short_hashes(data, starts, ends), _U(1))
        row = self.rows.find(keys)
        new = np.flatnonzero(row < 0)
        if len(new):
            own, where, back = np.unique(keys[new], return_index=True, return_inverse=True)
            raw, a, b = data.tobytes(), starts[new[where]].tolist(), ends[new[where]].tolist()
            row[new] = self._add(own, *self.compute([raw[x:y] for x, y in zip(a, b, strict=True)]))[back]
        first, n = self.first.take(row), self.n.take(row).astype(np.int64)
        if len(n) and (n == n[0]).all():
            return self.flat[(first[:, None] + np.arange(n[0])).ravel()], n
        begin = np.cumsum(n) - n
        return self.flat.take(np.repeat(first - begin, n) + np.arange(int(n.sum()))), n
