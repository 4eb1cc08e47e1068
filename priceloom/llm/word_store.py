"""What a task knows of the words it has met: ragged columns by word, made once for each different word."""

from __future__ import annotations

import gc
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa

from . import common as C

#: Words and bytes of words that a task keeps; beyond either it forgets the rarer ones before the next chunk.
WORDS, BYTES = 1 << 18, 16 << 20


class Ragged:
    """A growing list of arrays: values one after the other, with where each begins."""

    def __init__(self, kind):
        self.held, self.used = np.empty(1 << 12, kind), 0
        self.bounds, self.n = np.zeros(1 << 12, np.int64), 0

    @staticmethod
    def _room(held: np.ndarray, need: int) -> np.ndarray:
        if need <= len(held):
            return held
        grown = np.empty(max(need, 2 * len(held)), held.dtype)
        grown[: len(held)] = held
        return grown

    def append(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.held = self._room(self.held, self.used + len(values))
        self.bounds = self._room(self.bounds, self.n + len(sizes) + 1)
        self.held[self.used : self.used + len(values)] = values
        self.bounds[self.n + 1 : self.n + len(sizes) + 1] = self.used + np.cumsum(sizes)
        self.used, self.n = self.used + len(values), self.n + len(sizes)

    def clear(self) -> None:
        self.used = self.n = 0

    def size(self, rows: np.ndarray) -> np.ndarray:
        return self.bounds[rows + 1] - self.bounds[rows]

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of the rows one after the other, size of each)."""
        size = self.size(rows)
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        return self.held[np.repeat(self.bounds[rows] - stop + size, size) + np.arange(total)], size


    def take_bytes(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``take`` for a column of bytes, without an index for each byte."""
        held = pa.Array.from_buffers(pa.large_binary(), self.n, [None, pa.py_buffer(self.bounds[: self.n + 1]), pa.py_buffer(self.held[: self.used])]).take(pa.array(rows))
        _, off, data = held.buffers()
        off = np.frombuffer(off, np.int64)[held.offset : held.offset + len(held) + 1] if len(held) else np.zeros(1, np.int64)
        return (np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)), np.diff(off)


class WordStore:
    """Ragged columns by word.  ``make(words)`` takes different words as bytes and returns (values, sizes) for each column."""

    def __init__(self, make: Callable[[list[bytes]], list[tuple[np.ndarray, np.ndarray]]], kinds: list, words: int = WORDS, most_bytes: int = BYTES):
        self.make, self.columns = make, [Ragged(kind) for kind in kinds]
        self.words, self.most_bytes, self.known, self.bytes = words, most_bytes, {}, 0
        self.epoch = 0  # how often it has forgotten
        self.met = np.zeros(0, np.int32)  # in how many chunks each row was met

    def rows(self, words: pa.Array) -> np.ndarray:
        """The row of each word (valid until the next call); unknown ones are made."""
        if len(self.known) >= self.words or self.bytes >= self.most_bytes:
            self.forget()
        numbers, different = C.numbered(words)
        keys = different.to_pylist()
        rows = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(rows < 0)
        if len(new):
            fresh = [keys[i] for i in new]
            rows[new] = self.add(fresh)
            self.known.update(zip(fresh, rows[new].tolist()))
        if len(self.met) < self.columns[0].n:
            self.met = np.concatenate([self.met, np.zeros(self.columns[0].n, np.int32)])
        self.met[rows] += 1
        return rows[numbers]

    def forget(self) -> None:
        """Keep the words that were met most, a quarter of both bounds at most, and only those met again."""
        keys, rows = list(self.known), np.fromiter(self.known.values(), np.int64, len(self.known))
        met = self.met[rows]
        order = np.argsort(-met, kind="stable")[: self.words // 4]
        order = order[met[order] > 1]
        size = np.cumsum([len(keys[k]) for k in order])
        order = order[: int(np.searchsorted(size, self.most_bytes // 4, "right"))]
        kept = [(column, *column.take(rows[order])) for column in self.columns]
        for column, values, sizes in kept:
            column.clear()
            column.append(values, sizes)
        self.known = {keys[k]: at for at, k in enumerate(order)}
        self.bytes, self.met, self.epoch = sum(map(len, self.known)), met[order], self.epoch + 1

    def add(self, words: list[bytes]) -> np.ndarray:
        """The new rows of words that are made and not looked up again."""
        at, collected = self.columns[0].n, gc.isenabled()
        gc.disable()  # many small lists, none of them in a cycle
        try:
            for column, (values, sizes) in zip(self.columns, self.make(words)):
                column.append(values, sizes)
        finally:
            if collected:
                gc.enable()
        self.bytes += sum(map(len, words))
        return np.arange(at, at + len(words))
