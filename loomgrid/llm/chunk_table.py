"""Encode each distinct chunk of text once, and whole texts by lookup.

Tokenizers whose tokens never cross a white space can be asked for distinct
words only. A table maps a chunk to the place of its ids in one flat array, so
a slice of texts becomes ids by gathers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np

from . import textbytes as tb


class _Places(dict):
    """Chunk to index; a new chunk gets the next one."""

    def __init__(self):
        self.fresh: list[bytes] = []

    def __missing__(self, chunk: bytes) -> int:
        self[chunk] = place = len(self)
        self.fresh.append(chunk)
        return place


class ChunkTable:
    """``encode``: distinct chunks to a list of id lists.

    Beyond ``most_bytes`` of chunks or ``most`` of them the table keeps what it
    has, and further chunks are held for one call only.
    """

    def __init__(self, encode: Callable[[list[bytes]], list], most: int = 400_000, most_bytes: int = 32 << 20):
        self.encode, self.most, self.most_bytes = encode, most, most_bytes
        self._start()

    def _start(self) -> None:
        self.passing: tuple[list[bytes], int, int] | None = None  # chunks of the last call that are not kept, and the marks to go back to
        self.places, self.held, self.used = _Places(), 0, 0
        self.flat = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.count = 0

    def lookup(self, chunks: Iterable[bytes], count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, start, length) of each chunk; valid until the next call, as is ``at``, the places of the chunks."""
        if self.passing:
            for chunk in self.passing[0]:
                del self.places[chunk]
            self._back(*self.passing[1:])
            self.passing = None
        full = len(self.places) >= self.most or self.held > self.most_bytes
        marks = (self.count, self.used)
        at = self.at = np.fromiter(map(self.places.__getitem__, chunks), np.int64, count)
        if self.places.fresh:
            fresh, self.places.fresh = self.places.fresh, []
            self._learn(fresh)
            if full:
                self.passing = (fresh, *marks)
            else:
                self.held += sum(map(len, fresh))
        return self.flat, self.start[at], self.length[at]

    def _back(self, count: int, used: int) -> None:
        self.count, self.used = count, used

    def _learn(self, fresh: list[bytes]) -> None:
        found = self.encode(fresh)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        total = int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + len(found) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), np.int32, total)
        ends = np.cumsum(sizes)
        self.start[self.count : self.count + len(found)] = self.used + ends - sizes
        self.length[self.count : self.count + len(found)] = sizes
        self.used += total
        self.count += len(found)

    def texts(self, chunks_of: list[list[bytes]], tail: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by text) of texts given as their chunks, each followed by ``tail``."""
        counts = np.fromiter(map(len, chunks_of), np.int64, len(chunks_of))
        return self.joined(counts, *self.lookup(chain.from_iterable(chunks_of), int(counts.sum())), tail)

    @staticmethod
    def joined(counts: np.ndarray, flat: np.ndarray, start: np.ndarray, length: np.ndarray, tail: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """The same from the number of chunks of each text and the places of their ids."""
        sums = np.concatenate([[0], np.cumsum(length)])
        edge = np.concatenate([[0], np.cumsum(counts)])
        per_text = sums[edge[1:]] - sums[edge[:-1]] + len(tail)
        offsets = np.concatenate([[0], np.cumsum(per_text)])
        out = np.empty(int(offsets[-1]), np.int32)
        text = np.repeat(np.arange(len(counts)), counts)
        begin = sums[:-1] + text * len(tail)
        to = np.arange(int(sums[-1])) + np.repeat(begin - sums[:-1], length)
        out[to] = flat[np.arange(int(sums[-1])) + np.repeat(start - sums[:-1], length)]
        for k, i in enumerate(tail):
            out[offsets[1:] - len(tail) + k] = i
        return out, offsets


class WordTable(ChunkTable):
    """A table of white-space separated words that finds those it keeps in numpy.

    A word is named by a 64-bit hash, its length and its first eight bytes; only
    words that are not in the table become Python objects.
    """

    SEED = 31

    def _start(self) -> None:
        super()._start()
        self.hasher = tb.Hasher(self.SEED)
        slots = 1 << (2 * self.most).bit_length()
        self.mask = np.uint64(slots - 1)
        self.keys = np.zeros(slots, np.uint64)  # 0: free
        self.place = np.zeros(slots, np.int32)
        self.head = np.zeros(1 << 14, np.uint64)
        self.size = np.zeros(1 << 14, np.int64)
        self.kept = 0

    def _find(self, h: np.ndarray, head: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The place of each word, or -1."""
        out, open_, slot = np.full(len(h), -1, np.int64), np.arange(len(h)), h & self.mask
        while len(open_):
            key = self.keys[slot]
            place = self.place[slot]
            same = (key == h[open_]) & (self.head[place] == head[open_]) & (self.size[place] == size[open_])
            out[open_[same]] = place[same]
            on = ~same & (key != 0)
            open_, slot = open_[on], (slot[on] + np.uint64(1)) & self.mask
        return out

    def _keep(self, h: np.ndarray, head: np.ndarray, size: np.ndarray) -> None:
        """Give the next places to words that are not in the table."""
        while self.kept + len(h) > len(self.head):
            self.head, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.head, self.size))
        new = np.arange(self.kept, self.kept + len(h))
        self.head[new], self.size[new] = head, size
        self.kept += len(h)
        slot = h & self.mask
        while len(h):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            taken = free[first]
            self.keys[slot[taken]], self.place[slot[taken]] = h[taken], new[taken]
            left = np.ones(len(h), bool)
            left[taken] = False
            h, new, slot = h[left], new[left], (slot[left] + np.uint64(1)) & self.mask

    def words(self, data: np.ndarray, offsets: np.ndarray, tail: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by text) of the words of texts given as bytes, each text followed by ``tail``."""
        if self.passing:
            self._back(*self.passing[1:])
            self.passing = None
        starts, ends, first = tb.word_bounds(data, offsets)
        size = ends - starts
        h = self.hasher.words(data, starts, ends)
        h[h == 0] = 1
        near = np.lib.stride_tricks.sliding_window_view(np.r_[data, np.zeros(8, np.uint8)], 8)[starts]
        head = np.ascontiguousarray(near).view("<u8").ravel() & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (8 - np.minimum(size, 8)).astype(np.uint64)))
        at = self._find(h, head, size)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            raw, known, rows, had = data.tobytes(), {}, [], self.count
            for i, a, b in zip(missing.tolist(), starts[missing].tolist(), ends[missing].tolist(), strict=True):
                place = known.setdefault(raw[a:b], had + len(known))
                if place == had + len(rows):
                    rows.append(i)
                at[i] = place
            fresh, marks = list(known), (self.count, self.used)
            full = self.kept + len(fresh) > self.most or self.held > self.most_bytes
            self._learn(fresh)
            if full:
                self.passing = (fresh, *marks)
            else:
                self._keep(h[rows], head[rows], size[rows])
                self.held += sum(map(len, fresh))
        return self.joined(np.diff(first), self.flat, self.start[at], self.length[at], tail)
