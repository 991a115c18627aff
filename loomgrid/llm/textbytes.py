"""Words, shingles and hashes of whole Arrow string columns, in numpy.

All functions work on the column's UTF-8 bytes at once; nothing loops over rows
or words in Python. Hashes are 64-bit polynomials modulo 2**64 over a table of
random odd byte codes with a final mix; operators that decide equality by hash
use two of them with different seeds (128 bits).
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: [\x20\x09-\x0D], the bytes between words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Words above so many bytes are hashed on their own: the polynomial is weak on very long, regular ones.
LONG_WORD = 255

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give freed memory and kept powers back to the system: a Python worker runs tasks of many operators, one after the other."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without a copy; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` has about ``most`` bytes in each; a longer row stands alone."""
    release()
    for batch in batches:
        _, off = column_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    release()


def word_bounds(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and the total) of the maximal runs of non-space bytes in each row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~space[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, word[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse, i < n, modulo 2**64."""
    got = _POWERS.get(base)
    if got is None or len(got[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        both = []
        for r in (base, pow(base, -1, 1 << 64)):
            out = np.ones(size, np.uint64)
            have = 1
            while have < size:
                out[have : 2 * have] = out[:have] * np.uint64(pow(r, have, 1 << 64))
                have *= 2
            both.append(out)
        got = _POWERS[base] = (both[0], both[1])
    return got[0][:n], got[1][:n]


class Hasher:
    """A seeded family of word and window hashes."""

    def __init__(self, seed: int):
        raw = hashlib.blake2b(b"loomgrid", salt=seed.to_bytes(8, "little"), digest_size=16).digest()
        self.seed = seed
        self.byte_base = int.from_bytes(raw[:8], "little") | 5
        self.word_base = int.from_bytes(raw[8:], "little") | 3
        self.codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(self.byte_base)) | np.uint64(1)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.uint64)
        up, down = _powers(self.byte_base, len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.codes[data] * up[:-1], out=sums[1:])
        out = mix((sums[ends] - sums[starts]) * down[starts])
        for i in np.flatnonzero(ends - starts > LONG_WORD):
            out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), salt=self.seed.to_bytes(8, "little"), digest_size=8).digest(), "little")
        return out

    def windows(self, words: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the windows of ``size`` words that start at each word; len(words) - size + 1 of them."""
        n = len(words) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        up, down = _powers(self.word_base, len(words) + 1)
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[:-1], out=sums[1:])
        return mix((sums[size:] - sums[:n]) * down[:n] + np.uint64(size))


def window_rows(first_word: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, global word index) of every window of ``size`` words that lies within one row."""
    counts = np.maximum(np.diff(first_word) - size + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first_word[:-1], counts)
    return rows, at


def char_offsets(data: bytes, at: list[int]) -> list[int]:
    """Code points before each byte offset of ascending ``at``."""
    out, last, chars = [], 0, 0
    for x in at:
        chars += len(data[last:x].decode("utf-8", "replace"))
        last = x
        out.append(chars)
    return out
