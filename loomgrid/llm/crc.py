"""CRC-32 of many strings at once in numpy, and of strings put together, by its algebra.

CRC-32 is linear over GF(2): appending n zero bytes to a message multiplies its
CRC by a 32 x 32 bit matrix that depends on n alone. With these matrices
crc(a + b) = shift(crc(a), len(b)) ^ crc(b), so the CRC of a sequence of strings
follows from those of its parts, and no sequence has to be put together.
"""

from __future__ import annotations

import zlib

import numpy as np

#: The polynomial of CRC-32, lowest power first.
POLYNOMIAL = 0xEDB88320
#: Longer strings than this go to zlib one by one.
_LONG = 64


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), c >> np.uint32(1))
    return c


TABLE = _byte_table()


def _apply(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Matrix (its columns as 32 integers, as tables of a byte each) times vectors."""
    return matrix[0][x & 255] ^ matrix[1][(x >> np.uint32(8)) & 255] ^ matrix[2][(x >> np.uint32(16)) & 255] ^ matrix[3][x >> np.uint32(24)]


def _tables(columns: np.ndarray) -> np.ndarray:
    """Four tables of 256 products, one for each byte of a vector."""
    out = np.zeros((4, 256), np.uint32)
    values = np.arange(256)
    for bit in range(32):
        out[bit // 8] ^= np.where(values >> (bit % 8) & 1, columns[bit], np.uint32(0))
    return out


class Shifts:
    """The matrices for 1, 2, 4 ... zero bytes; any number of bytes is a product of them."""

    def __init__(self):
        unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
        self.columns = [TABLE[unit & 255] ^ (unit >> np.uint32(8))]
        self.tables = [_tables(self.columns[0])]

    def power(self, k: int) -> np.ndarray:
        while len(self.tables) <= k:
            self.columns.append(_apply(self.tables[-1], self.columns[-1]))
            self.tables.append(_tables(self.columns[-1]))
        return self.tables[k]

    def __call__(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        """CRCs moved on by ``n`` bytes each."""
        out = crc.copy()
        for k in range(int(n.max()).bit_length() if len(n) else 0):
            at = np.flatnonzero(n >> k & 1)
            out[at] = _apply(self.power(k), out[at])
        return out


shift = Shifts()


def combine(a: np.ndarray, b: np.ndarray, length_b: np.ndarray) -> np.ndarray:
    """CRCs of the strings a + b."""
    return shift(a, length_b) ^ b


def words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each data[start:end]: all strings advance a byte at a time, longest first, so that those left are a prefix."""
    size = ends - starts
    short = np.minimum(size, _LONG + 1)
    order = np.argsort(-short.astype(np.int8), kind="stable")
    left = len(size) - np.searchsorted(short[order][::-1], np.arange(1, _LONG + 1), "left")  # strings of that many bytes at least
    at, state = starts[order], np.full(len(size), 0xFFFFFFFF, np.uint32)
    for i, n in enumerate(left.tolist()):
        if not n:
            break
        s = state[:n]
        state[:n] = TABLE[(s ^ data[at[:n] + i]) & 255] ^ (s >> np.uint32(8))
    out = np.empty(len(size), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(size > _LONG).tolist():
        out[k] = zlib.crc32(data[starts[k] : ends[k]])
    return out


_SPACE = np.uint32(zlib.crc32(b" "))


def ngrams(crc: np.ndarray, length: np.ndarray, first: np.ndarray, n: int):
    """For each size up to ``n``: (size, row, CRC) of the runs of so many words of a row, joined by one space.

    ``crc`` and ``length`` (bytes) are of the words; ``first``: first word of each row and the total.
    """
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    last = first[1:][row] if len(row) else row  # behind the words of the row
    yield 1, row, crc
    if n < 2:
        return
    spaced, at, now = combine(np.full(len(crc), _SPACE), crc, length), np.arange(len(crc)), crc  # of a space and the word
    for size in range(2, n + 1):
        on = at + size - 1 < last[at]
        at, now = at[on], now[on]
        end = at + size - 1
        now = shift(now, length[end] + 1) ^ spaced[end]
        yield size, row[at], now
