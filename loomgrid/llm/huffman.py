"""Canonical, length-limited Huffman codes over integer symbols, in numpy.

Lengths come from package-merge, codes from lengths alone. Symbols are written
most significant bit first in blocks of ``BLOCK`` symbols; the bit offset of
each block is a checkpoint, so blocks are decoded side by side by one table.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
#: Longest code; the decoding table has two to this power entries, and with 7 more bits it must fit 32.
LIMIT = 18


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """The optimal lengths of at most ``limit`` bits; 0 for symbols that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need codes of over {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    # Level by level: single symbols merged with pairs of the level below; a pair is remembered as how many of the items below it takes.
    levels, below = [], np.zeros(0)
    for _ in range(limit):
        pairs = below[: len(below) // 2 * 2].reshape(-1, 2).sum(axis=1)
        items = np.concatenate([weight, pairs])
        rank = np.argsort(items, kind="stable")
        levels.append(rank < n)
        below = items[rank]
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for single in reversed(levels):
        chosen = single[:take]
        k = int(chosen.sum())
        lengths[:k] += 1
        take = 2 * (take - k)
    out[order] = lengths
    return out


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: by length, then symbol."""
    out = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    if len(used):
        order = used[np.lexsort((used, lengths[used]))]
        width = lengths[order].astype(np.int64)
        top = int(width.max())
        step = np.left_shift(1, top - width)
        first = np.cumsum(step) - step
        out[order] = first >> (top - width)
    return out


def encode(symbols: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bits, bit offset of each block)."""
    n = len(symbols)
    if not n:
        return b"", np.zeros(0, np.uint64)
    width = lengths[symbols].astype(np.int64)
    end = np.cumsum(width)
    at = end - width
    word, inside = at >> 5, at & 31
    value = codes[symbols].astype(np.uint64) << (64 - width - inside).astype(np.uint64)
    head = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    out = np.zeros((int(end[-1]) >> 5) + 2, np.uint32)
    out[word[head]] = np.bitwise_or.reduceat(value >> np.uint64(32), head).astype(np.uint32)
    last = np.r_[head[1:], n] - 1
    out[word[last] + 1] |= (value[last] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out.astype(">u4").tobytes()[: (int(end[-1]) + 7) // 8], at[::BLOCK].astype(np.uint64)


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbol, width) by the next ``bits`` bits, and bits."""
    used = np.flatnonzero(lengths)
    if not len(used):
        return np.zeros(1, np.int32), np.ones(1, np.int64), 0
    order = used[np.lexsort((used, lengths[used]))]
    width = lengths[order].astype(np.int64)
    bits = int(width.max())
    times = np.left_shift(1, bits - width)
    symbol, wide = np.repeat(order, times).astype(np.int32), np.repeat(width, times)
    rest = (1 << bits) - len(symbol)  # only a code of one symbol leaves some
    return np.r_[symbol, np.zeros(rest, np.int32)], np.r_[wide, np.ones(rest, np.int64)], bits


def decode(raw: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The first ``n`` symbols from the blocks that begin at ``checkpoints``, all blocks step by step together."""
    if not n:
        return np.zeros(0, np.int32)
    symbol, width, bits = table
    data = np.frombuffer(raw + bytes(8), np.uint8).astype(np.uint32)
    window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    blocks = len(checkpoints)
    out = np.empty((BLOCK, blocks), np.int32)
    at = checkpoints.astype(np.int64)
    mask, last = np.uint32((1 << bits) - 1), len(window) - 1
    for step in range(BLOCK):
        live = blocks if step < n - (blocks - 1) * BLOCK else blocks - 1  # the last block may be short
        if not live:
            break
        p = at[:live]
        key = window[np.minimum(p >> 3, last)] >> (32 - bits - (p & 7)).astype(np.uint32) & mask
        out[step, :live] = symbol[key]
        at[:live] += width[key]
    return out.T.ravel()[:n]
