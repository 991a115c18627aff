"""Fill-in-the-middle rearrangement of whole texts, cut at the borders of units.

A text is cut into units by a predicate on two adjacent characters: a unit
begins where the predicate holds. Bytes are divided into chunks that overlap by
one character, so each border is seen by one chunk alone. All chunks of a slice
of documents count their borders side by side; prefix sums over the counts say
which chunk owns the border of a given rank, and only the owning chunks are
scanned again for its place. No list of borders is ever made.

Cuts and forms come from the SHA-256 of seed and doc_id, so they don't depend on
partitions or retries.

Defined results: a null text is empty; an empty text, and one that holds a mark,
stays plain; equal rows get equal results; rows without a doc_id are hashed as
``seed:``; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .workspace import tune

MARKS, SEED, RATE, SPM_RATE = ("<P>", "<S>", "<M>"), 7, 100, 50
#: Bytes of a chunk without its overlap, and chunks whose borders are looked for at once.
CHUNK, _AT_ONCE = 4096, 256
_HEADS = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a character
_ANY, _LINE = np.ones(256, bool), np.arange(256) == 0x0A
#: A unit begins between two bytes that these tables allow: lines, words with the white space behind them, characters.
UNITS = {"lines": (_LINE, _ANY), "words": (tb.SPACE, ~tb.SPACE & _HEADS), "chars": (_ANY, _HEADS)}
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Chunks:
    """The borders of units in texts that lie one after the other in ``data``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, units: str, size: int = CHUNK):
        self.data, self.offsets = data, offsets
        self.before, self.after = UNITS[units]
        n = -(-np.diff(offsets) // size)
        self.first = np.r_[0, np.cumsum(n)]  # chunk of each text
        self.start = np.repeat(offsets[:-1], n) + size * (np.arange(self.first[-1]) - np.repeat(self.first[:-1], n))
        self.end = np.minimum(self.start + size, np.repeat(offsets[1:], n))
        self.head = np.zeros(len(self.start), bool)  # the first of its text has nothing to its left
        self.head[self.first[:-1][n > 0]] = True
        self.sums = np.r_[0, np.cumsum(self._counts())]

    def _borders(self, a: int, b: int) -> np.ndarray:
        """Whether a unit begins at each byte from a on; the byte before a is the overlap."""
        out = np.empty(b - a, bool)
        out[1:] = self.before[self.data[a : b - 1]]
        out[0] = a > 0 and self.before[self.data[a - 1]]
        return out & self.after[self.data[a:b]]

    def _counts(self) -> np.ndarray:
        out = np.zeros(len(self.start), np.int64)
        for k in range(0, len(out), _AT_ONCE):
            a, b = int(self.start[k]), int(self.end[min(k + _AT_ONCE, len(out)) - 1])
            found = self._borders(a, b)
            found[self.start[k : k + _AT_ONCE][self.head[k : k + _AT_ONCE]] - a] = False
            out[k : k + _AT_ONCE] = np.add.reduceat(found, self.start[k : k + _AT_ONCE] - a, dtype=np.int64)
        return out

    def units(self) -> np.ndarray:
        """Number of units of each text."""
        return self.sums[self.first[1:]] - self.sums[self.first[:-1]] + (np.diff(self.offsets) > 0)

    def places(self, rank: np.ndarray) -> np.ndarray:
        """Where the first ``rank`` units of each text end, as an offset in ``data``."""
        inner = (rank > 0) & (rank < self.units())
        out = np.where(rank > 0, self.offsets[1:], self.offsets[:-1])
        wanted = self.sums[self.first[:-1]] + rank
        owner = np.searchsorted(self.sums, wanted, "left") - 1
        for row in np.flatnonzero(inner).tolist():
            k = int(owner[row])
            found = self._borders(int(self.start[k]), int(self.end[k]))
            found[0] &= not self.head[k]
            out[row] = self.start[k] + np.flatnonzero(found)[wanted[row] - self.sums[k] - 1]
        return out


def _check(marks: tuple[str, str, str]) -> None:
    heads = {m[:1] for m in marks}
    if len(set(marks)) < 3 or "" in marks or any(c in heads for m in marks for c in m[1:]):
        raise ValueError("the three marks must differ, and what a mark begins with must not stand further inside of one")


def rearranged(docs: DataFrame, units: str = "lines", marks: tuple[str, str, str] = MARKS, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars and output of every document.

    ``rate`` percent of the texts are rearranged, ``spm_rate`` percent of these
    with the suffix in front; ``marks`` stand before prefix, suffix and middle.
    """
    tune(docs.sparkSession)
    _check(marks)
    p, s, m = (x.encode() for x in marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches):
            data, offsets = tb.column_bytes(batch.column("text"))
            h1, h2, h3, h4 = (batch.column(f"h{i}").to_numpy() for i in (1, 2, 3, 4))
            parts = Chunks(data, offsets, units, chunk)
            n = parts.units()
            a, b = h1 % (n + 1), h2 % (n + 1)
            raw, held = data.tobytes(), np.zeros(len(n), bool)
            for mark in (p, s, m):
                at = raw.find(mark)
                while at >= 0:
                    row = int(np.searchsorted(offsets, at, "right")) - 1
                    held[row] |= at + len(mark) <= offsets[row + 1]
                    at = raw.find(mark, at + 1)
            plain = held | (n == 0) | (h3 % 100 >= rate)
            suffix_first = h4 % 100 < spm_rate
            x, y = (parts.places(np.where(plain, 0, f(a, b))) for f in (np.minimum, np.maximum))
            heads = np.r_[0, np.cumsum(_HEADS[data])]
            out = []
            for row, (i, u, v, j) in enumerate(zip(offsets[:-1].tolist(), x.tolist(), y.tolist(), offsets[1:].tolist(), strict=True)):
                if plain[row]:
                    out.append(raw[i:j])
                elif suffix_first[row]:
                    out.append(b"".join((s, raw[v:j], p, raw[i:u], m, raw[u:v])))
                else:
                    out.append(b"".join((p, raw[i:u], s, raw[v:j], m, raw[u:v])))
            form = np.where(plain, "plain", np.where(suffix_first, "spm", "psm"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(form.tolist(), pa.string()), pa.array(heads[x] - heads[offsets[:-1]], pa.int64(), mask=plain), pa.array(heads[y] - heads[x], pa.int64(), mask=plain), pa.array(out, pa.binary()).cast(pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    doc_id = F.col("doc_id").cast("long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    hashed = docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"), digest.alias("digest"))
    group = lambda i: F.conv(F.substring("digest", 8 * i - 7, 8), 16, 10).cast("long").alias(f"h{i}")
    return hashed.select("doc_id", "text", *(group(i) for i in (1, 2, 3, 4))).mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text again, from output and form alone: each mark stands once in a rearranged output."""
    p, s, m = (F.lit(x) for x in marks)
    prefix, suffix = F.split_part(F.split_part(output, p, F.lit(2)), F.when(form == "psm", s).otherwise(m), F.lit(1)), F.split_part(F.split_part(output, s, F.lit(2)), F.when(form == "psm", m).otherwise(p), F.lit(1))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, F.split_part(output, m, F.lit(2)), suffix))


def report(docs: DataFrame) -> DataFrame:
    """Counts and digests of rearranged() with its defaults, and of the texts restored from it."""
    out = rearranged(docs)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
