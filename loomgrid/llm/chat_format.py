"""Chat formatting by columnar byte assembly.

A turn becomes ``### role: text</turn>\\n``. Inside roles and texts a backslash
is doubled, every ``#`` of a run of three or more gets a backslash before it,
and ``</turn>`` becomes ``<\\/turn>``, so that no control string is left and
removing one backslash before any character restores the text. Roles also
escape ``:``. Segment lengths, cumulative offsets and scatter positions are
computed in numpy for a whole batch, and headers and contents are copied into
one preallocated Arrow buffer. The loss mask lists the contents of assistant
turns as (start, length) in code points.

Turns are range-partitioned by (conversation, turn), so a conversation with a
third of all rows is formatted by many tasks, in fragments of whole turns.
Reading back, fragments are parsed and unescaped where they lie; only the two
running hashes, sequential by nature, pass through a conversation in order, one
fragment in memory at a time.

Defined results: rows are ordered by turn, null first, ties by role, then text;
repeated rows count each; null role or text is empty; a null conv_id is one
conversation of its own; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .workspace import tune, write_table

# Fixed values of the template.
OPEN, AFTER_ROLE, CLOSE = b"### ", b": ", b"</turn>\n"
LOSS_ROLE = "assistant"
#: A fragment ends at the first turn beyond so many bytes.
FRAGMENT_BYTES = 1 << 20

FORMATTED = "conv_id long, fragment long, n_turns long, formatted string, loss_starts array<long>, loss_lengths array<long>"
_TURN = re.compile(r"### ((?:[^:\\]|\\.)*): (.*?)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def escape_marks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True for each byte that gets a backslash before it."""
    marks = data == 0x5C
    n = len(data)
    if n >= 3:
        hashes = data == 0x23
        if hashes.any():
            runs = np.zeros(n, bool)
            runs[:-2] = hashes[:-2] & hashes[1:-1] & hashes[2:]
            for back in (1, 2):  # a run must not reach into the next text
                at = offsets[1:] - back
                runs[at[at >= offsets[:-1]]] = False
            marks |= runs
            marks[1:] |= runs[:-1]
            marks[2:] |= runs[:-2]
    at = np.flatnonzero(data == 0x3C)
    at = at[at + 7 <= n]
    for k, byte in enumerate(b"</turn>"):
        at = at[data[at + k] == byte]
    if len(at):
        row_end = offsets[np.searchsorted(offsets, at, "right")]
        marks[at[at + 7 <= row_end] + 1] = True
    return marks


def _header(role: str | None) -> bytes:
    raw = np.frombuffer((role or "").encode(), np.uint8)
    marks = escape_marks(raw, np.array([0, len(raw)])) | (raw == 0x3A)
    return OPEN + np.insert(raw, np.flatnonzero(marks), 0x5C).tobytes() + AFTER_ROLE


def assemble(part: pa.RecordBatch) -> tuple[np.ndarray, pa.Buffer, np.ndarray, np.ndarray, np.ndarray]:
    """(code points before each byte, buffer, start of each turn and the end, start and end of each content)."""
    data, offsets = tb.column_bytes(part.column("text"))
    marks = escape_marks(data, offsets)
    lengths = np.diff(offsets)
    added = np.zeros(len(data) + 1, np.int64)
    np.cumsum(marks, out=added[1:])
    roles = part.column("role").dictionary_encode() if part.num_rows else part.column("role")
    kinds = [_header(r) for r in roles.dictionary.to_pylist()] + [_header(None)]
    code = roles.indices.fill_null(len(kinds) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
    head_lengths = np.array([len(h) for h in kinds])[code]
    content = lengths + added[offsets[1:]] - added[offsets[:-1]]
    turn = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(head_lengths + content + len(CLOSE), out=turn[1:])
    begin = turn[:-1] + head_lengths
    end = begin + content

    buffer = pa.allocate_buffer(int(turn[-1]))
    out = np.frombuffer(buffer, np.uint8)
    to = np.arange(len(data)) + added[1:] + np.repeat(begin - offsets[:-1] - added[offsets[:-1]], lengths)
    out[to] = data
    out[to[marks] - 1] = 0x5C
    for k, header in enumerate(kinds):
        rows = turn[:-1][code == k]
        out[rows[:, None] + np.arange(len(header))] = np.frombuffer(header, np.uint8)
    out[end[:, None] + np.arange(len(CLOSE))] = np.frombuffer(CLOSE, np.uint8)
    chars = np.zeros(len(out) + 1, np.int64)
    np.cumsum((out & 0xC0) != 0x80, out=chars[1:])
    return chars, buffer, turn, begin, end


def format_conversations(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) to formatted fragments; fragments of a conversation are in order of ``fragment``."""
    tune(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for part in tb.slices(batches, most=4 << 20):
            chars, buffer, turn, begin, end = assemble(part)
            ids = part.column("conv_id")
            key = ids.fill_null(0).to_numpy(zero_copy_only=False)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            new = np.r_[True, (key[1:] != key[:-1]) | (null[1:] != null[:-1])]
            new |= np.r_[True, (turn[1:-1] // FRAGMENT_BYTES) != (turn[:-2] // FRAGMENT_BYTES)]
            first = np.flatnonzero(new)
            last = np.r_[first[1:], len(key)]
            loss = np.array([r == LOSS_ROLE for r in part.column("role").to_pylist()], bool)
            of = np.searchsorted(first, np.flatnonzero(loss), "right") - 1
            counts = np.r_[0, np.cumsum(np.bincount(of, minlength=len(first)))]
            starts = chars[begin[loss]] - chars[turn[first]][of]
            where = np.r_[turn[first], turn[-1]].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(first)),
                    pa.array(number + np.arange(len(first))),
                    pa.array(last - first),
                    pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(where), buffer]),
                    pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(starts)),
                    pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(chars[end[loss]] - chars[begin[loss]])),
                ],
                names=["conv_id", "fragment", "n_turns", "formatted", "loss_starts", "loss_lengths"],
            )
            number += len(first)

    rows = turns.selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "cast(role as string) role", "cast(text as string) text")
    parted = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    return parted.select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted fragment."""
    out, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError("not a formatted conversation")
        out.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return out


def read_turns(formatted: DataFrame) -> DataFrame:
    """Formatted fragments back to rows (conv_id, fragment, turn within the fragment, role, text)."""

    def run(batches):
        for batch in batches:
            rows = [(c, f, i, role, text) for c, f, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True) for i, (role, text) in enumerate(parse(x))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["conv_id", "fragment", "turn", "role", "text"])

    return formatted.select("conv_id", "fragment", "formatted").mapInArrow(run, "conv_id long, fragment long, turn long, role string, text string")


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_READ = "conv_id long, fragment long, n_turns long, turns binary, loss_chars long, loss binary, formatted_chars long"


def _read_fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parsed and unescaped fragments: what the digests of a conversation are taken of."""
    for batch in batches:
        rows = []
        for text, starts, lengths in zip(*(batch.column(n).to_pylist() for n in ("formatted", "loss_starts", "loss_lengths")), strict=True):
            turns = parse(text)
            loss = "".join([unescape(text[a : a + n]) for a, n in zip(starts, lengths, strict=True)])
            rows.append((len(turns), "".join([f"{role}\n{said}\n" for role, said in turns]).encode(), len(loss), loss.encode(), len(text)))
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("fragment"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names=[x.split()[0] for x in _READ.split(", ")])


def digest(formatted: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its formatted fragments."""

    def run(batches: Iterator[pa.RecordBatch]):
        state = None  # conv_id, turns, hash of turns, loss characters, hash of loss, formatted characters

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        def row():
            return (state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5])

        for batch in batches:
            rows = []
            for conv, n, turns, chars, loss, size in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "n_turns", "turns", "loss_chars", "loss", "formatted_chars")), strict=True):
                if state is None or state[0] != conv:
                    if state:
                        rows.append(row())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += n
                state[2].update(turns)
                state[3] += chars
                state[4].update(loss)
                state[5] += size
            yield batch_of(rows)
        if state:
            yield batch_of([row()])

    read = formatted.select("conv_id", "fragment", "formatted", "loss_starts", "loss_lengths").mapInArrow(_read_fragments, _READ)
    return read.repartition("conv_id").sortWithinPartitions("conv_id", "fragment").mapInArrow(run, DIGESTS)


def with_example(turns: DataFrame) -> DataFrame:
    """The conversations plus conversation -7, whose texts hold control strings."""
    said = r"\### Assistant: </turn> ok"
    more = turns.sparkSession.range(1).select(F.inline(F.array(*(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text")) for i, role in enumerate(("user", "assistant"))))))
    return turns.select("conv_id", "turn", "role", "text").unionByName(more)


def format_and_read_back(turns: DataFrame) -> DataFrame:
    """Format all conversations into a written table and digest what is read from it."""
    written, _ = write_table(format_conversations(turns), "chat")
    return digest(written)
