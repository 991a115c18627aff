"""Best-fit packing: documents as token ids into sequences of a fixed capacity.

1. Texts are encoded; only documents above the capacity are cut, into pieces of
   the capacity and a shorter last one. Each task writes its pieces into one file
   (Arrow, zstd) of the shared folder and reports their counts by length.
2. The histogram of lengths has one number for each length up to the capacity,
   whatever the size of the corpus. Best fit runs over these counts, longest
   first: all pieces of a length that go into sequences with the same room left
   are one step, and the plan is a table of runs of ranks within a length, whose
   size depends on the capacity alone.
3. Ranks of a file start where those of earlier files end; the pieces are read
   with their ranks and take their slots by joining with the plan on length and
   rank. So the ids are shuffled once:
4. pieces meet in their sequence, which holds at most ``capacity`` ids.

A file counts when the manifest names it, so files of failed or repeated tasks
are never read.

Defined results: a null or empty text is the end id alone; repeated rows and
rows without a doc_id are packed like any other; an empty table gives no
sequences; other columns are ignored; which of several pieces of equal length
takes which slot is open.
"""

from __future__ import annotations

import bisect
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .media import store
from .tokenizing import encoder, id_bytes
from .workspace import new_path, tune, write_table

CAPACITY, END_ID = 4096, 1
MANIFEST = "path string, lengths array<long>, counts array<long>"
PIECES = "rank long, doc_id long, piece int, start long, length long, ids binary"
SEQUENCES = "sequence_id long, ids array<int>, segments array<struct<doc_id: long, piece: int, start: long, length: long, offset: long>>"
REPORT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_RUNS = ["length", "first", "last", "sequence", "per", "offset"]


def plan(counts: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over ``counts`` of pieces by length (index 0 to the capacity).

    A run (length, first, last, sequence, per, offset) places the pieces of this
    length with ranks first to last - 1: rank first + i goes into the sequence
    ``sequence + i // per`` at ``offset + i % per * length``. What is filled up to
    the same point is one class, so the number of runs depends on the capacity,
    not on the number of pieces.
    """
    capacity = len(counts) - 1
    room: dict[int, list[tuple[int, int]]] = {}  # room left to intervals (first sequence, number) of sequences
    rooms: list[int] = []  # those with any, ascending
    runs, fresh = [], 0

    def leave(r: int, first: int, n: int) -> None:
        if r and n:
            if r not in room:
                room[r] = []
                bisect.insort(rooms, r)
            room[r].append((first, n))

    for length in range(capacity, 0, -1):
        todo, rank = int(counts[length]), 0
        while todo:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                r = rooms[i]
                first, n = room[r].pop()
                if not room[r]:
                    del room[r], rooms[i]
            else:
                r, first, n = capacity, fresh, -(-todo // (capacity // length))
                fresh += n
            per = r // length
            full = min(n, todo // per)
            if full:
                runs.append((length, rank, rank + full * per, first, per, capacity - r))
                rank, todo = rank + full * per, todo - full * per
                leave(r - per * length, first, full)
            if full < n and todo:
                rest = min(todo, per)  # of the last sequence of this length
                runs.append((length, rank, rank + rest, first + full, rest, capacity - r))
                rank, todo = rank + rest, todo - rest
                leave(r - rest * length, first + full, 1)
                full += 1
            leave(r, first + full, n - full)
    return runs


def _occurrence(values: np.ndarray) -> np.ndarray:
    """How many equal values stand before each one."""
    order = np.argsort(values, kind="stable")
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(values)) - np.searchsorted(values[order], values[order])
    return out


def _write_pieces(folder: str, tokenizer_path: str, capacity: int, end_id: int, wide: int):
    """Texts to a file of pieces for each task, and its row of the manifest."""

    def pieces(batch: pa.RecordBatch, encode) -> tuple[pa.RecordBatch, np.ndarray]:
        ids, offsets = encode.column(batch.column("text"), (end_id,))
        size = np.diff(offsets)
        n = -(-size // capacity)
        row = np.repeat(np.arange(len(size)), n)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        start = piece * capacity
        length = np.minimum(size[row] - start, capacity)
        edge = wide * np.r_[0, np.cumsum(length)]
        raw = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids.astype(f"<u{wide}")))])
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), raw], names=["doc_id", "piece", "start", "length", "ids"]), length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, counts, out = encoder(tokenizer_path), np.zeros(capacity + 1, np.int64), None
        fs, base = store(folder)
        path = f"{uuid.uuid4().hex}.arrow"
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/{path}") as sink:
            for batch in tb.slices(batches):
                made, length = pieces(batch, encode)
                counts += np.bincount(length, minlength=capacity + 1)
                out = out or pa.ipc.new_stream(sink, made.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                out.write_batch(made)
            if out:
                out.close()
        if out:
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([seen], pa.list_(pa.int64())), pa.array([counts[seen]], pa.list_(pa.int64()))], names=["path", "lengths", "counts"])

    return run


def _read_pieces(folder: str, capacity: int):
    """Files with the first rank of each of their lengths to rows of PIECES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(folder)
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                seen = np.zeros(capacity + 1, np.int64)
                for x in first:
                    seen[x["length"]] = x["base"]
                with fs.open_input_stream(f"{base}/{path}") as source, pa.ipc.open_stream(source) as pieces:
                    for part in pieces:
                        length = part.column("length").to_numpy()
                        yield pa.RecordBatch.from_arrays([pa.array(seen[length] + _occurrence(length)), *part.columns], names=["rank", *part.schema.names])
                        seen += np.bincount(length, minlength=capacity + 1)

    return run


def _plan_table(spark: SparkSession, counts: DataFrame, capacity: int) -> DataFrame:
    found = counts.groupBy("length").agg(F.sum("n").alias("n")).toPandas()  # a row for each length up to the capacity
    histogram = np.zeros(capacity + 1, np.int64)
    histogram[found["length"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return spark.createDataFrame(pd.DataFrame(plan(histogram), columns=_RUNS), ", ".join(f"{c} long" for c in _RUNS))


def _gather(wide: int):
    """Pieces sorted by (sequence_id, offset) to rows of SEQUENCES. Only the last sequence of a batch waits for the next one."""

    def sequences(batch: pa.RecordBatch) -> pa.RecordBatch:
        of = batch.column("sequence_id").to_numpy()
        heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        edge = np.r_[heads, len(of)].astype(np.int32)
        data, off = tb.column_bytes(batch.column("ids"))
        ids = np.frombuffer(data.tobytes(), f"<u{wide}").astype(np.int32)
        segments = pa.StructArray.from_arrays([batch.column(c) for c in ("doc_id", "piece", "start", "length", "offset")], names=["doc_id", "piece", "start", "length", "offset"])
        return pa.RecordBatch.from_arrays([pa.array(of[heads]), pa.ListArray.from_arrays(pa.array((off[edge] // wide).astype(np.int32)), pa.array(ids)), pa.ListArray.from_arrays(pa.array(edge), segments)], names=["sequence_id", "ids", "segments"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in tb.slices(batches, "ids"):
            of = batch.column("sequence_id").to_numpy()
            last = int(np.searchsorted(of, of[-1]))
            if last or held and held[-1].column("sequence_id")[-1].as_py() != int(of[0]):
                yield sequences(_joined([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield sequences(_joined(held))

    return run


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Documents (doc_id, text) to sequences: sequence_id (0, 1, 2 ...), ids (at most ``capacity``) and the segments that stand in them without gaps."""
    spark = tune(docs.sparkSession)
    wide, folder = id_bytes(tokenizer_path, end_id), new_path(spark, "pieces")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    files, _ = write_table(rows.mapInArrow(_write_pieces(folder, tokenizer_path, capacity, end_id, wide), MANIFEST), "manifest")
    counts = files.select("path", F.explode(F.arrays_zip("lengths", "counts")).alias("x")).select("path", F.col("x.lengths").alias("length"), F.col("x.counts").alias("n"))
    base = F.sum("n").over(Window.partitionBy("length").orderBy("path")) - F.col("n")
    placed, _ = write_table(counts.withColumn("base", base).groupBy("path").agg(F.collect_list(F.struct("length", "base")).alias("first")), "bases")  # a row for each file
    spread = placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    slots = spread.mapInArrow(_read_pieces(folder, capacity), PIECES).join(F.broadcast(_plan_table(spark, counts, capacity)), "length")  # the capacity bounds the plan
    slots = slots.where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    slots = slots.selectExpr("sequence + (rank - first) div per AS sequence_id", "offset + (rank - first) % per * length AS offset", "doc_id", "piece", "start", "length", "ids")
    return slots.repartition("sequence_id").sortWithinPartitions("sequence_id", "offset").mapInArrow(_gather(wide), SEQUENCES)


def pieces_of(sequences: DataFrame) -> DataFrame:
    """One row for each piece of packed sequences, with the CRC-32 of its ids as they stand there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, segments = batch.column("ids"), batch.column("segments")
            of = np.repeat(np.arange(batch.num_rows), np.diff(segments.offsets.to_numpy()))
            doc_id, piece, start, length, offset = segments.flatten().flatten()
            raw = memoryview(np.ascontiguousarray(lists.flatten().to_numpy().astype("<u4"))).cast("B")
            begin = 4 * (lists.offsets.to_numpy()[:-1].astype(np.int64)[of] - lists.offsets[0].as_py() + offset.to_numpy())
            crcs = [zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), (begin + 4 * length.to_numpy()).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([doc_id, piece, start, length, pa.array(crcs, pa.int64()), batch.column("sequence_id").take(pa.array(of)), offset], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return sequences.mapInArrow(run, REPORT)
