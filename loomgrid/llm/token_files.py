"""Token ids in binary files: canonical length-limited Huffman blocks, written in order of doc_id.

1. Texts are range-partitioned and sorted by doc_id and encoded; each task writes
   its ids as raw pieces into the shared folder, with the counts of its ids.
2. The summed counts (one number for each id of the vocabulary) give one code.
3. Each piece becomes a file ``.hids``: a header, the document table, the bit
   offsets of blocks of 1,024 ids, and the bits. ``codebook.bin`` has the code
   lengths. Reading decodes the blocks of a file side by side from one table.

A file counts when the manifest names it, so files of failed or repeated tasks
are never read. Files are read independently of each other.

Defined results: null or empty texts are the end id alone; documents with equal
doc_id are in order of a hash of their text, exact repetitions one after the
other; a null doc_id comes first; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import huffman
from . import textbytes as tb
from .media import store
from .tokenizing import WordEncoder, encoder  # noqa: F401
from .workspace import new_path, remove, tune, write_table

END_ID = 2
MAGIC = b"HIDS\1\0\0\0"
#: A piece, and so a file, ends at the first document beyond so many ids.
PIECE_IDS = 2 << 20
_PIECE = "part long, seq long, path string, n_docs long, n_ids long, ids array<int>, counts array<long>"


def _pack(array: np.ndarray) -> bytes:
    raw = zlib.compress(array.tobytes(), 1)
    return struct.pack("<I", len(raw)) + raw


def _unpack(raw: bytes, at: int, kind: str) -> tuple[np.ndarray, int]:
    n = struct.unpack("<I", raw[at : at + 4])[0]
    return np.frombuffer(zlib.decompress(raw[at + 4 : at + 4 + n]), kind), at + 4 + n


def _put(folder: str, name: str, raw: bytes) -> None:
    fs, base = store(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/{name}") as out:
        out.write(raw)


def _get(folder: str, name: str) -> bytes:
    fs, base = store(folder)
    with fs.open_input_stream(f"{base}/{name}") as f:
        return f.read()


def _pieces(folder: str, tokenizer_path: str):
    """Sorted texts to raw pieces: a row for each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        encode = encoder(tokenizer_path)
        held: list[tuple] = []

        def flush():
            nonlocal seq, held
            doc, null, n, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            name = f"{part:08d}-{seq:06d}-{uuid.uuid4().hex}.raw"
            wide = "<u2" if int(ids.max()) < 1 << 16 else "<u4"
            _put(folder, name, struct.pack("<B", int(wide[-1])) + _pack(doc) + _pack(null) + _pack(n) + _pack(ids.astype(wide)))
            counts = np.bincount(ids)
            seen = np.flatnonzero(counts)
            row = pa.RecordBatch.from_arrays([pa.array([part]), pa.array([seq]), pa.array([name]), pa.array([len(doc)]), pa.array([len(ids)]), pa.array([seen.astype(np.int32)], pa.list_(pa.int32())), pa.array([counts[seen]], pa.list_(pa.int64()))], names=[x.split()[0] for x in _PIECE.split(", ")])
            seq, held = seq + 1, []
            return row

        for batch in tb.slices(batches):
            ids, offsets = encode.column(batch.column("text"), (END_ID,))
            docs = batch.column("doc_id")
            held.append((docs.fill_null(0).to_numpy(zero_copy_only=False), docs.is_null().to_numpy(zero_copy_only=False), np.diff(offsets).astype(np.int64), ids))
            if sum(len(x[3]) for x in held) >= PIECE_IDS:
                yield flush()
        if held:
            yield flush()

    return run


def _files(raw_folder: str, folder: str, lengths: np.ndarray):
    """Raw pieces to Huffman files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = huffman.codes_of(lengths)
        for batch in batches:
            names = []
            for path in batch.column("path").to_pylist():
                raw = _get(raw_folder, path)
                doc, at = _unpack(raw, 1, "<i8")
                null, at = _unpack(raw, at, "?")
                n, at = _unpack(raw, at, "<i8")
                ids, _ = _unpack(raw, at, f"<u{raw[0]}")
                bits, checkpoints = huffman.encode(ids, lengths, codes)
                body = b"".join([MAGIC, struct.pack("<QQ", len(doc), len(ids)), _pack(doc), _pack(null), _pack(n.astype("<u4")), _pack(np.diff(checkpoints, prepend=np.uint64(0)).astype("<u4")), struct.pack("<I", zlib.crc32(bits)), bits])
                names.append(f"{path.rsplit('-', 1)[0]}-{uuid.uuid4().hex}.hids")
                _put(folder, names[-1], body)
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("seq"), pa.array(names, pa.string()), batch.column("n_docs"), batch.column("n_ids")], names=["part", "seq", "path", "n_docs", "n_ids"])

    return run


def read_file(folder: str, name: str, table) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc_ids, ids of each document, ids) of one file."""
    raw = _get(folder, name)
    if raw[:8] != MAGIC:
        raise ValueError(f"{name}: not a file of this format")
    n_docs, n_ids = struct.unpack("<QQ", raw[8:24])
    doc, at = _unpack(raw, 24, "<i8")
    null, at = _unpack(raw, at, "?")
    n, at = _unpack(raw, at, "<u4")
    steps, at = _unpack(raw, at, "<u4")
    bits = raw[at + 4 :]
    if zlib.crc32(bits) != struct.unpack("<I", raw[at : at + 4])[0] or len(doc) != n_docs:
        raise ValueError(f"{name}: damaged")
    ids = huffman.decode(bits, np.cumsum(steps.astype(np.uint64)), n_ids, table)
    return [None if x else d for d, x in zip(doc.tolist(), null.tolist(), strict=True)], n.astype(np.int64), ids


def _tasks(spark: SparkSession) -> int:
    """Tasks for rows that each stand for a file: too few bytes for Spark to see the work in them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into ``folder``; returns the manifest (part, seq, path, n_docs, n_ids, start)."""
    spark = tune(docs.sparkSession)
    raw_folder = new_path(spark, "raw-ids")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("k"))
    placed = rows.repartitionByRange("doc_id", "k").sortWithinPartitions("doc_id", "k").select("doc_id", "text")
    pieces, _ = write_table(placed.mapInArrow(_pieces(raw_folder, tokenizer_path), _PIECE), "pieces")
    counts = pieces.select(F.explode(F.map_from_arrays("ids", "counts")).alias("id", "n")).groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # a row for each id of the vocabulary
    total = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 1, np.int64)
    total[counts["id"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    lengths = huffman.code_lengths(total)
    _put(folder, "codebook.bin", zlib.compress(lengths.tobytes()))
    spread = pieces.select("part", "seq", "path", "n_docs", "n_ids").repartition(_tasks(spark), F.col("path"))
    manifest, _ = write_table(spread.mapInArrow(_files(raw_folder, folder, lengths), "part long, seq long, path string, n_docs long, n_ids long"), "manifest")
    remove(spark, raw_folder)
    return with_starts(spark, manifest)


def with_starts(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """``start``: the ids of all files before. Files are summed by part, of which there is one for each task; the sums go over all parts, the files over their own part."""
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(earlier(Window.orderBy("part"))), F.lit(0))).drop("n")
    own = F.coalesce(F.sum("n_ids").over(earlier(Window.partitionBy("part").orderBy("seq"))), F.lit(0))
    return manifest.withColumn("own", own).join(parts, "part").withColumn("start", F.col("base") + F.col("own")).drop("base", "own")


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = huffman.decoding_table(np.frombuffer(zlib.decompress(_get(folder, "codebook.bin")), np.uint8))
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                docs, n, ids = read_file(folder, path, table)
                raw = memoryview(ids.astype("<u4")).cast("B")
                ends = np.cumsum(n)
                at = (4 * np.r_[0, ends]).tolist()
                crcs = [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + ends - n), pa.array(n), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.select("path", "start").repartition(_tasks(spark), F.col("path")).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_and_read_back(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    spark = docs.sparkSession
    folder = new_path(spark, "token-files")
    return read_token_files(spark, folder, write_token_files(docs, folder, tokenizer_path))
