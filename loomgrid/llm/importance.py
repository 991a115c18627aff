"""Importance resampling towards a target: documents whose n-grams look like the target's are drawn.

Features are hashed n-grams: each word's CRC-32 is computed once and those of
n-grams are composed from it (:mod:`.crc`), so no n-gram is ever a string.

1. Every task counts buckets of its documents; the sums are one number for each
   bucket, for the documents and for the target. A bucket's gain is the log ratio
   of its smoothed shares.
2. A document's weight is the mean gain of its features; Gumbel noise seeded by
   the doc_id makes the highest scores a draw without replacement.
3. A histogram of the whole-number scores gives the least score that is drawn;
   only documents from there on are sorted, by range, and numbered through.

Defined results: a null text has no words; a document without features has
weight 0; equal scores are drawn by smaller doc_id (null first), repeated rows in
any order; rows without a doc_id are hashed as ``seed:``; an empty table, or an
empty target, is counted as nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import crc
from . import textbytes as tb
from .workspace import rows_in, small_side, tune, with_row_key, write_table

#: Longest n-gram, buckets, percent of the eligible documents that are drawn, their least number of words, seed of the noise.
N, BUCKETS, PERCENT, LEAST_WORDS, SEED = 1, 10_000, 10, 20, 2024
#: All ASCII but digits and lower-case letters stands between words; upper-case ones are lowered before.
_BETWEEN = np.arange(256) < 0x80
_BETWEEN[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = False


def _features(batch: pa.RecordBatch, n: int, buckets: int):
    """(first word of each row and the total, iterator of (rows, buckets) by size of the n-gram) of the column ``text``."""
    data, offsets = tb.column_bytes(batch.column("text"))
    data = tb.LOWER[data]
    starts, ends, first = tb.word_bounds(data, offsets, _BETWEEN)
    return first, ((row, (x % np.uint32(buckets)).astype(np.int64)) for _, row, x in crc.ngrams(crc.words(data, starts, ends), ends - starts, first, n))


def bucket_counts(docs: DataFrame, n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all documents. A task adds up its own before it sends a row for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in tb.slices(batches):
            for _, bucket in _features(batch, n, buckets)[1]:
                total += np.bincount(bucket, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["bucket", "n"])

    tune(docs.sparkSession)
    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS) -> np.ndarray:
    """Whole-number gain of each bucket: what reaches the driver is a number for each bucket, whatever the size of the tables."""

    def counted(df: DataFrame) -> np.ndarray:
        found, out = bucket_counts(df, n, buckets).toPandas(), np.zeros(buckets)
        out[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(float)
        return out

    s, t = counted(docs), counted(target)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def scored(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, k1, k2, n_words, n_features, weight and score of every document, as a written table with a number ``nth`` for each row."""
    gain = gains(docs, target, n, buckets)  # 8 bytes for each bucket go to the tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches):
            first, found = _features(batch, n, buckets)
            rows = batch.num_rows
            count, total = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            for row, bucket in found:
                sums = np.r_[0, np.cumsum(gain[bucket])]
                edge = np.searchsorted(row, np.arange(rows + 1))
                count += np.diff(edge)
                total += sums[edge[1:]] - sums[edge[:-1]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "k1", "k2")), pa.array(np.diff(first).astype(np.int64)), pa.array(count), pa.array(total // np.maximum(count, 1))], names=["doc_id", "k1", "k2", "n_words", "n_features", "weight"])

    weighed = with_row_key(docs).mapInArrow(run, "doc_id long, k1 long, k2 int, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    out, _ = write_table(weighed.withColumn("score", F.col("weight") + noise).withColumn("nth", F.monotonically_increasing_id()), "scored")
    return out


def ranked(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of scored() with ``rank``: 1, 2, 3 ... of those drawn, null for all others."""
    eligible = F.col("n_words") >= least_words
    counts = rows.where(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("score", ascending=False)  # whole numbers between the logs of doubles: some 10,000 rows at any size
    drawn = percent * int(counts["n"].sum()) // 100
    above = np.searchsorted(counts["n"].cumsum().to_numpy(), drawn)
    if not drawn:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    candidate = eligible & (F.col("score") >= int(counts["score"].iloc[above]))
    keys = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("nth").asc()]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int64)), pa.array(np.arange(at + 1, at + n + 1))], names=[*batch.schema.names, "part", "place"])
            at += n

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed, _ = write_table(rows.where(candidate).repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(number, f"{kinds}, part long, place long"), "placed")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each task
    bases, _ = write_table(sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base")), "bases")
    rank = F.col("base") + F.col("place")
    chosen = placed.join(small_side(bases), "part").select(*rows.columns, F.when(rank <= drawn, rank).alias("rank"))
    return chosen.unionByName(rows.where(F.coalesce(~candidate, F.lit(True))).withColumn("rank", F.lit(None).cast("long")))


def report(docs: DataFrame, target: DataFrame) -> DataFrame:
    return ranked(scored(docs, target)).select("doc_id", "n_features", "weight", "score", "rank")


def resampled(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The documents that are drawn, with their own columns."""
    drawn, _ = write_table(ranked(scored(docs, target, n, buckets, seed), percent, least_words).where(F.col("rank").isNotNull()).select("doc_id", "k1", "k2").distinct(), "drawn")
    return rows_in(docs, drawn, "left_semi")
