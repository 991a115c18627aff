"""Shared folders, written tables and Arrow settings for the operators of this subpackage.

Every intermediate result goes to the folder that the cluster names in
``spark.checkpoint.dir``: all executors and the driver see it, so a lost
executor costs a retry of its tasks and nothing else.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most so many bytes of a column go to a Python worker in one Arrow batch.
ARROW_BATCH_BYTES = 8 << 20
#: A table of at most so many rows and bytes, both measured before use, may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 16 << 20
#: Shuffle files of a query are of no use once its result is written.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where that is unset and all runs on one machine (tests), else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        root = "file://" + tempfile.mkdtemp(prefix="loomgrid-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it is removed when the driver's Python ends."""
    path = f"{shared_root(spark)}/loomgrid/{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file systems, so that it works for any store."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may have ended before
        pass


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet into the shared folder and read it again: this cuts its lineage, and Spark removes the shuffle files behind it."""
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def tune(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches by bytes: documents may be very long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        now = int(spark.conf.get(key))
    except ValueError:  # with a unit or unset
        now = 1 << 62
    if now > ARROW_BATCH_BYTES:
        spark.conf.set(key, str(ARROW_BATCH_BYTES))
    return spark


def is_small(df: DataFrame, rows: int | None = None, size: int | None = None) -> bool:
    """Whether the counted rows and the bytes of their text form stay within the bounds. ``df`` should be a written table: this reads it."""
    if df.count() > (BROADCAST_ROWS if rows is None else rows):
        return False
    return (df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0) <= (BROADCAST_BYTES if size is None else size)


def small_side(df: DataFrame) -> DataFrame:
    """Hint a broadcast only for a table within the bounds; else leave a shuffle join."""
    return F.broadcast(df) if is_small(df) else df


def free_names(df: DataFrame, n: int) -> list[str]:
    """``n`` column names that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    names, k = [], 0
    while len(names) < n:
        if (name := f"_key{k}") not in taken:
            names.append(name)
        k += 1
    return names


def with_row_key(docs: DataFrame) -> DataFrame:
    """doc_id as long, text as string, and k1, k2: 96 bits of hash of the text.

    (doc_id, k1, k2) names a row for joins: rows that repeat a doc_id with
    another text stay apart, and exact repetitions share their result.
    """
    doc_id, k1, k2 = row_key()
    return docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"), k1.alias("k1"), k2.alias("k2"))


def row_key() -> tuple[Column, Column, Column]:
    """doc_id, k1 and k2 of a table of documents."""
    text = F.col("text").cast("string")
    return F.col("doc_id").cast("long"), F.xxhash64(text), F.hash(text)


def same_row(a: DataFrame, b: DataFrame):
    """Join condition on doc_id (null matches null), k1 and k2."""
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["k1"] == b["k1"]) & (a["k2"] == b["k2"])


def rows_in(docs: DataFrame, keys: DataFrame, how: str, merge: bool = False, once: bool = False) -> DataFrame:
    """The documents, with just their own columns, whose row key is among ``keys`` (doc_id, k1, k2); ``how``: left_semi or left_anti. ``once``: one row of each key."""
    own = free_names(docs, 3)
    wanted = keys.select(*(F.col(c).alias(f"{n}_of") for c, n in zip(("doc_id", "k1", "k2"), own, strict=True)))
    wanted = wanted.hint("merge") if merge else small_side(wanted)
    named = docs.withColumns(dict(zip(own, row_key(), strict=True)))
    first, *rest = own
    same = F.col(first).eqNullSafe(F.col(f"{first}_of"))
    for n in rest:
        same &= F.col(n) == F.col(f"{n}_of")
    found = named.join(wanted, same, how)
    return (found.dropDuplicates(own) if once else found).select(*(F.col(f"`{c}`") for c in docs.columns))
