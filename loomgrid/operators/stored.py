"""Written intermediate tables, and numbers of rows in a global order."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Shuffle files behind a table are of no use once it is written.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where that is unset and all runs on one machine, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if "root" not in _LOCAL:
        _LOCAL["root"] = "file://" + tempfile.mkdtemp(prefix="loomgrid-")
    return _LOCAL["root"]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended before
        pass


def stored(df: DataFrame, name: str = "rows") -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: its lineage ends there, so a lost executor costs a retry of its tasks, and Spark removes the shuffle files behind it. The files go when the driver ends, or by discard()."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/loomgrid/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the files of a table that stored() gave, when nothing reads it any more."""
    if path := _PATHS.pop(df, None):
        _remove(df.sparkSession, path)


def numbered(df: DataFrame, keys: Sequence[Column], name: str = "number", sums: dict[str, str] | None = None, mins: dict[str, str] | None = None) -> DataFrame:
    """``df`` with the number (0, 1, 2 ...) of each row in the order of ``keys``, and for ``sums`` and ``mins`` (new column to column) the sum and the least over all rows before (0 and null for the first).

    Rows are sorted by range; only one row for each partition meets in one
    place. Ties are numbered in any order, so keys should be unique.
    """
    sums, mins = sums or {}, mins or {}
    row, part, place = "__row", "__part", "__place"
    ordered = stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(row, F.monotonically_increasing_id()), "ordered")
    ordered = ordered.withColumns({part: F.shiftright(row, 33), place: F.col(row).bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = ordered.groupBy(part).agg(F.count(F.lit(1)).alias("__n"), *(f(c).alias(f"__{new}") for f, all_ in ((F.sum, sums), (F.min, mins)) for new, c in all_.items()))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # over one row for each partition
    bases = sizes.select(part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"), *(F.coalesce(F.sum(f"__{new}").over(before), F.lit(0)).alias(f"__base_{new}") for new in sums), *(F.min(f"__{new}").over(before).alias(f"__base_{new}") for new in mins))
    inner = Window.partitionBy(part).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    out = ordered.join(F.broadcast(bases), part)  # one row for each partition
    summed = [(F.col(f"__base_{new}") + F.coalesce(F.sum(c).over(inner), F.lit(0))).alias(new) for new, c in sums.items()]
    return out.select(*df.columns, (F.col("__base") + F.col(place)).alias(name), *summed, *(F.least(f"__base_{new}", F.min(c).over(inner)).alias(new) for new, c in mins.items()))
