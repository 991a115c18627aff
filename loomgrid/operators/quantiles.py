"""Exact quantiles by radix selection: a few counting passes over the bits of the values."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stored import stored

#: Bits that a pass decides; a pass counts at most 2 ** DIGIT rows for each quantile.
DIGIT = 16


def _ordered(bits: np.ndarray) -> np.ndarray:
    """The bits of doubles as whole numbers in the order of the doubles, and back."""
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


@F.pandas_udf(T.LongType())
def _key(x: pd.Series) -> pd.Series:
    return pd.Series(_ordered(x.to_numpy(np.float64).view(np.int64)))


@F.pandas_udf(T.DoubleType())
def _value(x: pd.Series) -> pd.Series:
    return pd.Series(_ordered(x.to_numpy(np.int64)).view(np.float64))


def quantiles(df: DataFrame, value: str, shares: Sequence[float], groups: Sequence[str] = (), discrete: bool = False, count: str | None = None) -> DataFrame:
    """(groups ..., share, value): exact quantiles of a numeric column, by linear interpolation or (``discrete``) the least value with that share of values up to it. ``count``: how many equal values a row stands for.

    All groups and shares are selected together: each pass counts the next bits
    of the values that share the bits decided so far, so no more than the counts
    of a pass is ever held, whatever the number of values. Nulls don't count;
    groups without values have no rows.
    """
    groups = list(groups)
    named = {g: f"__g{i}" for i, g in enumerate(groups)} or {}
    own = [*named.values()] or ["__g"]
    columns = [F.col(g).alias(n) for g, n in named.items()] or [F.lit(0).alias("__g")]
    keyed = stored(df.where(F.col(value).isNotNull()).select(*columns, F.col(value).cast("double").alias("x"), (F.lit(1) if count is None else F.col(count)).cast("long").alias("times")).select(*own, "times", _key("x").alias("key")), "keys")
    position = F.when(F.lit(discrete), F.greatest(F.lit(0.0), F.ceil(F.col("share") * F.col("n")) - 1)).otherwise((F.col("n") - 1) * F.col("share"))
    targets = keyed.groupBy(*own).agg(F.sum("times").alias("n")).select("*", F.explode(F.array(*(F.lit(float(s)) for s in shares))).alias("share")).withColumn("position", position)
    ends = F.array_distinct(F.array(F.floor("position"), F.ceil("position")))
    targets = stored(targets.select(*own, "share", "position", F.explode(ends).alias("rank")).withColumns({"left": F.col("rank"), "prefix": F.lit(0).cast("long")}), "targets")
    for shift in range(64 - DIGIT, -1, -DIGIT):
        first = shift == 64 - DIGIT
        digit = F.shiftright("key", shift)
        rows = keyed.select(*own, "times", digit.alias("digit"), (F.lit(0).cast("long") if first else F.shiftright("key", shift + DIGIT)).alias("prefix"))
        if not first:
            rows = rows.join(targets.select(*own, "prefix").distinct(), [*own, "prefix"], "left_semi")
        counts = rows.groupBy(*own, "prefix", "digit").agg(F.sum("times").alias("n"))
        before = F.sum("n").over(Window.partitionBy(*own, "prefix").orderBy("digit")) - F.col("n")
        found = targets.join(counts.withColumn("before", before), [*own, "prefix"]).where((F.col("left") >= F.col("before")) & (F.col("left") < F.col("before") + F.col("n")))
        targets = stored(found.select(*own, "share", "position", "rank", (F.col("left") - F.col("before")).alias("left"), F.col("digit").alias("prefix")), "targets")
    ends = targets.withColumn("v", _value("prefix")).groupBy(*own, "share", "position").agg(F.min_by("v", "rank").alias("low"), F.max_by("v", "rank").alias("high"))
    at = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((F.ceil("position") - F.col("position")) * F.col("low") + (F.col("position") - F.floor("position")) * F.col("high"))
    return ends.select(*(F.col(n).alias(g) for g, n in named.items()), "share", at.alias("value"))
