"""Lookups, labels and grouped summaries of named columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ordinal_letters
from .stored import numbered


def looked_up(df: DataFrame, dimension: DataFrame, on: dict[str, str], values: dict[str, str], default: dict[str, object] | None = None) -> DataFrame:
    """``df`` with columns of a dimension: ``on`` maps its own keys to those of the dimension (null meets null), ``values`` new names to the dimension's columns; without a match the default, else null. Keys of the dimension are unique."""
    own = dimension.select(*(F.col(d).alias(f"__k{i}") for i, d in enumerate(on.values())), *(F.col(c).alias(f"__v{i}") for i, c in enumerate(values.values())))
    same = None
    for i, k in enumerate(on):
        one = df[k].eqNullSafe(own[f"__k{i}"])
        same = one if same is None else same & one
    value = lambda i, n: F.coalesce(f"__v{i}", F.lit(default[n])) if default and n in default else F.col(f"__v{i}")
    return df.join(own, same, "left").select(*(df[c] for c in df.columns), *(value(i, n).alias(n) for i, n in enumerate(values)))


def recoded(df: DataFrame, column: str, names: dict[str, str], new: str | None = None) -> DataFrame:
    """``column`` (or ``new``) with the values of ``names`` replaced; others pass through."""
    value = F.col(column)
    if names:
        key = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
        value = F.coalesce(F.try_element_at(key, F.col(column)), F.col(column))
    return df.withColumn(new or column, value)


def both_have(pairs: DataFrame, presence: DataFrame, entity: str, feature: str) -> DataFrame:
    """(feature, ``pairs`` ...): the pairs (lo, hi) of which both ends have a feature. Rows of ``presence`` are distinct."""
    own = presence.select(F.col(feature).alias("feature"), F.col(entity).alias("lo"))
    other = presence.select(F.col(feature).alias("feature"), F.col(entity).alias("hi"))
    return pairs.join(own, "lo").join(other, ["feature", "hi"], "left_semi").select("feature", *pairs.columns)


def interval(a: Column, b: Column) -> Column:
    """(low, high, middle) of two endpoints in any order."""
    return F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"), ((a + b) / 2).alias("middle"))


def extent(df: DataFrame, keys: list[str], a: str, b: str, *more: Column) -> DataFrame:
    """(keys, first, last, size, middle, *more): from the least to the greatest endpoint, and the mean middle of the intervals."""
    at = interval(F.col(a), F.col(b))
    return df.groupBy(*keys).agg(F.min(at["low"]).alias("first"), F.max(at["high"]).alias("last"), (F.max(at["high"]) - F.min(at["low"])).alias("size"), F.avg(at["middle"]).alias("middle"), *more)


def joined_texts(df: DataFrame, keys: list[str], text: str, order: str, separator: str = "/", missing: str = "NA") -> DataFrame:
    """(keys, texts, n): the texts of a key in order, joined; a missing one has a name."""
    row = F.struct(F.col(order).alias("o"), F.coalesce(F.col(text), F.lit(missing)).alias("t"))
    return df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["t"]), separator).alias("texts"), F.count(F.lit(1)).alias("n"))


def cluster_summary(df: DataFrame, cluster: str, member: str, value: str) -> DataFrame:
    """(cluster, n_members, n, mean, sd, least, most, cv): distinct members, rows and the spread of a value; cv is the sd as percent of the mean."""
    v = F.col(value)
    out = df.groupBy(cluster).agg(F.count_distinct(member).alias("n_members"), F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("least"), F.max(v).alias("most"))
    return out.withColumn("cv", F.try_divide(100 * F.col("sd"), F.col("mean")))


def group_concordance(pairs: DataFrame, group: tuple[str, str], phenotype: str, similarity: str, kin: float = 0.5, mild: float = 0.25) -> DataFrame:
    """(grp, n, least, mean_phenotype, mean_similarity, all_kin, all_mild) of the pairs whose ends are of one group."""
    p = F.col(phenotype)
    own = pairs.where(F.col(group[0]) == F.col(group[1])).groupBy(F.col(group[0]).alias("grp"))
    return own.agg(F.count(F.lit(1)).alias("n"), F.min(p).alias("least"), F.avg(p).alias("mean_phenotype"), F.avg(similarity).alias("mean_similarity"), F.bool_and(p >= kin).alias("all_kin"), F.bool_and(p >= mild).alias("all_mild"))


def extremes_by_class(df: DataFrame, value: str, classes: list[tuple[str, Column]]) -> DataFrame:
    """(class, n, least, most) of a value in named, maybe overlapping classes, in one pass."""
    parts = [(f"{k}{i}", f) for i, (_, m) in enumerate(classes) for k, f in (("n", F.count_if(m)), ("l", F.min(F.when(m, F.col(value)))), ("m", F.max(F.when(m, F.col(value)))))]
    one = df.agg(*(f.alias(n) for n, f in parts))
    return one.select(F.inline(F.array(*(F.struct(F.lit(name).alias("class"), F.col(f"n{i}").alias("n"), F.col(f"l{i}").alias("least"), F.col(f"m{i}").alias("most")) for i, (name, _) in enumerate(classes)))))


def comparison_summary(pairs: DataFrame, keys: list[str], value: str, *more: Column, count: str | None = None) -> DataFrame:
    """(keys, n, mean, sd, least, most, *more) of compared pairs; sd is that of the whole population. ``count``: how many equal pairs a row stands for; such rows are few for each of ``keys``."""
    v = F.col(value)
    if count:
        n, all_ = F.col(count), Window.partitionBy(*keys)
        known = F.sum(F.when(v.isNotNull(), n)).over(all_)
        rows = pairs.withColumns({"__known": known, "__mean": F.sum(v * n).over(all_) / known})
        spread = F.sqrt(F.sum(n * (v - F.col("__mean")) ** 2) / F.first("__known"))
        return rows.groupBy(*keys).agg(F.sum(n).alias("n"), F.first("__mean").alias("mean"), spread.alias("sd"), F.min(v).alias("least"), F.max(v).alias("most"), *more)
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.min(v).alias("least"), F.max(v).alias("most"), *more)


def shares_within(df: DataFrame, within: list[str], label: str) -> DataFrame:
    """(within, label, n, share): how often each label is there, and its part of the group. The labels of a group are few."""
    counts = df.groupBy(*within, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*within)))


def strata(pairs: DataFrame, similarity: str, phenotype: str, strong: Column, moderate: Column, borderline: Column, mild: float = 0.25) -> DataFrame:
    """The pairs that disagree with their similarity, with their ``stratum``: strong (similar, no kinship at all), moderate, borderline (just below); first match wins, other pairs go."""
    s, p = F.col(similarity), F.col(phenotype)
    stratum = F.when((s >= strong) & (p == 0), "strong").when((s >= moderate) & (p <= mild), "moderate").when((s >= borderline) & (s < moderate) & (p <= mild), "borderline")
    return pairs.withColumn("stratum", stratum).where("stratum IS NOT NULL")


def with_group_ids(df: DataFrame, name: str) -> DataFrame:
    """``n``, the rows of the same name, and ``group_id``, the dense number of the name from 1, numbered by range over the names."""
    groups = numbered(df.groupBy(name).agg(F.count(F.lit(1)).alias("n")), [F.col(name)], "group_id")
    return df.join(groups.withColumn("group_id", F.col("group_id") + 1), name)


def lettered(df: DataFrame, group: str, order: str, new: str, most: int | None = None) -> DataFrame:
    """``new``: the group with the letters of the row's place in it (a, b ... z, aa), of at most ``most`` where that is given. A group's rows are sorted in one task."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("__place", place).withColumn(new, F.concat(F.col(group), ordinal_letters(F.col("__place"), most=most))).drop("__place")


def labelled_rows(df: DataFrame, order: list[str], prefix: str, new: str = "label") -> DataFrame:
    """``new``: prefix and number (from 1) of the row in a global order; rows are numbered by range, not in one task."""
    rows = numbered(df, [F.col(c) for c in order], "__number")
    return rows.withColumn(new, F.concat(F.lit(prefix), (F.col("__number") + 1).cast("string"))).drop("__number")


def top_per_class(df: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each class; Spark keeps k rows of a class in each task before it shuffles."""
    return df.withColumn("__place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__place") <= k).drop("__place")
