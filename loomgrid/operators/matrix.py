"""Presence matrices in long form: (entity, feature) rows; wide only at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_long(wide: DataFrame, entity: str, features: list[str] | None = None) -> DataFrame:
    """Wide 0/1 columns to rows of present cells; null counts as absent."""
    names = features or [c for c in wide.columns if c != entity]
    return wide.unpivot([entity], names, "feature", "value").where("value > 0").select(entity, "feature")


def to_wide(presence: DataFrame, entity: str, feature: str, values: list, entities: DataFrame | None = None) -> DataFrame:
    """0/1 columns for the given features; ``entities`` (one column) completes rows without any."""
    wide = presence.distinct().groupBy(entity).pivot(feature, values).agg(F.lit(1))
    if entities is not None:
        wide = entities.join(wide, entity, "left")
    return wide.fillna(0)


def prevalence(presence: DataFrame, entity: str, feature: str) -> DataFrame:
    return presence.groupBy(feature).agg(F.count_distinct(entity).alias("n"))


def with_total(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame."""
    return df.join(F.broadcast(totals))


def variable_features(presence: DataFrame, entity: str, feature: str) -> DataFrame:
    """Features that some but not all entities have, with their count."""
    counts = with_total(prevalence(presence, entity, feature), presence.agg(F.count_distinct(entity).alias("total")))
    return counts.where("n < total").select(feature, "n")


def frequency_classes(presence: DataFrame, entity: str, feature: str, core: float = 0.95, rare: float = 0.05) -> DataFrame:
    """(feature, n, share, class): core, accessory or rare."""
    counts = with_total(prevalence(presence, entity, feature), presence.agg(F.count_distinct(entity).alias("total")))
    share = F.col("n") / F.col("total")
    return counts.select(feature, "n", share.alias("share"), F.when(share >= core, "core").when(share < rare, "rare").otherwise("accessory").alias("class"))


def features_per_entity(presence: DataFrame, entities: DataFrame, entity: str) -> DataFrame:
    """(entity, n) for all entities, 0 for those without features."""
    return entities.join(presence.groupBy(entity).agg(F.count(F.lit(1)).alias("n")), entity, "left").fillna(0, ["n"])


def group_specific(presence: DataFrame, groups: DataFrame, entity: str, feature: str, present: bool = True) -> DataFrame:
    """(grp, feature): features of all members and nobody else; or, with ``present`` false, lacked by all members and by nobody else.

    ``groups`` has (grp, entity); its entities are the panel. Where a group is
    the whole panel nobody else exists, and the condition on others holds.
    """
    sizes = groups.groupBy("grp").agg(F.count_distinct(entity).alias("size"))
    panel = groups.agg(F.count_distinct(entity).alias("panel"))
    known = presence.join(groups.select(entity).distinct(), entity, "left_semi").select(entity, feature).distinct()
    total = known.groupBy(feature).agg(F.count(F.lit(1)).alias("total"))
    inside = known.join(groups.select("grp", entity).distinct(), entity).groupBy("grp", feature).agg(F.count(F.lit(1)).alias("inside"))
    if present:
        return inside.join(total, feature).join(sizes, "grp").where("inside = size AND total = inside").select("grp", feature)
    # A feature fits a group only if it misses just as many entities as the group has.
    fitting = with_total(total, panel).withColumn("missing", F.col("panel") - F.col("total")).join(sizes, F.col("missing") == F.col("size"))
    return fitting.join(inside, ["grp", feature], "left_anti").select("grp", feature)


def universal(presence: DataFrame, entity: str, feature: str) -> DataFrame:
    counts = with_total(prevalence(presence, entity, feature), presence.agg(F.count_distinct(entity).alias("total")))
    return counts.where("n = total").select(feature)


def merged_features(presence: DataFrame, names: DataFrame, entity: str, feature: str) -> DataFrame:
    """Features under their representative (feature, representative): present if any of them is."""
    return presence.join(names, feature, "left").select(entity, F.coalesce("representative", feature).alias(feature)).distinct()


def share_of_total(counts: DataFrame, n: str = "n") -> DataFrame:
    """Count and percent of all."""
    return with_total(counts, counts.agg(F.sum(n).alias("__all"))).withColumn("percent", F.round(100.0 * F.col(n) / F.col("__all"), 6)).drop("__all")


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts by row and given columns with their total, zero filled."""
    wide = df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).fillna(0)
    total: Column = sum((F.col(f"`{v}`") for v in values), F.lit(0).cast("long"))
    return wide.withColumn("TOTAL", total)


def weighted_items(df: DataFrame, column: str, separator: str = ";") -> DataFrame:
    """One row for each item of a list column, weight 1 / items; empty items are dropped after the weight is set."""
    parts = F.split(column, separator)
    return df.withColumn("weight", 1.0 / F.size(parts)).withColumn("item", F.explode(parts)).withColumn("item", F.trim("item")).where("item <> ''")


def valid_regions(df: DataFrame, start: str, end: str, length: str) -> DataFrame:
    """Regions with all three values, that end behind their start and have a length."""
    return df.where((F.col(start) < F.col(end)) & (F.col(length) > 0))


def intact(df: DataFrame, column: str = "completeness") -> DataFrame:
    """Rows whose completeness is intact, in whichever case."""
    return df.where(F.lower(F.trim(column)) == "intact")


def covered(hits: DataFrame, length: str, whole: str, least: float = 0.25) -> DataFrame:
    """Hits over at least a share of the whole; ``coverage`` is added."""
    return hits.withColumn("coverage", F.try_divide(length, whole)).where(F.col("coverage") >= least)


def without_names(df: DataFrame, name: str, prefixes: tuple[str, ...] = (), names: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose name is not null, begins with none of the prefixes and is none of the names."""
    bad = F.lit(False)
    for p in prefixes:
        bad |= F.col(name).startswith(p)
    return df.where(F.col(name).isNotNull() & ~(bad | F.col(name).isin(*names) if names else bad))


def listed(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose value is in a list."""
    return df.where(F.col(column).isin(values))


def items_by_group(rows: DataFrame, group: str, item: str) -> DataFrame:
    """(group, n, items): a row for each group with its items in order; ragged, so as an array."""
    return rows.groupBy(group).agg(F.array_sort(F.collect_set(item)).alias("items")).select(group, F.size("items").cast("long").alias("n"), "items")


def item_columns(grouped: DataFrame, group: str, most: int) -> DataFrame:
    """The same as columns item_1 to item_``most``, for sinks; null where a group has fewer."""
    return grouped.select(group, *(F.get("items", F.lit(i)).alias(f"item_{i + 1}") for i in range(most)))


def transposed(wide: DataFrame, key: str, values: list, name: str = "column") -> DataFrame:
    """A wide table with rows and columns exchanged: ``values`` are the keys that become columns."""
    names = [c for c in wide.columns if c != key]
    return wide.unpivot([key], names, name, "__value").groupBy(name).pivot(key, values).agg(F.first("__value"))


def ordered_matrix(cells: DataFrame, leaves: DataFrame, value: str) -> DataFrame:
    """Cells (a, b, value) with the leaf positions (item, leaf) of both ends, ``row`` and ``at``, and values rounded half to even to 3 digits, in that order."""
    a, b = leaves.select(F.col("item").alias("a"), F.col("leaf").alias("row")), leaves.select(F.col("item").alias("b"), F.col("leaf").alias("at"))
    return cells.join(a, "a").join(b, "b").select("a", "b", "row", "at", F.bround(value, 3).alias(value)).orderBy("row", "at")


def gene_matrix(genes: DataFrame, strains: DataFrame, hits: DataFrame, missing: str = "None") -> DataFrame:
    """(gene, strain, id): the name of the hit in every cell, ``missing`` without one. The matrix is the product by definition."""
    return genes.crossJoin(strains).join(hits.select("gene", "strain", "id"), ["gene", "strain"], "left").withColumn("id", F.coalesce("id", F.lit(missing)))
