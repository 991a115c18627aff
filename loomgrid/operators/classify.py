"""Tiered classification rules; in each, the first rule that fits decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def similarity_tier(known: Column, similarity: Column) -> Column:
    return F.when(known.isNotNull() & (similarity >= 70), "Known").when(similarity >= 30, "LowConf").otherwise("Novel")


def artifact_tier(identity: Column, coverage: Column, ratio: Column) -> Column:
    rule = lambda least, low, high: (identity >= least) & coverage.between(low, high)
    return F.when(rule(98, 20, 55), "VERY_HIGH").when(rule(95, 25, 60), "HIGH").when(rule(90, 30, 50) & (ratio <= 0.6), "MEDIUM")


def artifact_confidence(identity: Column, coverage: Column, ratio: Column) -> Column:
    """Shares of identity, coverage and length, at most 1."""
    return F.least(F.lit(1.0), 0.5 * identity + 0.3 * coverage + 0.2 * ratio)


def conservative_merge(identity: Column, coverage: Column) -> Column:
    return (identity >= 80) & (coverage >= 50)


def variant_class(length_ratio: Column, identity: Column) -> Column:
    return F.when(length_ratio < 80, "TRUNCATED").when(identity >= 95, "ARTEFACT").otherwise("VARIANT")


def present_status(is_variant: Column, cls: Column, copies: Column, spread: Column | None = None) -> Column:
    """What becomes of a feature in the present block: its validation speaks first, whether it is a variant only where there is none. ``spread``: identity spread of multi-copy features; without it that rule never fires."""
    wide = (copies > 1) & (spread > 10) if spread is not None else F.lit(False)
    artefact = F.upper(cls).contains("ARTEFACT")
    return F.when(artefact & wide, "KEEP (multi-copy)").when(artefact, "REMOVE").when(cls.isNotNull(), "KEEP").when(is_variant, "KEEP (not validated)").otherwise("KEEP (not a variant)")


def absent_status(paired: Column, gene_found: Column) -> Column:
    """What becomes of a feature in the absent block; a gene that the group's genomes have in another variant stays absent."""
    return F.when(paired, "REMOVE (paired artefact)").when(gene_found, "KEEP (other variant in genome)").otherwise("KEEP (gene missing)")


def split_flag(least_gap: Column, same_strand: Column, ratio: Column, most: int = 5000) -> Column:
    """Copies of one gene in one genome, by the least gap between neighbours and whether all of them share a strand."""
    near = least_gap < most
    return F.when(near & same_strand & (ratio < 0.9), "split_unequal").when(near & same_strand, "split_similar").when(near, "close").otherwise("distant")


def copy_verdicts(copies: DataFrame, keys: list[str], start: str, end: str, strand: str, length: str, most: int = 5000) -> DataFrame:
    """(keys, n_copies, least_gap, same_strand, ratio, truncated, flag, is_split) of keys with several copies."""
    from .assign import copy_gaps

    gaps = copy_gaps(copies.dropDuplicates([*keys, start, end, strand]), keys, start, end, [end, strand])
    ratio = F.try_divide(F.min(length), F.max(length))
    rows = gaps.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_copies"), F.min("gap").alias("least_gap"), (F.min(strand) == F.max(strand)).alias("same_strand"), ratio.alias("r")).where("n_copies > 1")
    flag = split_flag(F.col("least_gap"), F.col("same_strand"), F.col("r"), most)
    return rows.select(*keys, "n_copies", "least_gap", "same_strand", F.bround("r", 3).alias("ratio"), (F.col("r") < 0.5).alias("truncated"), flag.alias("flag"), flag.startswith("split").alias("is_split"))


def split_scope(inside: Column, outside: Column) -> Column:
    return F.when((inside > 0) & (outside == 0), "group_only").when((inside > 0) & (outside > 0), "both").when(outside > 0, "outside_only").otherwise("none")


def split_uniqueness(outside_split: Column, outside_intact: Column) -> Column:
    """Of a feature that is split in its group: strains outside with the split, or with copies that are none."""
    return F.when(outside_split > 0, "also_outside").when(outside_intact > 0, "split_unique").otherwise("unique")


def reference_variant(candidates: DataFrame, preferred: str) -> DataFrame:
    """(grp, base) to its reference and the strain that has it.

    ``candidates``: (grp, base, strain, variant, number, own): a row for each
    strain with a variant; own marks the group's variant. In order: 1 ``.0`` in
    the preferred strain, 2 ``.0`` elsewhere (first strain by name), 3 the lowest
    number in the preferred strain, and without any there, 5 the base gene
    itself, in that strain. Where rule 3 names the own variant, 4 the most
    frequent other one counts (the lowest number among equals), else the base
    gene. A group whose own variant is the ``.0`` has no reference and is left out.
    """
    from pyspark.sql import Window

    times = F.count(F.lit(1)).over(Window.partitionBy("grp", "base", "variant"))
    first = F.min("strain").over(Window.partitionBy("grp", "base", "variant"))
    rows = candidates.withColumns({"__times": times, "__first": first})
    home, zero = F.col("strain") == preferred, F.col("number") == 0
    pick = lambda when, *order: F.min(F.when(when, F.struct(*order, "variant", F.col("__first").alias("first"), "own")))
    one = rows.groupBy("grp", "base").agg(
        F.max(F.coalesce(zero & home, F.lit(False))).alias("home_zero"), pick(zero, F.lit(0).alias("o")).alias("zero"),
        pick(home & F.col("number").isNotNull(), F.col("number").alias("o")).alias("lowest"),
        pick(~F.col("own"), (-F.col("__times")).alias("o"), "number").alias("other"),
    )
    rank = F.when(F.col("home_zero"), 1).when(F.col("zero").isNotNull(), 2).when(F.col("lowest").isNull(), 5).when(~F.col("lowest.own"), 3).when(F.col("other").isNotNull(), 4).otherwise(5)
    by = lambda *values: F.coalesce(*(F.when(F.col("rank") == k, v) for k, v in enumerate(values, 1)))
    one = one.withColumn("rank", rank).where("zero IS NULL OR NOT zero.own")
    return one.select("grp", "base", by(*(F.col(c) for c in ("zero.variant", "zero.variant", "lowest.variant", "other.variant", "base"))).alias("reference"), by(F.lit(preferred), F.col("zero.first"), F.lit(preferred), F.col("other.first"), F.lit(preferred)).alias("strain"), "rank")


def cluster_flag(n_entities: Column, cv_percent: Column) -> Column:
    return F.when(n_entities < 2, "singleton").when(cv_percent > 30, "variable").otherwise("consistent")


def pool_small(df: DataFrame, label: str, most: int = 2, pooled: str = "pooled") -> DataFrame:
    """Labels of at most ``most`` rows become one."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    return df.join(sizes, label).withColumn(label, F.when(F.col("__n") <= most, pooled).otherwise(F.col(label))).drop("__n")
