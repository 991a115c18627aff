"""Best-hit assignment, reciprocal best hits, and adjacency of copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def aggregate_hits(hits: DataFrame, query: str, target: str, length: str, identity: str) -> DataFrame:
    """(query, target, length, identity): summed lengths (overlaps count twice) and length-weighted identity."""
    sums = hits.groupBy(query, target).agg(F.sum(length).alias("length"), F.sum(F.col(identity) * F.col(length)).alias("weighted"))
    return sums.withColumn("identity", F.try_divide("weighted", "length")).drop("weighted")


def assign(scored: DataFrame, query: str, target: str, score: str, least: float) -> DataFrame:
    """The target of the highest score (ties: the larger name), or ``unassigned`` below ``least``; scores stay. One aggregation, no window."""
    best = scored.groupBy(query).agg(F.max(F.struct(F.col(score).alias("score"), F.col(target).alias("target"))).alias("best"))
    ok = F.col("best.score") >= least
    return best.select(query, F.when(ok, F.col("best.target").cast("string")).otherwise("unassigned").alias("target"), F.col("best.score").alias("score"))


def reciprocal_best(forward: DataFrame, backward: DataFrame, reciprocal_only: bool = False) -> DataFrame:
    """Best hits (query, subject, identity) with the subject's own best hit; ``<=>`` where they name each other, else ``->``.

    Both frames have (query, subject, identity, row): ``row`` decides ties, first one wins. Queries whose subject has no hit back are dropped.
    """
    first = lambda df: best_row(df, ["query"], [F.col("identity").desc(), F.col("row")])
    back = first(backward).select(F.col("query").alias("subject"), F.col("subject").alias("back"))
    out = first(forward).select("query", "subject", "identity").join(back, "subject")
    out = out.withColumn("direction", F.when(F.col("back") == F.col("query"), "<=>").otherwise("->")).select("query", "subject", "identity", "direction")
    return out.where("direction = '<=>'") if reciprocal_only else out


def homology(genes: DataFrame, strains: DataFrame, hits: DataFrame, least: float = 80.0) -> DataFrame:
    """(gene, strain, identity, present): every cell, 0 without a hit. The matrix is the product by definition."""
    cells = genes.crossJoin(strains).join(hits, ["gene", "strain"], "left").withColumn("identity", F.coalesce("identity", F.lit(0.0)))
    return cells.withColumn("present", (F.col("identity") > least).cast("int"))


def copy_gaps(copies: DataFrame, keys: list[str], start: str, end: str, ties: list[str]) -> DataFrame:
    """``gap`` from each copy's end to the next start of the same key, null for the last; ``strand`` pairs stay with the caller."""
    w = Window.partitionBy(*keys).orderBy(start, *ties)
    return copies.withColumn("gap", F.lead(start).over(w) - F.col(end))


def systematic_sample(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows of a key: every step-th first, then the earliest others."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("__rn", F.row_number().over(w.orderBy(*order))).withColumn("__n", F.count(F.lit(1)).over(w))
    step = F.greatest(F.lit(1), F.floor(F.col("__n") / most))
    ranked = ranked.withColumn("__late", ((F.col("__rn") - 1) % step != 0).cast("int"))
    return ranked.withColumn("__k", F.row_number().over(w.orderBy("__late", "__rn"))).where(F.col("__k") <= most).drop("__rn", "__n", "__late", "__k")


def in_listed_order(order: list[str], name: Column) -> list[Column]:
    """Sort keys: names of a list first, in its order, then the others by name."""
    return [F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(x) for x in order)), name), F.lit(0)), F.lit(1 << 30)), name]


def natural_order(name: Column) -> list[Column]:
    """Sort keys: the first number in a name, then the name."""
    return [F.regexp_extract(name, r"(\d+)", 1).try_cast("int").asc_nulls_last(), name]


def names_within(texts: DataFrame, text: str, names: DataFrame, name: str) -> DataFrame:
    """``texts`` with ``name``, the longest of the names that stands anywhere in the text, and ``ambiguous``: several different ones of that length stand there; then the least is given. Null without any.

    The pieces of a text as long as some name are joined with the names, so the
    work grows with the texts and the number of lengths, not with texts times names.
    """
    own = names.select(F.col(name).cast("string").alias("__name")).where("__name <> ''").distinct()
    lengths = sorted(r.n for r in own.select(F.length("__name").alias("n")).distinct().collect())  # lengths of names
    asked = texts.select(F.col(text).alias("__text")).distinct()
    pieces = F.explode(F.array_distinct(F.flatten(F.transform(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: F.when(F.length("__text") >= n, F.transform(F.sequence(F.lit(1), F.length("__text") - n + 1), lambda i: F.substring("__text", i, n))).otherwise(F.array().cast("array<string>"))))))
    found = asked.select("__text", pieces.alias("__name")).join(own, "__name")
    longest = found.groupBy("__text").agg(F.max(F.struct(F.length("__name").alias("n"))).alias("most"), F.collect_set("__name").alias("all"))
    best = longest.withColumn("all", F.array_sort(F.filter("all", lambda x: F.length(x) == F.col("most.n")))).select("__text", F.col("all")[0].alias(name), (F.size("all") > 1).alias("ambiguous"))
    return texts.join(best, F.col(text) == F.col("__text"), "left").drop("__text").withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False)))
