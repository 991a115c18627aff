"""Directed and undirected pairs: canonical order, reciprocal means, set similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stored import stored


def canonical(df: DataFrame, a: str, b: str) -> DataFrame:
    """Columns ``lo`` and ``hi`` instead of ``a`` and ``b``, without self pairs."""
    return df.where(F.col(a) != F.col(b)).withColumns({"lo": F.least(a, b), "hi": F.greatest(a, b), "forward": F.col(a) < F.col(b)}).drop(*{a, b} - {"lo", "hi"})


def reciprocal_mean(df: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """One row for a pair: mean of each direction's mean, or the one that exists, and the difference of both. One aggregation, no join."""
    both = canonical(df, a, b).groupBy("lo", "hi").agg(F.avg(F.when(F.col("forward"), F.col(value))).alias("ab"), F.avg(F.when(~F.col("forward"), F.col(value))).alias("ba"))
    return both.select("lo", "hi", F.coalesce((F.col("ab") + F.col("ba")) / 2, "ab", "ba").alias("value"), F.abs(F.col("ab") - F.col("ba")).alias("difference"))


def running_mean(df: DataFrame, a: str, b: str, value: str, order: str) -> DataFrame:
    """(lo, hi, value, n): each further value of an unordered pair is averaged with what the pair had, in the order of ``order``; so the last one weighs a half. For up to two values it is the plain mean."""
    both = canonical(df.where(F.col(value).isNotNull()), a, b)
    values = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))), lambda r: r["v"])
    rest = lambda x: F.aggregate(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), x[0], lambda s, v: (s + v) / 2)
    return both.groupBy("lo", "hi").agg(values.alias("__v")).select("lo", "hi", rest(F.col("__v")).alias("value"), F.size("__v").cast("long").alias("n"))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join on all keys where null meets null; the keys come from the left."""
    same = None
    for k in keys:
        one = left[k].eqNullSafe(right[k])
        same = one if same is None else same & one
    return left.join(right, same, how).select(*(left[c] for c in left.columns), *(right[c] for c in right.columns if c not in keys))


def difference_stats(means: DataFrame) -> DataFrame:
    """(n, mean, most, median) of the differences between both directions, of pairs that have both. Equal differences are counted where they are made."""
    from .summary import describe

    counts = means.where("difference IS NOT NULL").groupBy("difference").agg(F.count(F.lit(1)).alias("times"))
    return describe(counts, "difference", "times").select("n", "mean", F.col("max").alias("most"), "median")


def derived_flags(pairs: DataFrame, similar: float = 99.5, kin: float = 0.5) -> DataFrame:
    """Pairs (g_lo, g_hi, similarity, phenotype) with same_group, above_threshold, observed_kin and the outcome's name."""
    p = F.col("phenotype")
    # The names of the four outcomes.
    named = F.when(p == 1.0, "Merging").when(p == 0.5, "Contact").when(p == 0.25, "Thick boundary").when(p == 0.0, "Lysis").otherwise("Unknown")
    return pairs.withColumns({"same_group": F.col("g_lo") == F.col("g_hi"), "above_threshold": F.col("similarity") >= similar, "observed_kin": p >= kin, "outcome": named})


def common_lists(presence: DataFrame, entity: str, feature: str) -> DataFrame:
    """(lo, feature, his): for each entity and each of its features the greater entities that share it, sorted; none without any. Rows of ``presence`` are distinct."""
    sets = presence.where(F.col(entity).isNotNull() & F.col(feature).isNotNull()).groupBy(F.col(feature).alias("feature")).agg(F.array_sort(F.collect_list(entity)).alias("all"))
    each = sets.where(F.size("all") > 1).select("feature", "all", F.posexplode("all").alias("at", "lo"))
    return each.where(F.col("at") < F.size("all") - 1).select("lo", "feature", F.slice("all", F.col("at") + 2, F.size("all")).alias("his"))


#: About so many partners are counted in one task.
PARTNERS_IN_TASK = 4_000_000


def shared_counts(presence: DataFrame, entity: str, feature: str) -> DataFrame:
    """(lo, hi, both): entities that share a feature, with the number of those. Rows of ``presence`` are distinct.

    Lists of partners are dealt by ``lo`` and opened only there, where they are counted, so that no row for a pair and a feature is shuffled.
    Tasks are as many as the partners need, so that a task's pairs are counted in memory.
    """
    k = F.col("k")
    partners = presence.groupBy(F.col(feature).alias("feature")).agg(F.count(entity).alias("k")).where("feature IS NOT NULL").agg(F.sum(k * (k - 1) / 2)).first()[0] or 0
    tasks = max(int(presence.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(partners) // PARTNERS_IN_TASK))
    lists = common_lists(presence, entity, feature).select("lo", "his").repartition(tasks, "lo")
    return lists.select("lo", F.explode("his").alias("hi")).groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("both"))


def jaccard(presence: DataFrame, entity: str, feature: str, complete: bool = False) -> DataFrame:
    """(lo, hi, both, n_lo, n_hi, jaccard); ``complete`` adds the pairs without a common feature."""
    presence = stored(presence.select(entity, feature), "presence")
    sizes = stored(presence.groupBy(F.col(entity).alias("e")).agg(F.count(F.lit(1)).alias("n")), "sizes")
    lo, hi = sizes.select(F.col("e").alias("lo"), F.col("n").alias("n_lo")), sizes.select(F.col("e").alias("hi"), F.col("n").alias("n_hi"))
    shared = shared_counts(presence, entity, feature)
    if complete:  # every pair is asked for, so every pair is made
        shared = lo.select("lo").join(hi.select("hi"), F.col("lo") < F.col("hi")).join(shared, ["lo", "hi"], "left").fillna(0, ["both"])
    out = shared.join(lo, "lo").join(hi, "hi")
    return out.withColumn("jaccard", F.col("both") / (F.col("n_lo") + F.col("n_hi") - F.col("both")))


#: Sets of so many features are small enough to travel with each feature of their beginning.
SHORT = 16


def jaccard_at_least(presence: DataFrame, entity: str, feature: str, least: float) -> DataFrame:
    """(lo, hi, both, n_lo, n_hi, jaccard) of the pairs at or above ``least``, without making all pairs that share anything.

    Features are ordered by how many entities have them, the rarest first. Two
    sets that are similar enough share a feature among the first n - least * n + 1
    of each, so only these beginnings are joined; a pair whose sizes differ too
    much, or that has too little left behind the place where it meets, is dropped
    there. Sets of at most ``SHORT`` features travel with their beginnings, and two
    such are compared where they meet first; others are counted on the whole sets,
    joined to the distinct pairs that met.
    """
    if not 0 < least <= 1:
        raise ValueError(f"a similarity above 0 and up to 1 is needed, not {least}")
    slack = 1e-9
    rows = presence.select(F.col(entity).alias("e"), F.col(feature).alias("f"))
    spread = rows.groupBy("f").agg(F.count(F.lit(1)).alias("df"))
    ordered = F.array_sort(F.collect_list(F.struct("df", "f")))
    sets = stored(rows.join(spread, "f").groupBy("e").agg(ordered.alias("x")).select("e", F.col("x.f").alias("f"), F.size("x").cast("long").alias("n")), "sets")
    head = F.col("n") - F.ceil(least * F.col("n") - slack) + 1
    begins = sets.select("e", "n", "f", head.cast("int").alias("h")).select("e", "n", "h", F.when(F.col("n") <= SHORT, F.col("f")).alias("x"), F.posexplode(F.slice("f", F.lit(1), F.col("h"))).alias("at", "f"))
    a, b = (begins.select("f", *(F.col(c).alias(f"{c}_{side}") for c in ("e", "n", "h", "x", "at"))) for side in ("lo", "hi"))
    near = F.least("n_lo", "n_hi") >= least * F.greatest("n_lo", "n_hi") - slack
    needed = F.col("n_lo") + F.col("n_hi")
    left = F.least("at_lo", "at_hi") + F.least(F.col("n_lo") - F.col("at_lo"), F.col("n_hi") - F.col("at_hi"))  # shared before, and from here on, at most
    met = a.join(b, "f").where((F.col("e_lo") < F.col("e_hi")) & near & (left >= least / (1 + least) * needed - slack))
    similar = F.col("both") / (needed - F.col("both"))
    shape = [F.col("e_lo").alias("lo"), F.col("e_hi").alias("hi"), "both", "n_lo", "n_hi", similar.alias("jaccard")]
    short = F.col("x_lo").isNotNull() & F.col("x_hi").isNotNull()
    first = F.get(F.array_intersect(F.slice("x_lo", F.lit(1), F.col("h_lo")), F.slice("x_hi", F.lit(1), F.col("h_hi"))), F.lit(0)) == F.col("f")  # a pair counts where it meets first
    at_once = met.where(short).withColumn("both", F.size(F.array_intersect("x_lo", "x_hi")).cast("long")).where((similar >= least) & first).select(*shape)
    if sets.where(F.col("n") > SHORT).isEmpty():
        return at_once
    whole = lambda side: sets.select(F.col("e").alias(f"e_{side}"), F.col("f").alias(f"f_{side}"), F.col("n").alias(f"n_{side}"))
    long = met.where(~short).select("e_lo", "e_hi").distinct().join(whole("lo"), "e_lo").join(whole("hi"), "e_hi").withColumn("both", F.size(F.array_intersect("f_lo", "f_hi")).cast("long"))
    return at_once.unionByName(long.select(*shape).where(F.col("jaccard") >= least))


def containment(presence: DataFrame, entity: str, feature: str) -> DataFrame:
    """Directed (query, reference, value): percent of the query's features that the reference has."""
    way = lambda a, b: F.struct(F.col(a).alias("query"), F.col(b).alias("reference"), (100 * F.col("both") / F.col(f"n_{a}")).alias("value"))
    return jaccard(presence, entity, feature).select(F.explode(F.array(way("lo", "hi"), way("hi", "lo"))).alias("x")).select("x.*")


def reciprocal_containment(presence: DataFrame, entity: str, feature: str) -> DataFrame:
    """The reciprocal_mean() of containment(), made with each pair: (lo, hi, value, difference). Nothing is shuffled after the pairs."""
    ab, ba = (100 * F.col("both") / F.col(n) for n in ("n_lo", "n_hi"))
    return jaccard(presence, entity, feature).select("lo", "hi", ((ab + ba) / 2).alias("value"), F.abs(ab - ba).alias("difference"))


def endpoints(pairs: DataFrame, *keep: str) -> DataFrame:
    """Each pair from both ends: (entity, partner, *keep), by one explode."""
    both = F.array(F.struct(F.col("lo").alias("entity"), F.col("hi").alias("partner")), F.struct(F.col("hi").alias("entity"), F.col("lo").alias("partner")))
    return pairs.select(F.explode(both).alias("e"), *keep).select("e.*", *keep)


def symmetric(pairs: DataFrame, value: str, diagonal: float = 100.0) -> DataFrame:
    """(a, b, value) both ways and with the diagonal; missing values become the least one."""
    known = pairs.select("lo", "hi", F.col(value).alias("value"))
    least = known.agg(F.min("value").alias("least"))
    filled = known.join(F.broadcast(least)).select("lo", "hi", F.coalesce("value", "least").alias("value"))  # with one row
    out = filled.selectExpr("lo a", "hi b", "value").unionByName(filled.selectExpr("hi a", "lo b", "value"))
    ends = endpoints(known).select("entity").distinct()
    return out.unionByName(ends.select(F.col("entity").alias("a"), F.col("entity").alias("b"), F.lit(diagonal).alias("value")))


def largest_pairs(pairs: DataFrame, value: str) -> DataFrame:
    """All pairs that tie for the largest value: an aggregate of one row, joined back."""
    top = pairs.agg(F.max(value).alias("top"))
    return pairs.join(F.broadcast(top), F.col(value) == F.col("top")).drop("top")  # with one row


def class_counts(values: DataFrame, value: str, classes: list[tuple[str, Column]], count: str | None = None) -> DataFrame:
    """(class, n, percent) for named, maybe overlapping conditions, in one pass. ``count``: how many equal values a row stands for."""
    number = lambda c: F.count_if(c) if count is None else F.coalesce(F.sum(F.when(c, F.col(count))), F.lit(0)).cast("long")
    counts = values.agg(number(F.col(value).isNotNull()).alias("total"), *(number(c).alias(f"c{i}") for i, (_, c) in enumerate(classes)))
    rows = F.explode(F.array(*(F.struct(F.lit(name).alias("class"), F.col(f"c{i}").alias("n")) for i, (name, _) in enumerate(classes))))
    return counts.select("total", rows.alias("r")).select("r.*", F.round(F.try_divide(F.col("r.n") * 100.0, F.col("total")), 6).alias("percent"))
