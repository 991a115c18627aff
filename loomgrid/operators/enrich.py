"""Per-feature 2x2 counts over labelled pairs, false-discovery control, case-control and recurrence.

All features are counted by two equi-joins and one aggregation each; there is
no product of pairs and features. With d(f) the incidences of f at ends of
pairs and b(f) the pairs that have it at both ends, d - 2 b pairs mismatch and
N - d + b have it at neither end.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pairs as P
from .stored import numbered, stored


def pair_counts(presence: DataFrame, labelled: DataFrame, entity: str, feature: str) -> DataFrame:
    """(feature, both_d, both_k, one_d, one_k, none_d, none_k).

    ``labelled``: (lo, hi, disc boolean). Suffix d: discriminating pairs, k: the others.
    """
    degree = P.endpoints(labelled, "disc").groupBy("entity").agg(F.count_if("disc").alias("deg_d"), F.count_if(~F.col("disc")).alias("deg_k"))
    own = stored(presence.select(F.col(entity).alias("entity"), F.col(feature).alias("feature")), "presence")
    ends = own.join(degree, "entity").groupBy("feature").agg(F.sum("deg_d").alias("d"), F.sum("deg_k").alias("k"))
    both = _labels_in_lists(P.common_lists(own, "entity", "feature"), labelled, -(-own.count() // BLOCK_LISTS)).groupBy("feature").agg(F.sum("d").alias("both_d"), F.sum("k").alias("both_k"))
    totals = labelled.agg(F.count_if("disc").alias("n_d"), F.count_if(~F.col("disc")).alias("n_k"))
    out = ends.join(both, "feature", "left").fillna(0, ["both_d", "both_k"]).join(F.broadcast(totals))  # with one row
    return out.select(
        "feature", "both_d", "both_k",
        (F.col("d") - 2 * F.col("both_d")).alias("one_d"), (F.col("k") - 2 * F.col("both_k")).alias("one_k"),
        (F.col("n_d") - F.col("d") + F.col("both_d")).alias("none_d"), (F.col("n_k") - F.col("k") + F.col("both_k")).alias("none_k"),
    )


#: About so many lists of partners, with the labels of their pairs, are looked up in one task.
BLOCK_LISTS = 500_000


def _labels_in_lists(lists: DataFrame, labelled: DataFrame, n: int) -> DataFrame:
    """(feature, d, k): of each list (lo, feature, his) how many of its pairs are labelled so.

    Lists and labels are dealt into ``n`` blocks by ``lo`` and meet there, so no row for a pair and a feature is shuffled.
    """
    block = F.pmod(F.xxhash64("lo"), F.lit(max(1, n))).cast("int").alias("block")

    def found(a: pa.Table, b: pa.Table) -> pa.Table:
        his, sizes = a["his"].combine_chunks(), pc.list_value_length(a["his"]).to_numpy()
        listed, lo, hi = (x.to_numpy(zero_copy_only=False) for x in (his.flatten(), b["lo"].combine_chunks(), b["hi"].combine_chunks()))
        if not len(lo) or not len(listed):
            return pa.table({"feature": a["feature"].slice(0, 0), "d": pa.array([], pa.int64()), "k": pa.array([], pa.int64())})
        firsts, first = np.unique(lo, return_inverse=True)
        seconds, second = np.unique(hi, return_inverse=True)
        key = first.astype(np.int64) * len(seconds) + second
        order = np.argsort(key)
        key, disc = key[order], b["disc"].to_numpy()[order].astype(bool)
        own = a["lo"].to_numpy()
        row = np.minimum(np.searchsorted(firsts, own), len(firsts) - 1)
        counts = np.zeros((2, len(sizes)), np.int64)
        starts = np.r_[0, np.cumsum(sizes)]
        for low in range(0, len(sizes), 1 << 16):  # lists at a time
            high = min(low + (1 << 16), len(sizes))
            of = np.repeat(np.arange(low, high), sizes[low:high])
            part = listed[starts[low] : starts[high]]
            column = np.minimum(np.searchsorted(seconds, part), len(seconds) - 1)
            asked = row[of].astype(np.int64) * len(seconds) + column
            place = np.minimum(np.searchsorted(key, asked), len(key) - 1)
            known = (key[place] == asked) & (seconds[column] == part) & (firsts[row[of]] == own[of])
            for side, label in enumerate((disc, ~disc)):
                counts[side, low:high] += np.bincount(of[known & label[place]] - low, minlength=high - low)
        some = np.flatnonzero(counts.sum(axis=0))
        return pa.table({"feature": a["feature"].take(pa.array(some)), "d": counts[0, some], "k": counts[1, some]})

    left, right = lists.select(block, "lo", "feature", "his"), labelled.select(block, "lo", "hi", "disc")
    schema = T.StructType([T.StructField("feature", lists.schema["feature"].dataType), T.StructField("d", T.LongType()), T.StructField("k", T.LongType())])
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(found, schema)


def tables(counts: DataFrame, kind: str) -> DataFrame:
    """2x2 tables (feature, a, b, c, d): ``shared`` counts pairs with the feature at both ends, ``mismatch`` at one; degenerate ones are left out."""
    if kind == "shared":
        rows = counts.selectExpr("feature", "both_d a", "both_k b", "one_d + none_d c", "one_k + none_k d")
    else:
        rows = counts.selectExpr("feature", "one_d a", "one_k b", "both_d + none_d c", "both_k + none_k d")
    return rows.where("a + b > 0 AND c + d > 0 AND a + c > 0 AND b + d > 0")


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("p", "odds", "low", "high")]))
def _fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
    from ..functions.exact import fisher

    return pd.DataFrame([fisher(*map(int, x)) for x in zip(a, b, c, d, strict=True)], columns=["p", "odds", "low", "high"])


@F.pandas_udf(T.DoubleType())
def _fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    from ..functions.exact import fisher_p

    return pd.Series([fisher_p(*map(int, x)) for x in zip(a, b, c, d, strict=True)], dtype=float)


def with_fisher(rows: DataFrame, only_p: bool = False) -> DataFrame:
    """p, odds, low and high of each table, or p alone, which is much less work. The rows are few bytes, so they are spread before."""
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if only_p:
        return rows.withColumn("p", _fisher_p("a", "b", "c", "d"))
    return rows.withColumn("t", _fisher("a", "b", "c", "d")).select("*", "t.*").drop("t")


def adjusted(rows: DataFrame, p: str, key: str, name: str = "fdr") -> DataFrame:
    """Benjamini-Hochberg. Ranks come from the distinct values of p, which are counted and taken the least of by range; null p stays null. ``rows`` is written once, as it is read twice."""
    rows = stored(rows, "p-values")
    values = rows.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    up = numbered(values, [F.col("__p")], "__at", sums={"__before": "__n"})
    total = values.agg(F.sum("__n").alias("__all"))
    scaled = up.join(F.broadcast(total)).select("__p", (F.col("__p") * F.col("__all") / (F.col("__before") + F.col("__n"))).alias("__q"))  # with one row
    down = numbered(scaled, [F.col("__p").desc()], "__at", mins={"__above": "__q"}).withColumn(name, F.least(F.lit(1.0), "__q", "__above"))
    return rows.join(down.select("__p", name), rows[p] == F.col("__p"), "left").drop("__p")


def stringent(rows: DataFrame, fdr: float = 0.05, least: int = 5, high: float = 2.0, low: float = 0.5) -> DataFrame:
    """Large, significant effects with enough pairs; infinite and NaN ratios are left out."""
    finite = (F.col("odds") > 0) & (F.col("odds") < float("inf")) & ~F.isnan("odds")
    return rows.where((F.col("fdr") < fdr) & ((F.col("odds") > high) | (F.col("odds") < low)) & (F.col("a") >= least) & finite)


def partner_summary(labelled: DataFrame) -> DataFrame:
    """(entity, n, n_merge, n_discriminate) over both ends of the pairs."""
    return P.endpoints(labelled, "disc").groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("disc")).alias("n_merge"), F.count_if("disc").alias("n_discriminate"))


def partner_lists(labelled: DataFrame) -> DataFrame:
    """The partner summary with both lists of partners, comma-joined in order of name."""
    ends = P.endpoints(labelled, "disc")
    names = lambda when: F.array_join(F.array_sort(F.collect_list(F.when(when, F.col("partner"))).cast("array<string>")), ", ")
    return ends.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("disc")).alias("n_merge"), F.count_if("disc").alias("n_discriminate"), names(~F.col("disc")).alias("merge_partners"), names(F.col("disc")).alias("disc_partners"))


def enrichment(presence: DataFrame, labelled: DataFrame, entity: str, feature: str, cls: str, kind: str) -> DataFrame:
    """(class, feature, a, b, c, d, p, odds, low, high, fdr, pct_a, pct_b) of all features of all classes, rates adjusted over all of them; percentages of discriminating and other pairs with the feature."""
    named = presence.select(F.struct(F.col(cls).alias("class"), F.col(feature).alias("feature")).alias("feature"), F.col(entity).alias(entity))
    rows = with_fisher(tables(pair_counts(named, labelled, entity, "feature"), kind))
    rows = adjusted(rows, "p", "feature")
    return rows.select("feature.class", "feature.feature", *(c for c in rows.columns if c != "feature"), (100.0 * F.col("a") / (F.col("a") + F.col("c"))).alias("pct_a"), (100.0 * F.col("b") / (F.col("b") + F.col("d"))).alias("pct_b"))


def focal_entities(labelled: DataFrame, merge: int = 3, discriminate: int = 5) -> DataFrame:
    return partner_summary(labelled).where((F.col("n_merge") >= merge) & (F.col("n_discriminate") >= discriminate))


#: A task counts the partners of so many focal entities with so many features, some partners at a time.
FOCAL_BLOCK, FEATURE_BLOCK, PARTNERS = 512, 4096, 2048
#: And about so many labels, or entities that have the features, of a block; more make more blocks.
BLOCK_ROWS = 4 << 20


#: A feature that a focal entity lacks is in a category only where this share of its discriminating partners has it (60 %, rounded to a decimal).
LEAST_SHARE = 0.599


def _lacking_cells(labelled: DataFrame, own: DataFrame, focal: DataFrame) -> DataFrame | None:
    """(entity, feature, has, m, d, n_merge, n_discriminate) of the cells that may fit a category where the entity lacks the feature; None without any.

    So many entities must have the feature that most of the discriminating partners can be among
    them. Entities and features are put into classes by powers of two of these numbers, and only
    blocks of classes that can fit meet.
    """
    having = stored(own.groupBy("feature").agg(F.count(F.lit(1)).alias("k")), "having")
    least, most = focal.agg(F.min("n_discriminate")).first()[0], having.agg(F.max("k")).first()[0]
    if least is None or most is None or most < LEAST_SHARE * least:
        return None
    log2 = lambda c: (F.length(F.bin(F.col(c))) - 1).cast("int")
    some = focal.where(F.col("n_discriminate") * LEAST_SHARE <= most).withColumn("of", log2("n_discriminate"))
    often = having.where(F.col("k") >= LEAST_SHARE * least).withColumn("of", log2("k"))
    left = P.endpoints(labelled, "disc").join(some, "entity")
    right = own.join(often, "feature")
    n_focal = {r.of: max(1, -(-r.n // FOCAL_BLOCK), -(-r.rows // BLOCK_ROWS)) for r in some.groupBy("of").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("n_merge") + F.col("n_discriminate")).alias("rows")).collect()}  # a row for each power of two
    n_features = {r.of: max(1, -(-r.n // FEATURE_BLOCK), -(-r.rows // BLOCK_ROWS)) for r in often.groupBy("of").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("rows")).collect()}

    def dealt(df: DataFrame, key: str, mine: dict, theirs: dict, meets, own_name: str, other: str) -> DataFrame:
        start = lambda sizes: dict(zip(sorted(sizes), np.r_[0, np.cumsum([sizes[c] for c in sorted(sizes)])].tolist(), strict=False))
        at, there = start(mine), start(theirs)
        block, others = F.lit(None).cast("int"), F.array().cast("array<int>")
        for c in mine:
            block = F.when(F.col("of") == c, F.pmod(F.xxhash64(key), F.lit(mine[c])).cast("int") + at[c]).otherwise(block)
            met = [F.sequence(F.lit(there[o]), F.lit(there[o] + theirs[o] - 1)) for o in theirs if meets(c, o)]
            if met:
                others = F.when(F.col("of") == c, F.concat(*met)).otherwise(others)
        return df.withColumn(own_name, block).withColumn(other, F.explode(others)).drop("of", "k")

    return _fitting_cells(dealt(left, "entity", n_focal, n_features, lambda e, f: f >= e - 1, "i", "j"), dealt(right, "feature", n_features, n_focal, lambda f, e: f >= e - 1, "j", "i"))


def _having_cells(labelled: DataFrame, own: DataFrame, merge: int, discriminate: int) -> DataFrame:
    """The same of the cells where the focal entity has the feature: its labels meet the lists of those that share the feature, block by block."""
    kinds = {c: own.schema[c].dataType for c in ("entity", "feature")}
    n = max(1, -(-5 * own.count() // BLOCK_LISTS), -(-2 * labelled.count() // BLOCK_ROWS))  # lists are whole here, and nothing is copied for a block
    block = F.pmod(F.xxhash64("entity"), F.lit(n)).cast("int").alias("block")
    lists = own.groupBy("feature").agg(F.collect_set("entity").alias("all")).select("feature", "all", F.explode("all").alias("entity")).select(block, "entity", "feature", "all")
    ends = P.endpoints(labelled, "disc").select(block, "entity", "partner", "disc")
    schema = T.StructType([T.StructField("entity", kinds["entity"]), T.StructField("feature", kinds["feature"]), T.StructField("has", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("m", "d", "n_merge", "n_discriminate"))])

    def found(a: pa.Table, b: pa.Table) -> pa.Table:
        none = pa.table({"entity": a["entity"].slice(0, 0), "feature": a["feature"].slice(0, 0), "has": pa.array([], pa.bool_()), **{c: pa.array([], pa.int64()) for c in ("m", "d", "n_merge", "n_discriminate")}})
        if not len(a) or not len(b):
            return none
        sizes, listed = pc.list_value_length(a["all"]).to_numpy(), a["all"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        firsts, first = np.unique(b["entity"].combine_chunks().to_numpy(zero_copy_only=False), return_inverse=True)
        seconds, second = np.unique(b["partner"].combine_chunks().to_numpy(zero_copy_only=False), return_inverse=True)
        disc = b["disc"].combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        totals = np.bincount(first[~disc], minlength=len(firsts)), np.bincount(first[disc], minlength=len(firsts))
        key, place = np.unique(first.astype(np.int64) * len(seconds) + second, return_inverse=True)
        labels = np.bincount(place[~disc], minlength=len(key)), np.bincount(place[disc], minlength=len(key))
        who = a["entity"].combine_chunks().to_numpy(zero_copy_only=False)
        row = np.minimum(np.searchsorted(firsts, who), len(firsts) - 1)
        focal = (firsts[row] == who) & (totals[0][row] >= merge) & (totals[1][row] >= discriminate)
        counts, starts = np.zeros((2, len(sizes)), np.int64), np.r_[0, np.cumsum(sizes)]
        for low in range(0, len(sizes), 1 << 16):  # lists at a time
            high = min(low + (1 << 16), len(sizes))
            of = np.repeat(np.arange(low, high), sizes[low:high])
            part = listed[starts[low] : starts[high]]
            column = np.minimum(np.searchsorted(seconds, part), len(seconds) - 1)
            asked = row[of].astype(np.int64) * len(seconds) + column
            at = np.minimum(np.searchsorted(key, asked), len(key) - 1)
            known = (key[at] == asked) & (seconds[column] == part) & focal[of]
            for side in range(2):
                counts[side, low:high] = np.bincount(of[known] - low, weights=labels[side][at[known]], minlength=high - low)
        n_m, n_d = (np.maximum(t[row], 1) for t in totals)
        pm, pd_ = 100 * counts[0] / n_m, 100 * counts[1] / n_d
        some = np.flatnonzero(focal & (pd_ <= 40.1) & ((pm >= 79.9) | (pd_ <= 30.1)))  # the exact rules, on rounded percentages, follow
        take = pa.array(some)
        return pa.table({"entity": a["entity"].take(take), "feature": a["feature"].take(take), "has": np.ones(len(some), bool), "m": counts[0, some], "d": counts[1, some], "n_merge": totals[0][row[some]].astype(np.int64), "n_discriminate": totals[1][row[some]].astype(np.int64)})

    return lists.groupBy("block").cogroup(ends.groupBy("block")).applyInArrow(found, schema)


def _fitting_cells(left: DataFrame, right: DataFrame) -> DataFrame:
    """(entity, feature, has, m, d, n_merge, n_discriminate) of the cells that may fit a category where the entity lacks the feature.

    m and d are products of the label matrix (focal entity by partner) with the
    presence matrix, for blocks (i, j) of both: no row is made for a focal entity, a
    partner and a feature, and cells that fit nothing are never written out.
    """
    kinds = {c: right.schema[c].dataType.simpleString() for c in ("entity", "feature")}

    def cells(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = ["entity", "feature", "has", "m", "d", "n_merge", "n_discriminate"]
        if a.empty or b.empty:
            return pd.DataFrame(columns=names)
        focal, row = np.unique(a["entity"].to_numpy(), return_inverse=True)
        features, column = np.unique(b["feature"].to_numpy(), return_inverse=True)
        partners, partner = np.unique(a["partner"].to_numpy(), return_inverse=True)
        disc, who = a["disc"].to_numpy(bool), b["entity"].to_numpy()
        at = np.minimum(np.searchsorted(partners, who), len(partners) - 1)
        known = partners[at] == who
        m, d = np.zeros((len(focal), len(features)), np.float32), np.zeros((len(focal), len(features)), np.float32)
        for low in range(0, len(partners), PARTNERS):
            size = min(PARTNERS, len(partners) - low)
            mine, theirs = (partner >= low) & (partner < low + size), known & (at >= low) & (at < low + size)
            have = np.zeros((size, len(features)), np.float32)
            have[at[theirs] - low, column[theirs]] = 1
            for out, label in ((m, ~disc), (d, disc)):
                links = np.zeros((len(focal), size), np.float32)
                np.add.at(links, (row[mine & label], partner[mine & label] - low), 1)
                out += links @ have
        has = np.zeros(m.shape, bool)
        place = np.minimum(np.searchsorted(focal, who), len(focal) - 1)
        own_rows = focal[place] == who
        has[place[own_rows], column[own_rows]] = True
        first = np.unique(row, return_index=True)[1]
        n_m, n_d = (a[c].to_numpy()[first] for c in ("n_merge", "n_discriminate"))
        pm, pd_ = 100 * m / n_m[:, None], 100 * d / n_d[:, None]
        slack = 0.1  # the exact rules, on rounded percentages, follow
        fits = ~has & (((pm <= 20 + slack) & (pd_ >= 60 - slack)) | (pd_ >= 70 - slack))
        x, y = np.nonzero(fits)
        return pd.DataFrame({"entity": focal[x], "feature": features[y], "has": has[x, y], "m": m[x, y].astype(np.int64), "d": d[x, y].astype(np.int64), "n_merge": n_m[x], "n_discriminate": n_d[x]})

    schema = f"entity {kinds['entity']}, feature {kinds['feature']}, has boolean, m long, d long, n_merge long, n_discriminate long"
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(cells, schema)


def case_control(presence: DataFrame, labelled: DataFrame, entity: str, feature: str, merge: int = 3, discriminate: int = 5) -> DataFrame:
    """(entity, feature, category, pct_merge, pct_discriminate) of focal entities.

    Percentages are of the merging and of the discriminating partners with the
    feature, rounded to one decimal before they are compared:
    1 focal has it, merging >= 80, discriminating <= 40; 2 focal lacks it,
    merging <= 20, discriminating >= 60; 3 has it, discriminating <= 30;
    4 lacks it, discriminating >= 70. A row may be in two categories.
    """
    focal = stored(focal_entities(labelled, merge, discriminate).drop("n"), "focal")
    own = stored(presence.select(F.col(entity).alias("entity"), F.col(feature).alias("feature")).dropna().distinct(), "presence")
    cells = _having_cells(labelled, own, merge, discriminate)
    if (lacking := _lacking_cells(labelled, own, focal)) is not None:
        cells = cells.unionByName(lacking)
    cells = cells.withColumns({"pct_merge": F.bround(100.0 * F.col("m") / F.col("n_merge"), 1), "pct_discriminate": F.bround(100.0 * F.col("d") / F.col("n_discriminate"), 1)})
    has, pm, pd_ = F.col("has"), F.col("pct_merge"), F.col("pct_discriminate")
    rules = [has & (pm >= 80) & (pd_ <= 40), ~has & (pm <= 20) & (pd_ >= 60), has & (pd_ <= 30), ~has & (pd_ >= 70)]
    named = F.filter(F.array(*(F.when(r, i) for i, r in enumerate(rules, 1))), lambda x: x.isNotNull())
    return cells.select("entity", "feature", F.explode(named).alias("category"), "pct_merge", "pct_discriminate")


def recurrent(candidates: DataFrame, least: int = 2) -> DataFrame:
    """(feature, category, n_focal, focal): candidates of several focal entities."""
    grouped = candidates.select("entity", "feature", "category").distinct().groupBy("feature", "category").agg(F.count(F.lit(1)).alias("n_focal"), F.array_join(F.array_sort(F.collect_set(F.col("entity").cast("string"))), ",").alias("focal"))
    return grouped.where(F.col("n_focal") >= least)
