"""Distribution summaries, gap tests, density estimates and resampling over one numeric column."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exact
from .quantiles import quantiles
from .stored import numbered, stored


#: More values than this are not gathered for a quantile but counted by their bits; both are exact.
GATHERED = 1_000_000


def describe(df: DataFrame, value: str, count: str | None = None) -> DataFrame:
    """n, min, q1, median, mean, q3, max, sd, iqr; quantiles are exact with linear interpolation. ``count``: how many equal values a row stands for."""
    if count is not None:
        v, n = F.col(value), F.col(count)
        known = stored(df.where(v.isNotNull()).select(value, count), "values")
        mean = known.agg(F.sum(n).alias("__n"), (F.sum(v * n) / F.sum(n)).alias("mean"))
        spread = F.sqrt(F.sum(n * (v - F.col("mean")) ** 2) / F.nullif(F.sum(n) - 1, F.lit(0)))
        plain = [F.coalesce(F.sum(n), F.lit(0)).alias("n"), F.min(v).alias("min"), F.first("mean").alias("mean"), F.max(v).alias("max"), spread.alias("sd")]
        shares = {"q1": 0.25, "median": 0.5, "q3": 0.75}
        both = known.join(F.broadcast(mean))  # mean: one row
        if known.count() <= GATHERED:
            one = both.agg(*plain, *(F.percentile(value, F.lit(p), n).alias(name) for name, p in shares.items()))
        else:
            found = quantiles(known, value, list(shares.values()), count=count).agg(*(F.max(F.when(F.col("share") == p, F.col("value"))).alias(name) for name, p in shares.items()))
            one = both.agg(*plain).join(F.broadcast(found))  # one row each
        one = one.select("n", "min", "q1", "median", "mean", "q3", "max", "sd")
        return one.withColumn("iqr", F.col("q3") - F.col("q1"))
    plain = [F.count(value).alias("n"), F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max"), F.stddev_samp(value).alias("sd")]
    shares = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    values = stored(df.select(value), "values")
    if values.count() <= GATHERED:
        one = values.agg(*plain, *(F.percentile(value, F.lit(p)).alias(n) for n, p in shares.items()))
    else:
        found = quantiles(values, value, list(shares.values())).agg(*(F.max(F.when(F.col("share") == p, F.col("value"))).alias(n) for n, p in shares.items()))
        one = values.agg(*plain).join(F.broadcast(found))  # one row each
    return one.select("n", "min", "q1", "median", "mean", "q3", "max", "sd").withColumn("iqr", F.col("q3") - F.col("q1"))


def _number(value: str, count: str | None, when: Column | None = None) -> Column:
    """How many values there are (and fulfil ``when``): rows, or the sum of ``count`` where a row stands for so many equal values."""
    known = F.col(value).isNotNull() if when is None else when
    return F.count_if(known) if count is None else F.coalesce(F.sum(F.when(known, F.col(count))), F.lit(0)).cast("long")


def gaps(df: DataFrame, value: str, windows: list[tuple[float, float]], count: str | None = None) -> DataFrame:
    """(lo, hi, observed, expected, ratio): values in [lo, hi] against an even spread over the range, in one pass. ``count``: how many equal values a row stands for."""
    one = df.agg(_number(value, count).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"), *(_number(value, count, F.col(value).between(a, b)).alias(f"w{i}") for i, (a, b) in enumerate(windows)))
    rows = F.explode(F.array(*(F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi"), F.col(f"w{i}").alias("observed")) for i, (a, b) in enumerate(windows))))
    out = one.select("total", "least", "most", rows.alias("r")).select("r.*", "total", "least", "most")
    expected = F.bround(F.col("total") * (F.col("hi") - F.col("lo")) / (F.col("most") - F.col("least")))
    return out.withColumn("expected", expected).withColumn("ratio", F.round(F.col("observed") / F.greatest("expected", F.lit(1.0)), 6)).select("lo", "hi", "observed", "expected", "ratio", "total")


def gap_chi_square(df: DataFrame, value: str, lo: float, hi: float, count: str | None = None) -> DataFrame:
    """(statistic, p) of the gap window against an even spread; null unless both expected counts exceed 5. ``count``: how many equal values a row stands for."""
    from ..functions.exact import chi_square_p

    p_of = F.pandas_udf(lambda s: s.map(lambda x: None if x is None or x != x else chi_square_p(x)), "double")
    one = df.agg(_number(value, count).alias("n"), _number(value, count, F.col(value).between(lo, hi)).alias("inside"), ((F.lit(hi) - lo) / (F.max(value) - F.min(value))).alias("share"))
    e_in, e_out = F.col("n") * F.col("share"), F.col("n") * (1 - F.col("share"))
    stat = F.when((e_in > 5) & (e_out > 5), F.pow(F.col("inside") - e_in, 2) / e_in + F.pow(F.col("n") - F.col("inside") - e_out, 2) / e_out)
    return one.select("n", "inside", stat.alias("statistic")).withColumn("p", p_of("statistic"))


def bandwidth(df: DataFrame, value: str) -> float:
    """R's rule nrd0."""
    d = describe(df, value).first()
    spread = min(d["sd"], d["iqr"] / 1.34) or d["sd"] or abs(d["min"]) or 1.0
    return 0.9 * spread * d["n"] ** -0.2


def _counted(df: DataFrame, value: str, count: str | None) -> DataFrame:
    """(x, n): values and how many each row stands for, without nulls and NaN."""
    n = F.lit(1) if count is None else F.col(count)
    rows = df.select(F.col(value).cast("double").alias("x"), n.cast("long").alias("n"))
    return rows.where(F.col("x").isNotNull() & ~F.isnan("x") & (F.col("n") > 0))


def density(df: DataFrame, value: str, low: float, high: float, n: int = 512, width: float | None = None, count: str | None = None) -> DataFrame:
    """(i, x, y): Gaussian kernel density on an even grid. Each partition sums its values on the grid; the sums are added. ``count``: how many equal values a row stands for; ``width`` must be given then."""
    if count and not width:
        raise ValueError("the rule for the width takes values one by one")
    width = width or bandwidth(df, value)
    grid = np.linspace(low, high, n)

    def run(frames):
        total, number = np.zeros(n), 0
        for frame in frames:
            x, times = frame["x"].to_numpy(float), frame["n"].to_numpy(np.int64)
            for a in range(0, len(x), 2048):
                total += np.exp(-0.5 * ((grid[:, None] - x[None, a : a + 2048]) / width) ** 2) @ times[a : a + 2048].astype(float)
            number += int(times.sum())
        yield pd.DataFrame({"i": np.arange(n), "s": total, "n": number})

    sums = _counted(df, value, count).mapInPandas(run, "i int, s double, n long").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    step = (high - low) / (n - 1)
    return sums.select("i", (F.lit(low) + F.col("i") * step).alias("x"), (F.col("s") / (F.col("n") * width * float(np.sqrt(2 * np.pi)))).alias("y"))


def peaks(curve: DataFrame, least_share: float = 0.03) -> DataFrame:
    """Local maxima of a curve (i, x, y) above a share of its greatest value. A curve is a grid of fixed size."""
    w = Window.orderBy("i")
    top = curve.agg(F.max("y").alias("top"))
    near = curve.withColumns({"before": F.lag("y").over(w), "after": F.lead("y").over(w)}).join(F.broadcast(top))  # with one row
    return near.where((F.col("y") > F.col("before")) & (F.col("y") > F.col("after")) & (F.col("y") > least_share * F.col("top"))).select("i", "x", "y")


def density_minimum(curve: DataFrame, low: float, high: float) -> DataFrame:
    """(x, y, percent_of_max) of the least density in a window."""
    return curve.agg(F.min_by("x", F.when(F.col("x").between(low, high), F.col("y"))).alias("x"), F.min(F.when(F.col("x").between(low, high), F.col("y"))).alias("y"), F.max("y").alias("top")).select("x", "y", (100 * F.col("y") / F.col("top")).alias("percent_of_max"))


def _blocks(df: DataFrame, value: str, size: int, count: str | None) -> DataFrame:
    """(block, values, times): the values in arrays of at most ``size``, with how often each is there, written; block numbers are unique."""

    def run(frames):
        held, times = np.zeros(0), np.zeros(0, np.int64)
        for frame in frames:
            held, times = np.concatenate([held, frame["x"].to_numpy(float)]), np.concatenate([times, frame["n"].to_numpy(np.int64)])
            while len(held) >= size:
                yield pd.DataFrame({"values": [held[:size]], "times": [times[:size]]})
                held, times = held[size:], times[size:]
        if len(held):
            yield pd.DataFrame({"values": [held], "times": [times]})

    rows = _counted(df, value, count).mapInPandas(run, "values array<double>, times array<long>")
    return stored(rows.select(F.monotonically_increasing_id().alias("block"), "values", "times"), "blocks")


def bootstrap_peaks(df: DataFrame, value: str, found: list[float], width: float, times: int = 1000, tolerance: float = 0.02, grid: int = 512, seed: int = 1, size: int = 1 << 15, count: str | None = None) -> DataFrame:
    """(peak, rate): share of resamples with a density peak within the tolerance. ``count``: how many equal values a row stands for.

    Resampling has two levels: how many of its draws a replicate takes from each
    block of ``size`` rows is multinomial and follows from the replicate's seed
    and the numbers of values in the blocks, which is all that the driver learns;
    the draws within a block follow from (seed, replicate, block). A block gives
    the sum of its kernels on the grid for every replicate, as a product of
    matrices; these sums are added. So values stay where they are, and a
    replicate is a resample of all of them.
    """
    blocks = _blocks(df, value, size, count)
    spread = blocks.select("block", F.aggregate("times", F.lit(0).cast("long"), lambda a, b: a + b).alias("n"), F.array_min("values").alias("low"), F.array_max("values").alias("high")).orderBy("block").toPandas()  # a row for each block
    if not len(spread):
        return df.sparkSession.createDataFrame([(p, None) for p in found], "peak double, rate double")
    sizes, place = spread["n"].to_numpy(np.int64), {b: i for i, b in enumerate(spread["block"])}
    points = np.linspace(spread["low"].min() - 3 * width, spread["high"].max() + 3 * width, grid)
    at_once = 128

    def drawn(rng, n: int, often: np.ndarray, plain: bool) -> np.ndarray:
        """How often each value of a block is taken in n draws."""
        return np.bincount(rng.integers(0, len(often), n), minlength=len(often)) if plain else rng.multinomial(n, often / often.sum())

    def sums(frames):
        share = sizes / sizes.sum()
        draws = np.array([np.random.default_rng([seed, b]).multinomial(sizes.sum(), share) for b in range(times)])
        for frame in frames:
            for block, x, often in zip(frame["block"], frame["values"], frame["times"], strict=True):
                i, m = place[block], len(x)
                x, often = np.asarray(x, float), np.asarray(often, np.int64)
                plain = bool((often == 1).all())
                for first in range(0, times, at_once):
                    which = range(first, min(first + at_once, times))
                    taken = np.empty((m, len(which)))
                    for k, b in enumerate(which):
                        taken[:, k] = drawn(np.random.default_rng([seed, b, i]), draws[b, i], often, plain)
                    total = np.zeros((grid, len(which)))
                    for a in range(0, m, 2048):
                        total += np.exp(-0.5 * ((points[:, None] - x[None, a : a + 2048]) / width) ** 2) @ taken[a : a + 2048]
                    yield pd.DataFrame({"b": list(which), "y": list(total.T)})

    def hits(frame: pd.DataFrame) -> pd.DataFrame:
        y = np.sum(np.stack(frame["y"].tolist()), axis=0)
        at = points[1:-1][(y[1:-1] > y[:-2]) & (y[1:-1] > y[2:]) & (y[1:-1] > 0.03 * y.max())]
        return pd.DataFrame({"peak": found, "hit": [float(len(at) > 0 and np.abs(at - p).min() <= tolerance) for p in found]})

    spread_out = blocks.repartition(max(1, min(len(sizes), 10_000)), "block")
    return spread_out.mapInPandas(sums, "b int, y array<double>").groupBy("b").applyInPandas(hits, "peak double, hit double").groupBy("peak").agg(F.avg("hit").alias("rate"))


def dip_test(df: DataFrame, value: str, draws: int = 200, seed: int = 1, size: int = 1 << 20, count: str | None = None) -> DataFrame:
    """(n, dip, p): Hartigan's dip of a column, and the share of uniform samples of that size with a dip as large. ``count``: how many equal values a row stands for.

    Equal values are counted first; of their ranks only the first and the last can be
    a corner or lie farthest from a hull, so these two stand for all. Values are
    numbered in order by range. Any part of them gives the corners of
    its own convex minorant and concave majorant; the hull of all corners is that
    of all values, and corners are all that the driver sees. Uniform samples are
    drawn from their seeds, one task for each draw: the numbers of their values in
    cells bound the dip, and a sample that the bounds leave open is made whole, in
    sorted blocks of ``size``.
    """
    spark = df.sparkSession
    values = _counted(df, value, count).groupBy("x").agg(F.sum("n").alias("n"))
    placed = numbered(values, [F.col("x")], "at", sums={"before": "n"})
    ranked = stored(placed.select("x", F.explode(F.array_distinct(F.array("before", F.col("before") + F.col("n") - 1))).alias("rank")), "ranked")
    last, least, most = ranked.agg(F.max("rank"), F.min("x"), F.max("x")).first()
    n = 0 if last is None else last + 1
    if n < 2 or least == most:
        own = 1 / (2 * n) if n else float("nan")
    else:
        own = exact.dip_of_parts(n, lambda job: _over_parts(ranked, job))

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"large": [float(exact.uniform_dip_reaches(own, n, [seed, int(b)], size)) for b in frame["id"]]})

    at_least = spark.range(0, draws, 1, max(1, min(draws, 4 * spark.sparkContext.defaultParallelism))).mapInPandas(run, "large double").agg(F.avg("large").alias("p"))
    return at_least.select(F.lit(int(n)).cast("long").alias("n"), F.lit(float(own)).alias("dip"), "p")


def _over_parts(ranked: DataFrame, job) -> list:
    """``job`` over the batches of (x, rank), sorted by rank each; its results are merged within a task, then listed."""

    def run(frames):
        held = None
        for frame in frames:
            frame = frame.sort_values("rank")
            now = job(frame["x"].to_numpy(float), frame["rank"].to_numpy(np.int64))
            held = now if held is None else job.merge([held, now])
        if held is not None:
            yield pd.DataFrame({"result": [pickle.dumps(held)]})

    return [pickle.loads(bytes(r.result)) for r in ranked.select("x", "rank").mapInPandas(run, "result binary").collect()]


def loess(df: DataFrame, x: str, y: str, span: float = 0.75, degree: int = 2, points: int = 80, count: str | None = None) -> DataFrame:
    """(i, x, y): local regression on an even grid over the range of ``x``, by tricube weights over the share ``span`` of nearest points. ``count``: how many equal points a row stands for.

    Equal points are counted first. The nearest points of a place are neighbours in
    the order of x, so its bandwidth is the least, over all runs of that many
    neighbours, of the distance to the farther end: values of x, with the ranks they
    take, meet those that take the rank so many on from their first, by blocks of
    ranks, and one pass takes the least for the whole grid. A second pass sums the
    moments of the weighted regressions; only sums meet. Where the nearest points
    all lie at the place itself, the curve is their mean.
    """
    own = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), (F.lit(1) if count is None else F.col(count)).cast("long").alias("n")).dropna()
    rows = stored(own.groupBy("x", "y").agg(F.sum("n").alias("n")), "points")
    n, low, high, different = rows.agg(F.sum("n"), F.min("x"), F.max("x"), F.count(F.lit(1))).first()
    if not n:
        return df.sparkSession.createDataFrame([], "i int, x double, y double")
    grid = np.linspace(low, high, points)
    q = max(1, min(n, int(n * span + 1e-5)))

    def distances(frames):
        least = np.full(points, np.inf)
        for frame in frames:
            for a in range(0, len(frame), 4096):
                left, right = (frame[c].to_numpy(float)[None, a : a + 4096] for c in ("x", "right"))
                least = np.minimum(least, np.maximum(grid[:, None] - left, right - grid[:, None]).min(axis=1))
        yield pd.DataFrame({"i": np.arange(points), "h": least})

    block = lambda rank: F.floor(rank / F.lit(max(1, n // different))).cast("long")
    taken = stored(numbered(rows.groupBy("x").agg(F.sum("n").alias("n")), [F.col("x")], "number", sums={"before": "n"}), "ranks")
    last = F.col("before") + F.col("n") - 1
    right = taken.select(F.col("x").alias("right"), F.col("before").alias("from"), last.alias("to"), F.explode(F.sequence(block(F.col("before")), block(last))).alias("block"))
    left = taken.select("x", (F.col("before") + (q - 1)).alias("rank")).withColumn("block", block(F.col("rank")))
    ends = left.join(right, "block").where(F.col("rank").between(F.col("from"), F.col("to"))).select("x", "right")
    found = ends.mapInPandas(distances, "i int, h double").groupBy("i").agg(F.min("h").alias("h")).orderBy("i").toPandas()  # a row for each point of the grid
    width = np.maximum(found["h"].to_numpy(float), 0.0)
    names = [f"m{k}" for k in range(2 * degree + 1)] + [f"b{k}" for k in range(degree + 1)]

    def moments(frames):
        total = np.zeros((points, len(names)))
        for frame in frames:
            for a in range(0, len(frame), 4096):
                d = frame["x"].to_numpy(float)[None, a : a + 4096] - grid[:, None]
                u = np.where(width[:, None] > 0, d / np.where(width[:, None] > 0, width[:, None], 1.0), np.where(d == 0, 0.0, 2.0))
                w, v = np.where(np.abs(u) < 1, (1 - np.abs(u) ** 3) ** 3, 0.0) * frame["n"].to_numpy(float)[None, a : a + 4096], frame["y"].to_numpy(float)[None, a : a + 4096]
                total += np.stack([(w * u**k).sum(axis=1) for k in range(2 * degree + 1)] + [(w * v * u**k).sum(axis=1) for k in range(degree + 1)], axis=1)
        yield pd.DataFrame({"i": np.arange(points), **{c: total[:, k] for k, c in enumerate(names)}})

    sums = rows.mapInPandas(moments, "i int, " + ", ".join(f"{c} double" for c in names)).groupBy("i").agg(*(F.sum(c).alias(c) for c in names))

    def solve(frames):
        for frame in frames:
            t = frame[names].to_numpy(float)
            fits = [np.linalg.lstsq(np.array([[r[j + k] for k in range(degree + 1)] for j in range(degree + 1)]), r[2 * degree + 1 :], rcond=1e-12)[0][0] for r in t]
            yield pd.DataFrame({"i": frame["i"], "x": grid[frame["i"]], "y": np.array(fits, float)})

    return sums.mapInPandas(solve, "i int, x double, y double")


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, r, p, low, high)."""
    from ..functions.exact import pearson_test

    test = F.pandas_udf(lambda r, n: pd.DataFrame([pearson_test(a, int(b)) for a, b in zip(r, n, strict=True)], columns=["p", "low", "high"]), "p double, low double, high double")
    one = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("r"))
    return one.withColumn("t", test("r", "n")).select("n", "r", "t.*")


def accumulation(df: DataFrame, step: str, value: str) -> DataFrame:
    """Mean and box statistics of repeated values by step."""
    shares = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    rows = stored(df.select(step, value), "values")
    plain = [F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")]
    if rows.count() <= GATHERED:
        out = rows.groupBy(step).agg(*plain, *(F.percentile(value, F.lit(p)).alias(n) for n, p in shares.items()))
    else:
        found = quantiles(rows, value, list(shares.values()), [step]).groupBy(step).agg(*(F.max(F.when(F.col("share") == p, F.col("value"))).alias(n) for n, p in shares.items()))
        out = rows.groupBy(step).agg(*plain).join(found, step, "left")
    return out.select(step, "mean", "min", "q1", "median", "q3", "max")


def discrete_cuts(df: DataFrame, value: str, count: str, shares: dict[str, float]) -> DataFrame:
    """One row with, for each name, the least value up to which at least that share of the values lies. ``count``: how many equal values a row stands for; such rows are few."""
    known = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.sum(count).alias("__n"))
    upto = F.sum("__n").over(Window.orderBy(value))  # over one row for each value
    total = F.sum("__n").over(Window.partitionBy())
    ranked = known.withColumns({"__upto": upto, "__all": total})
    return ranked.agg(*(F.min(F.when(F.col("__upto") >= F.col("__all") * F.lit(p), F.col(value))).alias(name) for name, p in shares.items()))
