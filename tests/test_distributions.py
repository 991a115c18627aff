import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrid.functions import exact
from loomgrid.operators import summary
from loomgrid.operators.quantiles import quantiles


def samples():
    rng = np.random.default_rng(3)
    yield rng.random(3000)
    yield np.r_[rng.normal(0, 1, 1500), rng.normal(5, 1, 900)]
    yield np.round(rng.normal(0, 1, 2500), 1)  # many ties
    yield np.r_[np.arange(50) * 1e-3, 1 + np.arange(50) * 1e-3]
    yield np.exp(rng.normal(0, 2, 1200))
    yield np.arange(5.0)


@pytest.mark.parametrize("i", range(6))
def test_dip_from_any_division(i):
    x = np.sort(list(samples())[i])
    want, rank = exact.dip(x), np.arange(len(x))
    for parts in (1, 3, 7):
        deal = np.random.default_rng(parts).integers(0, parts, len(x))

        def over(job):
            return [job(x[deal == k], rank[deal == k]) for k in range(parts) if (deal == k).any()]

        assert exact.dip_of_parts(len(x), over) == pytest.approx(want, abs=1e-12)


def test_dip_of_many_values(spark):
    x = np.r_[np.random.default_rng(1).normal(0, 1, 60_000), np.random.default_rng(2).normal(3, 1, 40_000)]
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(5)
    got = summary.dip_test(df, "x", draws=8, size=20_000).first()
    assert got.n == 100_000 and got.dip == pytest.approx(exact.dip(x), abs=1e-12) and got.p == 0.0
    flat = summary.dip_test(spark.createDataFrame([(1.0,), (1.0,), (None,)], "x double"), "x", draws=2).first()
    assert flat.n == 2 and flat.dip == 0.25


def test_uniform_samples_in_blocks():
    blocks, whole = (np.array([exact.uniform_dip(500, [7, b], size) for b in range(150)]) for size in (40, 1000))
    plain = np.array([exact.dip(np.random.default_rng(b).random(500)) for b in range(150)])
    assert abs(blocks.mean() - plain.mean()) < 0.001 and abs(whole.mean() - plain.mean()) < 0.001


def test_bootstrap_rates_agree_with_plain_resampling(spark):
    rng = np.random.default_rng(11)
    x = np.r_[rng.normal(0, 0.3, 240), rng.normal(2, 0.4, 60)]
    df, found, width = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(4), [0.0, 2.0], 0.15
    grid = np.linspace(x.min() - 3 * width, x.max() + 3 * width, 200)
    kernels = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / width) ** 2)
    want = np.zeros(2)
    for _ in range(2000):
        y = kernels @ rng.multinomial(len(x), np.full(len(x), 1 / len(x)))
        at = grid[1:-1][(y[1:-1] > y[:-2]) & (y[1:-1] > y[2:]) & (y[1:-1] > 0.03 * y.max())]
        want += [np.abs(at - p).min() <= 0.1 for p in found]
    got = {r.peak: r.rate for r in summary.bootstrap_peaks(df, "x", found, width, times=600, tolerance=0.1, grid=200, size=37).collect()}
    for p, w in zip(found, want / 2000, strict=True):
        assert abs(got[p] - w) < 4 * np.sqrt(w * (1 - w) / 600) + 0.02
    assert [r.rate for r in summary.bootstrap_peaks(df.where("x > 100"), "x", found, width, times=5).collect()] == [None, None]


def test_quantiles_equal_the_sorted_values(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(f"g{i % 3}", float(v)) for i, v in enumerate(np.r_[rng.normal(0, 1e3, 400), np.round(rng.normal(0, 1, 400), 1), [0.0, -0.0, 1e-310, -1e308, 1e308]])] + [("one", 5.0), ("g1", None), ("none", None)]
    df, shares = spark.createDataFrame(rows, "g string, x double").repartition(5), [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    held = {g: np.sort([v for h, v in rows if h == g and v is not None]) for g in ("g0", "g1", "g2", "one")}
    got = {(r.g, r.share): r.value for r in quantiles(df, "x", shares, ["g"]).collect()}
    plain = {(r.g, s): v for r in df.where("x IS NOT NULL").groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, shares))).alias("q")).collect() for s, v in zip(shares, r.q, strict=True)}
    assert got == plain and set(got) == {(g, s) for g in held for s in shares}
    low = {(r.g, r.share): r.value for r in quantiles(df, "x", shares, ["g"], discrete=True).collect()}
    assert low == {(g, s): v[max(0, int(np.ceil(s * len(v))) - 1)] for g, v in held.items() for s in shares}
    want = summary.describe(df, "x").first()
    assert quantiles(df.where("x > 1.5e308"), "x", [0.5]).count() == 0
    by_step = {r.g: tuple(r)[1:] for r in summary.accumulation(df.where("x IS NOT NULL"), "g", "x").collect()}
    monkeypatch.setattr(summary, "GATHERED", 10)
    assert summary.describe(df, "x").first() == want and summary.describe(df.where("false"), "x").first().n == 0
    again = {r.g: tuple(r)[1:] for r in summary.accumulation(df.where("x IS NOT NULL"), "g", "x").collect()}
    assert set(again) == set(by_step) and all(again[g] == pytest.approx(by_step[g]) for g in again)


def test_rows_that_stand_for_many_equal_values(spark):
    rng = np.random.default_rng(8)
    x = np.round(np.r_[rng.normal(0, 0.3, 3000), rng.normal(2, 0.3, 2000)], 1)
    each, number = np.unique(x, return_counts=True)
    many = spark.createDataFrame([(float(v), 1) for v in x], "x double, n long").repartition(3)
    few = spark.createDataFrame([(float(v), int(k)) for v, k in zip(each, number, strict=True)], "x double, n long").repartition(3)
    assert summary.gaps(few, "x", [(0.0, 0.5), (0.9, 1.1)], "n").collect() == summary.gaps(many, "x", [(0.0, 0.5), (0.9, 1.1)]).collect()
    assert summary.gap_chi_square(few, "x", 0.9, 1.1, "n").collect() == summary.gap_chi_square(many, "x", 0.9, 1.1).collect()
    a, b = ([r.y for r in summary.density(d, "x", -1, 3, 40, 0.2, c).orderBy("i").collect()] for d, c in ((few, "n"), (many, None)))
    assert a == pytest.approx(b, rel=1e-12)
    few_dip, many_dip = summary.dip_test(few, "x", draws=10, count="n").first(), summary.dip_test(many, "x", draws=10).first()
    assert few_dip == many_dip and few_dip.n == 5000 and few_dip.dip == pytest.approx(exact.dip(x), abs=1e-12)
    a, b = ({r.peak: r.rate for r in summary.bootstrap_peaks(d, "x", [0.0, 2.0], 0.05, times=200, tolerance=0.05, grid=200, size=9, count=c).collect()} for d, c in ((few, "n"), (many, None)))
    assert all(abs(a[p] - b[p]) < 0.2 for p in a)


def test_bounds_of_uniform_dips_decide_as_whole_samples(monkeypatch):
    monkeypatch.setattr(exact, "CELLS", 256)
    monkeypatch.setattr(exact, "CELL_VALUES", 4)
    n = 4000
    for b in range(12):
        whole = exact._uniform_dip(n, [3, b], np.random.default_rng([3, b]).multinomial(n, np.full(256, 1 / 256)))
        for own in (0.3 * whole, 0.999 * whole, whole, 1.001 * whole, 4 * whole):
            assert exact.uniform_dip_reaches(own, n, [3, b]) == (whole >= own)
