"""Curves, quantiles and differences come from counts of equal values; nothing is shuffled after pairs are made."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomgrid.operators import pairs, summary
from loomgrid.operators.quantiles import quantiles
from loomgrid.plans import tables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("span", [0.1, 0.75])
def test_counted_points_give_the_same_curve(spark, span):
    rng = random.Random(4)
    points = [(rng.choice([0.0, 0.1, 0.3, 0.31, 0.9, 1.0]), rng.choice([0.0, 0.5, 1.0])) for _ in range(300)] + [(i / 40, 0.25) for i in range(40)]
    plain = spark.createDataFrame(points, "x double, y double")
    got = summary.loess(plain.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")), "x", "y", span, points=15, count="n")
    for r in got.orderBy("i").collect():
        xs = sorted(abs(x - r.x) for x, _ in points)
        h = xs[int(len(points) * span + 1e-5) - 1]
        if h == 0:
            continue
        w = [((1 - (abs(x - r.x) / h) ** 3) ** 3, (x - r.x) / h, y) for x, y in points if abs(x - r.x) < h]
        import numpy as np

        a = np.array([[v**k for k in range(3)] for _, v, _ in w]) * np.sqrt([[u] for u, _, _ in w])
        b = np.array([y for _, _, y in w]) * np.sqrt([u for u, _, _ in w])
        if np.linalg.matrix_rank(a) == 3:
            assert r.y == pytest.approx(np.linalg.lstsq(a, b, rcond=None)[0][0], abs=1e-6)


def test_curve_reads_counts_and_not_pairs(spark, monkeypatch):
    monkeypatch.setattr(tables, "jaccard", lambda *a: pytest.fail("the pairs were written"))
    assert entry.queries()["loess_curve"](spark, SF).count() == 20


def test_quantiles_of_counted_values(spark, monkeypatch):
    rng = random.Random(8)
    plain = spark.createDataFrame([(rng.choice([-1.5, 0.1, 0.2, 3.0]),) for _ in range(57)], "v double")
    counted = plain.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    for discrete in (False, True):
        want = sorted(map(tuple, quantiles(plain, "v", shares, discrete=discrete).collect()))
        assert sorted(map(tuple, quantiles(counted, "v", shares, discrete=discrete, count="n").collect())) == want
    want = summary.describe(plain, "v").first().asDict()
    monkeypatch.setattr(summary, "GATHERED", 0)
    got = summary.describe(counted, "v", "n").first().asDict()
    assert list(got) == list(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_reciprocal_means_are_made_with_the_pairs(spark):
    own = tables.presence(spark, SF)
    want = pairs.reciprocal_mean(pairs.containment(own, "entity", "feature"), "query", "reference", "value")
    got = pairs.reciprocal_containment(own, "entity", "feature")
    columns = ["lo", "hi", "value", "difference"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert shuffles(got) < shuffles(want)
