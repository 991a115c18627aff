"""Similarities are counted where they are made; pairs within a nation are made alone."""

import random

from pyspark.sql import functions as F

from loomgrid.operators import summary
from loomgrid.plans import tables

SF = "/root/testdata/sf0.001"


def test_counted_values_give_the_same_summary_and_cuts(spark):
    rng = random.Random(2)
    values = [rng.choice([0.1, 0.25, 0.5, 0.75, None]) for _ in range(200)]
    plain = spark.createDataFrame([(v,) for v in values], "x double")
    counted = plain.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    want = summary.describe(plain, "x").first().asDict()
    got = summary.describe(counted, "x", "n").first().asDict()
    assert list(got) == list(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    shares = {f"p{i}": i / 20 for i in range(1, 21)}
    disc = plain.agg(*(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY x)").alias(n) for n, p in shares.items())).first()
    assert summary.discrete_cuts(counted, "x", "n", shares).first().asDict() == disc.asDict()


def test_pairs_are_counted_and_those_within_nations_made_alone(spark):
    pairs = tables.jaccard(spark, SF).withColumn("phenotype", tables.phenotype())
    counts = tables.similarity_counts(spark, SF, "phenotype")
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, pairs.groupBy("jaccard", "phenotype").count().collect()))
    cols = ["lo", "hi", "jaccard", "phenotype", "g_lo", "g_hi"]
    within = tables.grouped_pairs(spark, SF).where("g_lo = g_hi").select(cols)
    assert sorted(map(tuple, tables.pairs_within(spark, SF).select(cols).collect())) == sorted(map(tuple, within.collect()))
