"""Classes of features are named after they are counted, and never shuffled with the lists of partners."""

import pandas as pd
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomgrid.operators import enrich, pairs
from loomgrid.plans import tables

SF = "/root/testdata/sf0.001"


def test_lists_hold_features_alone_and_rows_are_the_same(spark, monkeypatch):
    named = tables.presence(spark, SF).join(tables.table(spark, SF, "part").select(F.col("p_partkey").alias("feature"), F.col("p_type").alias("kind")), "feature")
    want = enrich.enrichment(named, tables.labelled(spark, SF), "entity", "feature", "kind", "shared")
    columns = ["class", "feature", "a", "b", "c", "d", "p", "pct_a", "pct_b"]
    want = want.select(*(F.round(c, 6).alias(c) if c in ("p", "pct_a", "pct_b") else c for c in columns)).toPandas()
    seen = []
    plain = pairs.common_lists
    monkeypatch.setattr(pairs, "common_lists", lambda df, e, f: seen.append(df.schema[f].dataType.simpleString()) or plain(df, e, f))
    got = entry.queries()["shared_enrichment_by_class"](spark, SF).toPandas()
    assert got.columns.tolist() == columns and len(got)
    order = lambda df: df.sort_values("feature").reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want))
    assert "bigint" in seen and not any(kind.startswith("struct") for kind in seen)
