import random

import pytest

from loomgrid.operators import pairs


@pytest.mark.parametrize("least", [0.05, 0.5, 0.75, 2 / 3, 1.0])
def test_same_pairs_as_the_full_join(spark, least):
    rng = random.Random(6)
    sets = [set(rng.choices("abcdefghijklmnop", weights=range(1, 17), k=rng.randint(1, 12))) for _ in range(120)]
    sets += [s | {"z"} for s in sets[:30]] + sets[:10] + [set("abc"), set("abcd"), set("abcdef")]
    rows = spark.createDataFrame([(i, f) for i, s in enumerate(sets) for f in s], "k long, item string")
    columns = ["lo", "hi", "both", "n_lo", "n_hi", "jaccard"]
    want = {tuple(r) for r in pairs.jaccard(rows, "k", "item").where(f"jaccard >= {least!r}D").select(*columns).collect()}
    assert {tuple(r) for r in pairs.jaccard_at_least(rows, "k", "item", least).select(*columns).collect()} == want and want


def test_bounds_and_no_rows(spark):
    rows = spark.createDataFrame([], "k long, item string")
    assert pairs.jaccard_at_least(rows, "k", "item", 0.5).count() == 0
    for bad in (0, 1.1, -1):
        with pytest.raises(ValueError):
            pairs.jaccard_at_least(rows, "k", "item", bad)


@pytest.mark.parametrize("short", [0, 5, 16])
def test_short_sets_are_compared_where_they_meet(spark, monkeypatch, short):
    monkeypatch.setattr(pairs, "SHORT", short)
    rng = random.Random(9)
    sets = [set(rng.choices("abcdefghijkl", weights=range(1, 13), k=rng.randint(1, 10))) for _ in range(80)]
    rows = spark.createDataFrame([(i, f) for i, s in enumerate(sets) for f in s], "k long, item string")
    want = {(i, j, len(x & y)) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j and len(x & y) >= 0.6 * len(x | y)}
    found = pairs.jaccard_at_least(rows, "k", "item", 0.6)
    assert sorted(tuple(r) for r in found.select("lo", "hi", "both").collect()) == sorted(want)
    assert short < 16 or "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
