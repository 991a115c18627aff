"""Case-control cells of sparse tables come from lists of sharers, without copies of all labels and all presence for blocks."""

import random

import pytest

from loomgrid.operators import enrich


@pytest.mark.parametrize("block", [500_000, 7])
def test_both_kinds_of_cells_against_loops(spark, monkeypatch, block):
    monkeypatch.setattr(enrich, "BLOCK_LISTS", block)
    rng = random.Random(11)
    has = {e: {f for f in range(60) if rng.random() < (0.9 if f < 3 else 0.06)} for e in range(40)}
    has[39] = {99}  # a feature of one entity alone
    lab = [(a, b, rng.random() < 0.6) for a in range(40) for b in range(a + 1, 40) if rng.random() < (0.9 if a < 20 else 0.3)]
    want = set()
    for e in has:
        ends = [(b if a == e else a, d) for a, b, d in lab if e in (a, b)]
        m, d = [p for p, x in ends if not x], [p for p, x in ends if x]
        if len(m) < 3 or len(d) < 5:
            continue
        for f in set().union(*has.values()):
            pm, pd_ = (round(100.0 * sum(f in has[p] for p in x) / len(x), 1) for x in (m, d))
            own = f in has[e]
            want |= {(e, f, k, pm, pd_) for k, fits in enumerate((own and pm >= 80 and pd_ <= 40, not own and pm <= 20 and pd_ >= 60, own and pd_ <= 30, not own and pd_ >= 70), 1) if fits}
    presence = spark.createDataFrame([(e, f) for e, fs in has.items() for f in fs], "e int, f int")
    labelled = spark.createDataFrame(lab, "lo int, hi int, disc boolean")
    got = enrich.case_control(presence, labelled, "e", "f", 3, 5)
    assert {tuple(r) for r in got.collect()} == want and {x[2] for x in want} >= {3, 4}


def test_rare_features_make_no_blocks(spark, monkeypatch):
    monkeypatch.setattr(enrich, "_fitting_cells", lambda *a: pytest.fail("blocks of labels and presence were made"))
    presence = spark.createDataFrame([(e, f) for f in range(50) for e in (f % 40, (f + 1) % 40)], "e int, f int")
    labelled = spark.createDataFrame([(a, b, (a + b) % 3 > 0) for a in range(40) for b in range(a + 1, 40)], "lo int, hi int, disc boolean")
    got = enrich.case_control(presence, labelled, "e", "f", 3, 5)
    assert {r.category for r in got.collect()} == {3}
