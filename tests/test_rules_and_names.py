import itertools
import random

import numpy as np
import pytest

from loomgrid.operators import assign, models, summary


def test_diagram_equals_the_alternatives():
    rng = random.Random(3)

    def rule(depth):
        if not depth or rng.random() < 0.2:
            return rng.choice("abcdef")
        return "(" + rng.choice([" and ", " or ", " AND "]).join(rule(depth - 1) for _ in range(rng.randint(1, 3))) + ")"

    diagram = models.Diagram()
    for _ in range(150):
        text = rule(3)[1:-1] if rng.random() < 0.5 else rule(3)
        try:
            root = diagram.root(text)
        except ValueError:  # a bracket cut off
            continue
        sets = models.rule_alternatives(text) or [[]]
        for k in range(7):
            for have in itertools.combinations("abcdef", k):
                assert diagram.holds(root, {diagram.order[g] for g in have if g in diagram.order}) == any(set(s) <= set(have) for s in sets), text


def test_rules_with_many_alternatives_and_broken_ones(spark, monkeypatch):
    text = " and ".join(f"(a{i} or b{i})" for i in range(30))
    diagram = models.Diagram()
    root = diagram.root(text)
    assert len(diagram.nodes) < 3000
    have = {diagram.order[f"{'ab'[i % 2]}{i}"] for i in range(30)}
    assert diagram.holds(root, have) and not diagram.holds(root, have - {diagram.order["a4"]})
    assert diagram.root(None) == diagram.root("  ") == 1
    for bad in ("a and", "or b", "(a", "a)", "a b", "()"):
        with pytest.raises(ValueError):
            models.Diagram().root(bad)
    reactions = spark.createDataFrame([("r", text), ("free", None), ("one", "x")], "reaction string, rule string")
    strains = spark.createDataFrame([(1, [f"a{i}" for i in range(30)]), (2, ["x"]), (3, None)], "strain int, genes array<string>")
    want = {(1, "r"), (1, "free"), (2, "one"), (2, "free"), (3, "free")}
    for size in (1, 20_000):
        monkeypatch.setattr(models, "BLOCK_REACTIONS", size)
        assert {tuple(r) for r in models.drafts_by_rule(reactions, strains).collect()} == want
    assert {tuple(r) for r in models.drafts_by_rule(reactions, strains, ["x"]).collect()} == want | {(1, "one"), (3, "one")}


def test_names_within_texts(spark):
    rng = random.Random(1)
    names = ["".join(rng.choices("AB1", k=rng.randint(1, 4))) for _ in range(25)] + ["AB", "ABA", ""]
    texts = ["".join(rng.choices("AB1_", k=rng.randint(0, 12))) for _ in range(200)] + ["", None, "xyz"]
    got = assign.names_within(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, file string"), "file", spark.createDataFrame([(n,) for n in [*names, None]], "strain string"), "strain")
    for r in got.collect():
        inside = {n for n in names if n and n in (texts[r.i] or "")}
        best = {n for n in inside if len(n) == max(map(len, inside))}
        assert (r.strain, r.ambiguous) == (min(best) if best else None, len(best) > 1)
    assert got.count() == len(texts)


@pytest.mark.parametrize("span,degree", [(0.75, 2), (0.3, 1), (1.0, 2)])
def test_loess_against_brute_force(spark, span, degree):
    rng = np.random.default_rng(7)
    x = np.round(rng.gamma(2, 2, 2000), 3)
    y = np.sin(x) + rng.normal(0, 0.3, 2000)
    got = summary.loess(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0)], "x double, y double").repartition(5), "x", "y", span, degree, 30).orderBy("i").collect()
    for r, p in zip(got, np.linspace(x.min(), x.max(), 30), strict=True):
        h = np.sort(np.abs(x - p))[int(2000 * span + 1e-5) - 1]
        w = np.clip(1 - (np.abs(x - p) / h) ** 3, 0, None) ** 1.5
        fit = np.linalg.lstsq(np.vander((x - p) / h, degree + 1, increasing=True) * w[:, None], y * w, rcond=None)[0][0]
        assert r.x == pytest.approx(p) and r.y == pytest.approx(fit, abs=1e-6)


def test_loess_of_few_places(spark):
    frame = lambda rows: spark.createDataFrame(rows, "x double, y double")
    assert [r.y for r in summary.loess(frame([(1.0, 2.0), (1.0, 4.0)]), "x", "y", points=3).collect()] == pytest.approx([3.0] * 3)
    assert summary.loess(frame([]), "x", "y").count() == 0
