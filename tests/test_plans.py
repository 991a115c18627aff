"""Queries of loomgrid.plans judge every row of their tables: small tables against plain versions."""

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry


def write(folder, **tables):
    for name, columns in tables.items():
        pd.DataFrame(columns).to_parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def vectors(tmp_path_factory):
    """650 vectors: more than one block, and ids that don't start at 0."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(650, 6)).astype(np.float32)
    x[325:, 0] += 4
    sf = write(tmp_path_factory.mktemp("vectors"), embeddings={"vec_id": np.arange(650) + 150, "embedding": x.tolist(), "label": np.arange(650) % 2})
    x = x.astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return sf, (x @ x.T)[np.triu_indices(650, 1)].round(6)


def test_cosine_queries_see_all_vectors(spark, vectors):
    sf, values = vectors
    found = entry.queries()
    classes = {r["class"]: r.n for r in found["similarity_classes"](spark, sf).collect()}
    assert sum(classes.values()) == len(values) == 650 * 649 // 2
    assert abs(classes["high"] - (values > 0.3).sum()) <= 2 and abs(classes["negative"] - (values <= -0.1).sum()) <= 2
    gap = found["gap_chi_square"](spark, sf).first()
    assert gap.n == len(values) and abs(gap.inside - ((values >= 0.3) & (values <= 0.4)).sum()) <= 2
    curve = [r.y for r in found["kde_grid"](spark, sf).orderBy("i").collect()]
    grid = np.linspace(-0.6, 0.6, 256)
    want = [np.exp(-0.5 * ((g - values) / 0.02) ** 2).sum() / (len(values) * 0.02 * np.sqrt(2 * np.pi)) for g in grid]
    assert curve == pytest.approx(want, abs=1e-5)


def test_dip_test_sees_all_vectors(spark, vectors):
    from loomgrid.functions import exact

    sf, values = vectors
    assert entry.queries()["dip_test"](spark, sf).first().dip == pytest.approx(exact.dip(values), abs=1e-6)


def test_exclusion_and_clustering_take_all_suppliers(spark, tmp_path):
    keys = np.arange(1, 131)
    line = [(k, p) for k in keys for p in (1, 2 + k % 7, 20 + k % 11)]
    sf = write(tmp_path, supplier={"s_suppkey": keys, "s_nationkey": keys % 3}, nation={"n_nationkey": [0, 1, 2], "n_regionkey": [0, 0, 1]}, lineitem={"l_suppkey": [k for k, _ in line], "l_partkey": [p for _, p in line]})
    found = entry.queries()
    out = {(r.grp, r.entity) for r in found["min_exclusion"](spark, sf).collect()}
    grp = {int(k): int(k % 3 == 2) for k in keys}
    left = [k for k in grp if (grp[k], k) not in out]
    assert {k for _, k in out} & set(range(101, 131))
    assert all((a * 7 + b * 13) % 4 < 2 for a in left for b in left if a < b and grp[a] == grp[b])  # no violating pair is left
    labels = found["relabel"](spark, sf).collect()
    assert {r.entity for r in labels} == set(grp) and {r.entity for r in labels if r.status in ("New_subgroup", "Singleton")} == {k for _, k in out}
    assert found["relabel_violations"](spark, sf).count() == 0
    assert {r.item for r in found["linkage_cut"](spark, sf).collect()} == set(grp)
    assert found["cluster_blocks"](spark, sf).where("k = 3").selectExpr("max(last) AS n").first().n == 130
    assert found["newick_tree"](spark, sf).first().tree.count(",") == 129


def test_presence_and_drafts_read_all_of_lineitem(spark, tmp_path):
    sf = write(
        tmp_path,
        lineitem={"l_orderkey": [1, 1, 2], "l_suppkey": [1, 2, 2], "l_partkey": [2, 3, 5], "l_quantity": [1.0, 2.0, 50.0]},
        supplier={"s_suppkey": [1, 2], "s_nationkey": [0, 1]},
        part={"p_partkey": [2, 3, 5], "p_brand": ["Brand#11", "Brand#22", "Brand#33"], "p_type": ["SMALL TIN", "LARGE TIN", "PROMO TIN"]},
        nation={"n_nationkey": [0, 1, 2], "n_regionkey": [0, 0, 0]},
    )
    found = entry.queries()
    wide = {r.nation: {k for k, v in r.asDict().items() if k != "nation" and v} for r in found["presence_wide"](spark, sf).collect()}
    assert wide == {0: {"SMALL"}, 1: {"LARGE", "PROMO"}, 2: set()}
    assert {tuple(r) for r in found["presence_long"](spark, sf).collect()} == {(0, "SMALL"), (1, "LARGE"), (1, "PROMO")}
    assert {(r.strain, r.reaction) for r in found["model_drafts"](spark, sf).collect()} == {(0, "free"), (1, "free"), (2, "free"), (0, "either"), (1, "either")}


def test_labels_and_variant_pairs_take_all_parts(spark, tmp_path):
    keys = np.arange(1, 801)
    sf = write(tmp_path, part={"p_partkey": keys, "p_brand": "B", "p_name": "n", "p_size": keys % 50})
    labels = {r.p_partkey: r.label for r in entry.queries()["family_ids"](spark, sf).collect()}
    assert len(set(labels.values())) == 800 and [labels[k] for k in (1, 26, 27, 702, 703, 729)] == ["Ba", "Bz", "Baa", "Bzz", "Baaa", "Baba"]
    sf = write(tmp_path, part={"p_partkey": [1, 2, 3, 4], "p_brand": ["B", "B", "B", "C"], "p_name": ["red bolt"] * 4, "p_size": [1, 20, 49, 3]})
    found = entry.queries()
    assert [(r.base, r.n) for r in found["variant_pair_compare"](spark, sf).collect()] == [("B", 3)]
    assert {(r.vertex, r.representative) for r in found["merge_components"](spark, sf).collect()} == {("B#1", "B#1"), ("B#2", "B#1"), ("B#3", "B#1")}
    assert [(r.representative, r.n_edges) for r in found["merge_provenance"](spark, sf).collect()] == [("B#1", 3)]
    assert {(r.k_1, r.k_2) for r in found["sequence_alignment"](spark, sf).collect()} == {(1, 2), (1, 3), (2, 3)}


def test_counts_of_pairs_shuffle_no_row_for_a_pair_and_a_feature(spark):
    """Partners travel in lists and are opened where they are counted: one exchange by feature, one by entity."""
    import random

    from loomgrid.operators import enrich, pairs

    rng = random.Random(2)
    has = {e: {f for f in range(30) if rng.random() < 0.3} for e in range(25)}
    presence = spark.createDataFrame([(e, f"f{f}") for e, fs in has.items() for f in fs], "e long, f string")
    shared = pairs.shared_counts(presence, "e", "f")
    plan = shared._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan
    want = {(a, b): len(has[a] & has[b]) for a in has for b in has if a < b and has[a] & has[b]}
    assert {(r.lo, r.hi): r.both for r in shared.collect()} == want
    labels = {p: rng.random() < 0.4 for p in want if rng.random() < 0.6}
    labelled = spark.createDataFrame([(a, b, d) for (a, b), d in labels.items()], "lo long, hi long, disc boolean")
    got = {r.feature: (r.both_d, r.both_k) for r in enrich.pair_counts(presence, labelled, "e", "f").collect()}
    for f in range(30):
        both = [d for (a, b), d in labels.items() if f in has[a] and f in has[b]]
        assert got[f"f{f}"] == (sum(both), len(both) - sum(both))
