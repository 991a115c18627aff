"""Equal variants are compared once, and every copy is in the result."""

import random

import pandas as pd
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomgrid.operators import graph, variants
from loomgrid.plans import labels


def parts(folder, n=600):
    names = ["red bolt", "red bolts", "small ring"]
    pd.DataFrame({"p_partkey": range(1, n + 1), "p_brand": "B", "p_name": [names[k % 3] for k in range(n)], "p_size": 7}).to_parquet(f"{folder}/part.parquet")
    return str(folder)


def test_components_link_copies_once(spark, monkeypatch):
    rows = [("g", f"v{i:03d}", "abc"[i % 3]) for i in range(300)] + [("g", "w0", "lone"), ("h", "x0", None), ("h", "x1", None)]
    items = spark.createDataFrame(rows, "base string, vertex string, name string")
    written = []
    keep = lambda df, name="rows": (out := real(df, name), written.append((name, out.count())))[0]
    real = graph.stored
    monkeypatch.setattr(graph, "stored", keep)
    linked = lambda p: (F.col("name_1") == F.col("name_2")) | (F.greatest("name_1", "name_2") == "b") & (F.least("name_1", "name_2") == "a")
    got = {r.vertex: r.representative for r in graph.linked_components(items, "base", "vertex", linked).collect()}
    assert got == {f"v{i:03d}": "v002" if i % 3 == 2 else "v000" for i in range(300)}
    assert max(n for name, n in written if name == "links") <= 4


def test_comparisons_count_copies(spark, tmp_path):
    sf, found = parts(tmp_path), entry.queries()
    assert labels._variant_pairs(spark, sf).count() == 6  # three names, not 179,700 pairs of parts
    one = found["variant_pair_compare"](spark, sf).first()
    assert one.n == 600 * 599 // 2 and one.n_merge == 3 * 200 * 199 // 2 + 200 * 200 and one.most == 100
    assert {(r.representative, r.n_edges) for r in found["merge_provenance"](spark, sf).collect()} == {("B#1", 2 * 200 * 199 // 2 + 40_000), ("B#102", 200 * 199 // 2)}


def test_pairs_of_classes_and_members(spark, tmp_path):
    rows = entry.queries()["sequence_alignment"](spark, parts(tmp_path)).collect()
    assert len(rows) == 3 + 597 and len({r.k_2 for r in rows}) == 599
    assert {(r.k_1, r.k_2) for r in rows if r.identity != 100} <= {(1, 2), (1, 3), (2, 3)} and {r.k_1 for r in rows} == {1, 2, 3}


def test_extreme_copies_equal_all_pairs(spark):
    rng = random.Random(5)
    side = lambda start: [(g, start + i, rng.choice([None, 1.0, 2.5, 2.5, 900.1, rng.uniform(0, 1000)])) for g in "abcdefgh" for i in range(rng.choice([1, 2, 9, 30]))]
    ref, own = side(0) + [("n", 1, None), ("n", 2, None)], side(100) + [("n", 101, 5.0), ("n", 100, None)]
    frame = lambda rows: spark.createDataFrame(rows, "grp string, k int, v double")
    got = {r.grp: tuple(r)[1:] for r in variants.extreme_copies(frame(ref), frame(own), ["grp"], "k", "v", lambda a, b: 100 - F.abs(a - b) / 10).collect()}
    want = {}
    for g in "abcdefghn":
        x, y = [r for r in ref if r[0] == g], [r for r in own if r[0] == g]
        pairs = [(a[1], b[1], None if a[2] is None or b[2] is None else 100 - abs(a[2] - b[2]) / 10) for a in x for b in y]
        known = [p for p in pairs if p[2] is not None]
        a, b, least = min(known or pairs, key=lambda p: (p[2] or 0, p[0], p[1]))
        most = max((p[2] for p in known), default=None)
        if len(x) > 1 or len(y) > 1:
            want[g] = (a, b, least, most, most - least if known else None, len(pairs), len(x), len(y))
    assert got == want
