import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgrid.functions import exact, text
from loomgrid.operators import assign, classify, cluster, enrich, graph, learn, matrix, models, pairs, sequence, summary


def rows(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, x) for x in r))


def test_reciprocal_mean(spark):
    df = spark.createDataFrame([("A", "B", 99.6), ("B", "A", 99.4), ("A", "C", 98.0), ("A", "A", 100.0), ("A", "B", 99.6)], "q string, r string, ani double")
    got = {(r.lo, r.hi): (round(r.value, 6), r.difference and round(r.difference, 6)) for r in pairs.reciprocal_mean(df, "q", "r", "ani").collect()}
    assert got == {("A", "B"): (99.5, 0.2), ("A", "C"): (98.0, None)}


def test_jaccard_complete_and_symmetric(spark):
    p = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("c", 3)], "e string, f int")
    got = {(r.lo, r.hi): r.jaccard for r in pairs.jaccard(p, "e", "f", complete=True).collect()}
    assert got == {("a", "b"): 0.5, ("a", "c"): 0.0, ("b", "c"): 0.0}
    full = pairs.symmetric(pairs.jaccard(p, "e", "f").select("lo", "hi", "jaccard"), "jaccard")
    assert rows(full) == [("a", "a", 100.0), ("a", "b", 0.5), ("b", "a", 0.5), ("b", "b", 100.0)]


def test_matrix_round_trip_and_invariants(spark):
    wide = spark.createDataFrame([("s1", 1, 0, 1), ("s2", 1, 1, None), ("s3", 1, 0, 0)], "s string, f1 int, f2 int, f3 int")
    long = matrix.to_long(wide, "s")
    assert rows(long) == [("s1", "f1"), ("s1", "f3"), ("s2", "f1"), ("s2", "f2"), ("s3", "f1")]
    again = matrix.to_wide(long, "s", "feature", ["f1", "f2", "f3"], wide.select("s"))
    assert rows(again) == [("s1", 1, 0, 1), ("s2", 1, 1, 0), ("s3", 1, 0, 0)]
    assert rows(matrix.variable_features(long, "s", "feature").select("feature")) == [("f2",), ("f3",)]
    assert rows(matrix.universal(long, "s", "feature")) == [("f1",)]


def test_group_specific_and_its_inverse(spark):
    groups = spark.createDataFrame([("g1", "a"), ("g1", "b"), ("g2", "c")], "grp string, s string")
    p = spark.createDataFrame([("a", "x"), ("b", "x"), ("a", "y"), ("c", "z"), ("a", "all"), ("b", "all"), ("c", "all"), ("other", "x")], "s string, f string")
    assert rows(matrix.group_specific(p, groups, "s", "f")) == [("g1", "x"), ("g2", "z")]
    assert rows(matrix.group_specific(p, groups, "s", "f", present=False)) == [("g1", "z"), ("g2", "x")]


def test_assign_ties_and_threshold(spark):
    hits = spark.createDataFrame([("q1", "t1", 10.0), ("q1", "t2", 10.0), ("q2", "t1", 1.0)], "q string, t string, score double")
    assert rows(assign.assign(hits, "q", "t", "score", 5)) == [("q1", "t2", 10.0), ("q2", "unassigned", 1.0)]


def test_reciprocal_best(spark):
    schema = "query string, subject string, identity double, row long"
    forward = spark.createDataFrame([("g1", "s1", 90.0, 1), ("g1", "s2", 90.0, 2), ("g2", "s1", 80.0, 3), ("g3", "s9", 99.0, 4)], schema)
    backward = spark.createDataFrame([("s1", "g1", 90.0, 1), ("s2", "g2", 70.0, 2)], schema)
    assert rows(assign.reciprocal_best(forward, backward)) == [("g1", "s1", 90.0, "<=>"), ("g2", "s1", 80.0, "->")]
    assert assign.reciprocal_best(forward, backward, reciprocal_only=True).count() == 1


def test_copy_gaps_at_the_limit(spark):
    copies = spark.createDataFrame([("s", 1, 100), ("s", 90, 200), ("s", 5199, 5300), ("s", 10300, 10400)], "s string, a long, b long")
    assert [r.gap for r in assign.copy_gaps(copies, ["s"], "a", "b", []).orderBy("a").collect()] == [-10, 4999, 5000, None]


def test_tiers_and_classes(spark):
    df = spark.createDataFrame([("x", "70%"), ("x", "29%"), (None, "85%"), ("x", None), ("x", "bad")], "known string, s string")
    got = [r[0] for r in df.select(classify.similarity_tier(F.col("known"), text.percent(F.col("s")))).collect()]
    assert got == ["Known", "Novel", "LowConf", "Novel", "Novel"]
    a = spark.createDataFrame([(98.0, 30.0, 0.9), (96.0, 58.0, 0.9), (91.0, 40.0, 0.6), (91.0, 40.0, 0.7)], "i double, c double, r double")
    assert [r[0] for r in a.select(classify.artifact_tier(F.col("i"), F.col("c"), F.col("r"))).collect()] == ["VERY_HIGH", "HIGH", "MEDIUM", None]


def test_text_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    lit = F.lit
    assert get(text.file_stem(lit("/x/y/PS-1.2.fasta"))) == "PS-1.2" and get(text.file_stem(lit("a/b.c.fna"), any_extension=True)) == "b.c"
    assert get(text.first_of_list(lit("PHAGE_x(12),PHAGE_y(3)"))) == "PHAGE_x"
    assert get(text.size_bin(lit(15000.0))) == 20000 and get(text.size_bin(lit(25000.0))) == 20000 and get(text.size_bin(lit(10.0))) == 10000
    assert get(text.phenotype_first_token(lit("0,25 weak"))) == 0.25 and get(text.phenotype_first_token(lit("?"))) is None
    assert get(text.phenotype_contains(lit("Merging"))) == 1.0 and get(text.phenotype_contains(lit("about 3.5"))) == 3.5
    assert get(text.variant_base(lit("tagF.10"))) == "tagF" and get(text.variant_base(lit("tagF"))) is None and get(text.full_suffix(lit("tagF, rodC.1"))) == ".1"
    assert get(text.chunk_names(lit("a, b.1, a, b.2, a"), lit(2))) == ["a, b.1", "a, b.2"]
    assert get(text.translate_dna(text.reverse_complement(lit("TTACAT")))) == "M*"
    assert [get(text.ordinal_letters(lit(n))) for n in (1, 26, 27, 52, 53)] == ["a", "z", "aa", "az", "ba"]
    assert get(text.decode_gene_name(lit("protein [gene%3DabcD] 50%"))) == "abcD"
    assert [get(text.verdict_class(lit(t))) for t in ("Yes, split", "no", "not split here", "", "not sure", "checked: not split", "maybe")] == ["split", *["not_split_duplicate"] * 2, "unchecked", *["not_split_duplicate"] * 2, "unchecked"]
    assert get(text.length_ratio(lit(0), lit(0))) is None
    assert [get(c) for c in text.two_numbers(lit("1,234..5 678"))] == [1234, 5678]


def test_weights_count_empty_items(spark):
    df = spark.createDataFrame([("A; B",), ("A;",)], "x string")
    assert rows(matrix.weighted_items(df, "x").select("item", "weight")) == [("A", 0.5), ("A", 0.5), ("B", 0.5)]


def test_fisher_known_values():
    p, odds, low, high = exact.fisher(3, 1, 1, 3)
    assert p == pytest.approx(34 / 70) and odds == pytest.approx(6.408309, rel=1e-5) and low < odds < high
    assert exact.fisher(5, 0, 0, 5)[1] == math.inf and math.isnan(exact.fisher(0, 0, 3, 4)[0])


@settings(max_examples=40, deadline=None)
@given(st.tuples(*[st.integers(0, 12)] * 4).filter(lambda t: min(t[0] + t[1], t[2] + t[3], t[0] + t[2], t[1] + t[3]) > 0))
def test_fisher_against_enumeration(t):
    a, b, c, d = t
    m, n, k = a + b, c + d, a + c
    w = {x: math.comb(m, x) * math.comb(n, k - x) for x in range(max(0, k - n), min(k, m) + 1)}
    want = sum(v for v in w.values() if v <= w[a]) / sum(w.values())
    assert exact.fisher(a, b, c, d)[0] == pytest.approx(want, rel=1e-9)


def test_distributions():
    assert exact.chi_square_p(3.841458820694124) == pytest.approx(0.05) and exact.chi_square_p(7.814727903251179, 3) == pytest.approx(0.05)
    assert exact.pearson_test(0.5, 20)[0] == pytest.approx(0.02476956, rel=1e-5)
    assert exact.dip(np.arange(20)) == pytest.approx(1 / 40) and exact.dip(np.r_[np.arange(50) * 1e-3, 1 + np.arange(50) * 1e-3]) > 0.2


def test_benjamini_hochberg(spark):
    p = [0.01, 0.02, 0.02, 0.5, 1.0, 0.0, None]
    df = spark.createDataFrame(list(enumerate(p)), "k int, p double")
    got = {r.k: r.fdr for r in enrich.adjusted(df, "p", "k").collect()}
    known = sorted((x, i) for i, x in enumerate(p) if x is not None)
    want, least = {}, 1.0
    for rank in range(len(known), 0, -1):
        least = min(least, known[rank - 1][0] * len(known) / rank)
        want[known[rank - 1][1]] = least
    assert got.pop(6) is None and got == pytest.approx(want)


def test_pair_counts_against_loops(spark):
    import itertools
    import random

    rng = random.Random(3)
    has = {e: {f for f in range(6) if rng.random() < 0.5} for e in range(7)}
    lab = [(a, b, rng.random() < 0.5) for a, b in itertools.combinations(range(7), 2) if rng.random() < 0.8]
    p = spark.createDataFrame([(e, f) for e, fs in has.items() for f in fs], "e int, f int")
    got = {r.feature: tuple(r)[1:] for r in enrich.pair_counts(p, spark.createDataFrame(lab, "lo int, hi int, disc boolean"), "e", "f").collect()}
    for f, counts in got.items():
        want = [sum(1 for a, b, d in lab if (f in has[a]) + (f in has[b]) == n and d == disc) for n in (2, 1, 0) for disc in (True, False)]
        assert list(counts) == want
    table = enrich.tables(enrich.pair_counts(p, spark.createDataFrame(lab, "lo int, hi int, disc boolean"), "e", "f"), "mismatch")
    assert all(r.a + r.b + r.c + r.d == len(lab) for r in table.collect())


def test_components_and_provenance(spark):
    edges = spark.createDataFrame([("x.2", "x.10", "C"), ("x.10", "y", "A"), ("p", "q", "C"), ("z", "z", "C")], "a string, b string, source string")
    labels = graph.components(edges, "a", "b")
    assert rows(labels) == [("p", "p"), ("q", "p"), ("x.10", "x.10"), ("x.2", "x.10"), ("y", "x.10")]
    assert rows(graph.edge_sources(edges, labels, "a", "source")) == [("p", "C", 1), ("x.10", "A+C", 2)]


def test_long_chain_settles(spark):
    chain = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.representative for r in graph.components(chain, "a", "b").collect()} == {0}


def test_exclusion_cliques_and_relabel(spark):
    bad = spark.createDataFrame([("g", "a", "b"), ("g", "b", "c"), ("g", "a", "c"), ("g", "c", "d")], "grp string, lo string, hi string")
    out = graph.minimum_exclusion(bad)
    assert [r.entity for r in out.orderBy("step").collect()] == ["c", "a"]
    good = spark.createDataFrame([("g", "a", "c")], "grp string, lo string, hi string")
    cliques = graph.subgroup_cliques(out, good)
    members = spark.createDataFrame([("g", x) for x in "abcd"] + [("h", "e")], "grp string, entity string")
    got = {r.entity: r.label for r in graph.relabel(members, out, cliques).collect()}
    assert got == {"a": "g_B", "c": "g_B", "b": "g_A", "d": "g_A", "e": "h"}


def test_linkage_cut_and_newick():
    d = np.array([[0, 1, 5, 6], [1, 0, 4, 6], [5, 4, 0, 2], [6, 6, 2, 0]], float)
    m = cluster.linkage(d)
    assert m[:, 2].tolist() == [1, 2, 5.25] and cluster.cut(m, 4, 2) == [1, 1, 2, 2]
    assert cluster.newick(m, list("abcd")) == "((a:1,b:1):4.25,(c:2,d:2):3.25);"
    assert cluster.linkage(d, "complete")[-1, 2] == 6


def test_too_many_items_are_refused(spark):
    many = spark.range(cluster.MOST_ITEMS).select(F.lit(-1).cast("long").alias("lo"), F.col("id").alias("hi"), F.lit(1.0).alias("d"))
    with pytest.raises(ValueError):
        cluster.distance_matrix(many, "d")


def test_alignment():
    assert sequence.compare("MKV", "MKV") == (100.0, 100.0) and sequence.compare(None, "M") == (None, None)
    assert sequence.align("AAACCCTTT", "AAATTT", 2.0, -1.0, -2.0, -0.5)[:3] == (9.0, 6, 9)
    assert sequence.slide("CCC", "AACCCA") == (100.0, 50.0)
    assert sequence.compare_acids("HEAGAWGHEE", "HEAGAWGHEE")[0] == 100.0


def test_alignment_counts_pairs_of_letters_and_all_letters_of_the_matrix():
    assert sequence.scores("B*Z", "D*E")[[0, 1, 2], [0, 1, 2]].tolist() == [4, 1, 4] and sequence.scores("*", "A")[0, 0] == -4
    assert sequence.compare("MK*V", "MKV*") == (100.0, 100.0) and sequence.compare("*", "M") == (None, None)
    assert sequence.compare("AAACCCTTT", "AAATTT") == (100.0, 100.0)  # six pairs of letters; gaps are no pairs
    assert sequence.compare_acids("MKUV", "MKUV") == (100.0, 100.0, 100.0)  # U is not in the matrix: matches alone count
    wide = sequence.MOST_CELLS
    sequence.MOST_CELLS = 10
    try:
        assert sequence.compare("CCC", "AACCCA") == (100.0, 50.0)
    finally:
        sequence.MOST_CELLS = wide


def test_gene_rules():
    assert models.rule_alternatives("(a and b) or (c and (d or e))") == [["a", "b"], ["c", "d"], ["c", "e"]]
    assert models.rule_alternatives("") is None and models.rule_alternatives("a or (a and b)") == [["a"]]


def test_summary_and_density(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 10)], "x double")
    d = summary.describe(df, "x").first()
    assert (d.n, d["median"], d.q1, d.q3) == (5, 3.0, 2.0, 4.0)
    curve = summary.density(df, "x", -10, 25, 400, 1.0)
    total = curve.agg(F.sum("y")).first()[0] * 35 / 399
    assert total == pytest.approx(1, abs=1e-3) and summary.peaks(curve).count() == 2


def test_regions_items_and_layouts(spark):
    df = spark.createDataFrame([(1, 5, 4.0, " Intact", "x"), (5, 5, 1.0, "intact", "PHAGE_y"), (None, 3, 1.0, "incomplete", None), (1, 2, 0.0, None, "q")], "a int, b int, n double, c string, name string")
    assert rows(matrix.valid_regions(df, "a", "b", "n").select("a", "b")) == [(1, 5)] and matrix.intact(df, "c").count() == 2
    assert rows(matrix.without_names(df, "name", ("PHAGE_",), ("q",)).select("name")) == [("x",)] and rows(matrix.without_names(df, "name", ("PHAGE_",)).select("name")) == [("q",), ("x",)]
    grouped = matrix.items_by_group(spark.createDataFrame([("g", "b"), ("g", "a"), ("h", "c")], "g string, i string"), "g", "i")
    assert rows(matrix.item_columns(grouped, "g", 2)) == [("g", "a", "b"), ("h", "c", None)]
    wide = spark.createDataFrame([("r1", 1, 2), ("r2", 3, 4)], "k string, x int, y int")
    assert rows(matrix.transposed(wide, "k", ["r1", "r2"])) == [("x", 1, 3), ("y", 2, 4)]
    cells = spark.createDataFrame([("p", "q", 1.00050001), ("q", "p", 2.0)], "a string, b string, v double")
    assert [tuple(r) for r in matrix.ordered_matrix(cells, spark.createDataFrame([("q", 1), ("p", 2)], "item string, leaf int"), "v").collect()] == [("q", "p", 1, 2, 2.0), ("p", "q", 2, 1, 1.001)]
    assert [matrix.gene_matrix(wide.select(F.col("k").alias("gene")), spark.createDataFrame([("s",)], "strain string"), spark.createDataFrame([("r1", "s", "h")], "gene string, strain string, id string")).orderBy("gene").collect()[i].id for i in (0, 1)] == ["h", "None"]


def test_effects_and_flags(spark):
    one = spark.createDataFrame([(0.0, 1.0), (4.0, 0.01)], "r double, p double")
    assert [tuple(r) for r in one.select(text.log2_ratio(F.col("r")), text.neg_log10(F.col("p"))).collect()] == [(-math.inf, 0.0), (2.0, 2.0)]
    name = spark.createDataFrame([("hypothetical protein_12", 0.001, 3.0), ("abc", 0.001, -3.0), ("abc", 0.5, 3.0)], "n string, f double, l double")
    assert [r[0] for r in name.select(text.volcano_label(F.col("n"), F.col("f"), F.col("l"))).collect()] == ["hypo_12", "abc", None]
    pairs_ = spark.createDataFrame([("g", "g", 99.5, 0.5), ("g", "h", 99.4, 0.25)], "g_lo string, g_hi string, similarity double, phenotype double")
    assert [tuple(r)[4:] for r in pairs.derived_flags(pairs_).collect()] == [(True, True, True, "Contact"), (False, False, False, "Thick boundary")]


def test_case_control_in_blocks(spark, monkeypatch):
    """Any block sizes give what loops give."""
    import random

    rng = random.Random(6)
    has = {e: {f for f in range(9) if rng.random() < 0.5} for e in range(14)}
    lab = [(a, b, rng.random() < 0.5) for a in range(14) for b in range(a + 1, 14) if rng.random() < 0.9]
    want = set()
    for e in range(14):
        ends = [(b if a == e else a, d) for a, b, d in lab if e in (a, b)]
        m, d = [p for p, x in ends if not x], [p for p, x in ends if x]
        if len(m) < 3 or len(d) < 5:
            continue
        for f in range(9):
            pm, pd_ = (round(100.0 * sum(f in has[p] for p in x) / len(x), 1) for x in (m, d))
            own = f in has[e]
            want |= {(e, f, k) for k, fits in enumerate((own and pm >= 80 and pd_ <= 40, not own and pm <= 20 and pd_ >= 60, own and pd_ <= 30, not own and pd_ >= 70), 1) if fits and any(f in x for x in has.values())}
    presence = spark.createDataFrame([(e, f) for e, fs in has.items() for f in fs], "e int, f int")
    for focal, features, partners in ((512, 4096, 2048), (2, 3, 4)):
        for name, value in (("FOCAL_BLOCK", focal), ("FEATURE_BLOCK", features)):
            monkeypatch.setattr(enrich, name, value)
        got = enrich.case_control(presence, spark.createDataFrame(lab, "lo int, hi int, disc boolean"), "e", "f", 3, 5)
        assert {(r.entity, r.feature, r.category) for r in got.collect()} == want and want


def test_folds_and_power(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(9)], "k int, label int")
    assert learn.stratified_folds(df, "label", "k").groupBy("label", "fold").count().agg(F.max("count") - F.min("count")).first()[0] <= 1


def test_case_control_categories(spark):
    labelled = spark.createDataFrame([(0, i, i > 3) for i in range(1, 9)], "lo int, hi int, disc boolean")
    presence = spark.createDataFrame([(0, "f"), (1, "f"), (2, "f"), (3, "f")] + [(i, "g") for i in range(4, 9)], "e int, f string")
    got = enrich.case_control(presence, labelled, "e", "f", 3, 5)
    assert rows(got.select("feature", "category")) == [("f", 1), ("f", 3), ("g", 2), ("g", 4)]
