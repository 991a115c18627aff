from pyspark.sql import functions as F

from loomgrid.operators import classify, enrich, models, summary, variants


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_first_known_name_with_all_copies(spark):
    wanted = spark.createDataFrame([("s", 1, ["a", "b"]), ("s", 2, ["x"]), ("t", 3, ["b", "a"])], "strain string, task int, names array<string>")
    known = spark.createDataFrame([("s", "b", "SEQ1"), ("s", "b", "SEQ2"), ("t", "a", "SEQ3")], "strain string, gene string, aa string")
    assert rows(variants.first_known(wanted, known).select("task", "gene", "aa")) == [(1, "b", "SEQ1"), (1, "b", "SEQ2"), (3, "a", "SEQ3")]


def test_fan_out_and_failed_lookups(spark):
    v = spark.createDataFrame([("g", "v1")], "grp string, variant string")
    m = spark.createDataFrame([("g", s, i) for i, s in enumerate("abcd")], "grp string, strain string, rank int")
    tasks = variants.fan_out(v, m)
    assert rows(tasks.select("strain")) == [("a",), ("b",), ("c",)]
    have = lambda *s: spark.createDataFrame([(x,) for x in s], "strain string")
    assert rows(variants.failed_lookups(tasks, have("a", "b"), have("a"), ["strain"]).select("strain", "reason")) == [("b", "group sequence missing"), ("c", "reference sequence missing")]


def test_most_divergent_and_averages(spark):
    df = spark.createDataFrame([("t", 1, 90.0), ("t", 2, 80.0), ("t", 3, 80.0)], "task string, copy int, identity double")
    assert rows(variants.most_divergent(df, ["task"])) == [("t", 2, 80.0, 90.0, 10.0, 3)]
    r = spark.createDataFrame([("v", "b", 90.0, "second"), ("v", "a", 80.0, "first")], "variant string, strain string, identity double, note string")
    assert rows(variants.variant_averages(r, ["variant"], ["identity"], ["note"], "strain")) == [("v", 85.0, "first", 2)]


def test_statuses_and_totals(spark):
    df = spark.createDataFrame([(True, "ARTEFACT", 1), (True, "VARIANT", 1), (True, None, 1), (False, None, 2)], "is_variant boolean, cls string, copies int")
    got = [r[0] for r in df.select(classify.present_status(F.col("is_variant"), F.col("cls"), F.col("copies"))).collect()]
    assert got == ["REMOVE", "KEEP", "KEEP (not validated)", "KEEP (not a variant)"]
    judged = spark.createDataFrame([(False, "ARTEFACT", 1, 0.0), (True, "ARTEFACT", 2, 11.0), (True, "VARIANT", 2, 50.0)], "v boolean, cls string, copies int, spread double")
    assert [r[0] for r in judged.select(classify.present_status(*(F.col(c) for c in judged.columns))).collect()] == ["REMOVE", "KEEP (multi-copy)", "KEEP"]
    two = spark.createDataFrame([(True, True), (False, True), (False, False)], "paired boolean, found boolean")
    assert [r[0] for r in two.select(classify.absent_status(F.col("paired"), F.col("found"))).collect()] == ["REMOVE (paired artefact)", "KEEP (other variant in genome)", "KEEP (gene missing)"]
    status = spark.createDataFrame([("g", "present", "REMOVE"), ("g", "present", "KEEP"), ("h", "absent", "KEEP (gene missing)")], "grp string, section string, status string")
    assert rows(variants.removal_totals(status)) == [("absent", 1, 0, 1, 0), ("present", 2, 1, 1, 1)]


def test_reference_variant_ranks(spark):
    schema = "grp string, base string, strain string, variant string, number int, own boolean"
    c = spark.createDataFrame([("g", "x", "ref", "x.2", 2, False), ("g", "x", "o", "x.0", 0, False), ("g", "y", "ref", "y.3", 3, False), ("g", "y", "ref", "y.1", 1, False), ("g", "z", "o", "z.4", 4, True), ("g", "w", "o", "w.5", 5, False), ("g", "w", "p", "w.7", 7, False), ("g", "w", "q", "w.7", 7, False)], schema)
    got = {r.base: (r.reference, r["rank"]) for r in classify.reference_variant(c, "ref").collect()}
    assert got == {"x": ("x.0", 2), "y": ("y.1", 3), "z": ("z", 5), "w": ("w", 5)}  # none in the preferred strain: the base gene there
    own = [("g", "a", "ref", "a.1", 1, True), ("g", "a", "o", "a.4", 4, False), ("g", "a", "p", "a.4", 4, False), ("g", "a", "p", "a.3", 3, False), ("g", "b", "ref", "b.2", 2, True), ("g", "c", "ref", "c.0", 0, True)]
    got = {r.base: (r.reference, r.strain, r["rank"]) for r in classify.reference_variant(spark.createDataFrame(own, schema), "ref").collect()}
    assert got == {"a": ("a.4", "o", 4), "b": ("b", "ref", 5)}  # and an own .0 has no reference


def test_annotation_takes_the_first_entry_of_its_group(spark):
    f = spark.createDataFrame([("g", "a, b.1", ["a", "b"]), ("g", "c", ["c"]), ("h", "a", ["a"])], "grp string, feature string, bases array<string>")
    v = spark.createDataFrame([("g", "b", ["b"], "Yes", 2), ("g", "a", ["a"], "not split", 1), ("h", "q", ["q"], "no", 3)], "grp string, entry string, bases array<string>, verdict string, row int")
    assert rows(variants.annotate(f, v).select("grp", "feature", "category")) == [("g", "a, b.1", "not_split_duplicate"), ("g", "c", "none"), ("h", "a", "none")]


def test_unreviewed_paralogs_are_duplicates(spark):
    f = spark.createDataFrame([("g", x, [x]) for x in "abcde"], "grp string, feature string, bases array<string>")
    v = spark.createDataFrame([("g", "a", ["a"], "Yes", "SPLIT UNIQUE to group", 1), ("g", "b", ["b"], "no", "", 2), ("g", "c", ["c"], None, None, 3)], "grp string, entry string, bases array<string>, verdict string, uniqueness string, row int")
    p = spark.createDataFrame([("g", x, [x], i) for i, x in enumerate("abcd")], "grp string, entry string, bases array<string>, row int")
    c = spark.createDataFrame([("g", "d", "2 copies in 1/3 group strains")], "grp string, feature string, text string")
    got = [tuple(r)[1:] for r in variants.annotate(f, v, p, c).orderBy("feature").collect()]
    assert got == [("a", "split", "split gene (1 functional copy), split unique to group"), ("b", "not_split_duplicate", "yes, multi-copy (details unavailable) (no)"), ("c", "unchecked", "likely split, needs check (multi-copy (details unavailable))"), ("d", "duplicate", "yes, 2 copies in 1/3 group strains"), ("e", "none", "no")]


def test_copies_on_one_strand_are_split(spark):
    c = [("s", "f", 1, 100, 1, 33), ("s", "f", 5099, 5200, 1, 31), ("s", "f", 90_000, 90_100, 1, 33), ("t", "f", 1, 100, 1, 33), ("t", "f", 150, 300, -1, 10), ("u", "f", 1, 100, 1, 5), ("u", "f", 6000, 6100, 1, 5), ("v", "f", 1, 9, 1, 3), ("w", "f", 1, 100, 1, 3), ("w", "f", 200, 300, 1, 9), ("w", "f", 200, 300, 1, 9)]
    got = classify.copy_verdicts(spark.createDataFrame(c, "strain string, feature string, a int, b int, strand int, n int"), ["strain", "feature"], "a", "b", "strand", "n")
    assert rows(got.select("strain", "n_copies", "least_gap", "same_strand", "ratio", "truncated", "flag")) == [("s", 3, 4999, True, 0.939, False, "split_similar"), ("t", 2, 50, False, 0.303, True, "close"), ("u", 2, 5900, True, 1.0, False, "distant"), ("w", 2, 100, True, 0.333, True, "split_unequal")]
    u = spark.createDataFrame([(1, 0), (0, 2), (0, 0)], "s int, i int")
    assert [r[0] for r in u.select(classify.split_uniqueness(F.col("s"), F.col("i"))).collect()] == ["also_outside", "split_unique", "unique"]


def test_copy_products_and_name_fallback(spark):
    ref = spark.createDataFrame([("t", 1), ("t", 2), ("u", 3)], "task string, n int")
    own = spark.createDataFrame([("t", 7), ("u", 8), ("x", 9)], "task string, n int")
    got = variants.copy_pairs(ref, own, ["task"])
    assert rows(got) == [("t", 1, 2, 7, 1), ("t", 2, 2, 7, 1), ("u", 3, 1, 8, 1)] and rows(variants.multi_copy(got).select("task").distinct()) == [("t",)]
    f = spark.createDataFrame([("tagF, rodC.1",), ("tagF, rodC.2",), ("abc.1",)], "feature string")
    names = spark.createDataFrame([("tagF.1",), ("tagF, rodC.2",), ("abc.1",), ("abc.2",), ("none",)], "name string")
    assert rows(variants.by_name_or_first(names, f)) == [("abc.1", "abc.1"), ("tagF, rodC.2", "tagF, rodC.2"), ("tagF.1", "tagF, rodC.1")]


def test_copy_counts_and_text(spark):
    copies = spark.createDataFrame([("f", "a", 2), ("f", "b", 3), ("f", "z", 1)], "feature string, strain string, n int")
    members = spark.createDataFrame([("g", "a"), ("g", "b"), ("g", "c")], "grp string, strain string")
    got = variants.copy_counts(copies, members)
    assert rows(got) == [("g", "f", 5, 1, 2, 3, 2, 3)]
    assert got.select(variants.range_text(*(F.col(c) for c in ("low", "high", "have", "size")))).first()[0] == "2-3 copies in 2/3 group strains"


def test_nested_documents_and_merged_pairs(spark):
    docs = spark.createDataFrame([("g", [("v1", "v2", [("s", "t", 99.0)])]), ("h", None)], "base_gene string, comparisons array<struct<variant1 string, variant2 string, pairwise array<struct<strain1 string, strain2 string, identity double>>>>")
    one, two = variants.result_rows(docs)
    assert rows(one) == [("g", 0, "v1", "v2")] and rows(two) == [("g", 0, "s", "t", 99.0)]
    assert variants.without_merged(one, spark.createDataFrame([("v2", "v1")], "variant1 string, variant2 string")).count() == 0


def test_layout_of_both_sections(spark):
    df = spark.createDataFrame([("g", "present", "b"), ("g", "present", "a"), ("g", "absent", "z")], "grp string, section string, name string")
    assert [tuple(r) for r in variants.side_by_side(df, "grp", "section", "name").collect()] == [("g", 1, "a", "z"), ("g", 2, "b", None)]


def test_stringent_filter_and_model_summary(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1, 0.01, 3.0, 6), (2, 0.01, inf, 6), (3, 0.01, float("nan"), 6), (4, 0.01, 0.4, 6), (5, 0.2, 3.0, 6), (6, None, 3.0, 6)], "k int, fdr double, odds double, a int")
    assert rows(enrich.stringent(df).select("k")) == [(1,), (4,)]
    genes = spark.createDataFrame([("s", ["a", "b"]), ("t", [])], "strain string, genes array<string>")
    assert rows(models.model_summary(genes, spark.createDataFrame([("s", "R")], "strain string, reaction string"))) == [("s", 2, 1), ("t", 0, 0)]
    names = spark.createDataFrame([("s", "a", "own"), ("s", "b", "None")], "strain string, gene string, name string")
    assert rows(models.renamed(spark.createDataFrame([("s", "a"), ("s", "b")], "strain string, gene string"), names)) == [("s", "b"), ("s", "own")]
    assert summary.describe(df.where("false"), "odds").first().n == 0
