from pyspark.sql import functions as F

from loomgrid.operators import pairs, relate


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_lookups(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k int, v string")
    dim = spark.createDataFrame([(1, "one"), (None, "none")], "id int, name string")
    assert rows(relate.looked_up(df, dim, {"k": "id"}, {"name": "name"}, {"name": "?"})) == [(1, "a", "one"), (3, "c", "?"), (None, "b", "none")]
    assert rows(relate.recoded(df, "v", {"a": "A"}).select("v")) == [("A",), ("b",), ("c",)] and relate.recoded(df, "v", {}, "w").columns == ["k", "v", "w"]
    presence = spark.createDataFrame([("f", 1), ("f", 2), ("g", 1), ("g", 3), ("f", 3)], "feature string, entity int")
    linked = spark.createDataFrame([(1, 2), (1, 3), (2, 4)], "lo int, hi int")
    assert rows(relate.both_have(linked, presence, "entity", "feature")) == [("f", 1, 2), ("f", 1, 3), ("g", 1, 3)]


def test_labels(spark):
    df = spark.createDataFrame([(i, f"g{i % 3}") for i in range(90)], "k long, g string").repartition(4)
    got = relate.labelled_rows(df, ["k"], "x_").collect()
    assert {r.k: r.label for r in got} == {i: f"x_{i + 1}" for i in range(90)}
    assert {(r.g, r.n, r.group_id) for r in relate.with_group_ids(df, "g").collect()} == {("g0", 30, 1), ("g1", 30, 2), ("g2", 30, 3)}
    letters = {r.k: r.name for r in relate.lettered(df, "g", "k", "name").collect()}
    assert letters[0] == "g0a" and letters[78] == "g0aa" and letters[2] == "g2a"
    assert rows(relate.top_per_class(df, "g", [F.col("k").desc()], 1).select("k")) == [(87,), (88,), (89,)]


def test_summaries(spark):
    df = spark.createDataFrame([("a", 5, 1, "x"), ("a", 2, 9, None), ("b", 1, 1, "y")], "g string, s int, e int, t string")
    assert rows(relate.extent(df, ["g"], "s", "e")) == [("a", 1, 9, 8, 4.25), ("b", 1, 1, 0, 1.0)]
    assert rows(relate.joined_texts(df, ["g"], "t", "s", "+")) == [("a", "NA+x", 2), ("b", "y", 1)]
    assert rows(relate.shares_within(df, ["g"], "t")) == [("a", "x", 1, 0.5), ("a", None, 1, 0.5), ("b", "y", 1, 1.0)]
    assert rows(relate.cluster_summary(df, "g", "s", "e").select("g", "n_members", "cv"))[1] == ("b", 1, None)


def test_running_mean_of_repeated_pairs(spark):
    df = spark.createDataFrame([(1, 2, 10.0, 1), (2, 1, 20.0, 2), (1, 2, 40.0, 3), (3, 3, 1.0, 1), (4, 3, 7.0, 1), (4, 3, None, 2)], "a int, b int, v double, t int").repartition(3)
    assert rows(pairs.running_mean(df, "a", "b", "v", "t")) == [(1, 2, 27.5, 3), (3, 4, 7.0, 1)]


def test_letters_of_bounded_names_run_on(spark):
    df = spark.range(1, 130_000).select(F.lit("g").alias("g"), F.col("id").alias("k"))
    got = {r.k: r.name for r in relate.lettered(df, "g", "k", "name", most=3).where("k < 30 OR k % 53 = 0 OR k IN (702, 703, 18278, 18279, 107511)").collect()}

    def plain(n):  # the rule of the SQL of family_ids
        rest = chr(97 + (n - 1) % 26)
        return "g" + (rest if n <= 26 else chr(96 + (n - 1) // 26) + rest if n <= 702 else chr(97 + (n - 703) // 676) + chr(97 + (n - 703) // 26 % 26) + rest)

    assert got == {n: plain(n) for n in got} and len(got) > 2000 and got[18278] == "gzzz" and got[18279] == "g{aa"
