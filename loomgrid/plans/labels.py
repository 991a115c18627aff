"""Queries on hits, names, tiers, copies and free text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import assign as A
from ..operators import classify as C
from ..operators import matrix as M
from ..operators import relate as R
from . import tables as T
from .registry import query

_HITS = "h AS (SELECT l_orderkey AS q, l_suppkey AS t, sum(l_quantity) AS len, sum((1 - l_discount) * 100 * l_quantity) / sum(l_quantity) AS pid FROM lineitem GROUP BY 1, 2), s AS (SELECT *, round(len * pid / 100, 6) AS score FROM h), best AS (SELECT q, t, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, t DESC) AS rn FROM s)"


def _scored(spark, sf_dir):
    hits = T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_suppkey").alias("t"), "l_quantity", ((1 - F.col("l_discount")) * 100).alias("pid"))
    return A.aggregate_hits(hits, "q", "t", "l_quantity", "pid").withColumn("score", F.round(F.col("length") * F.col("identity") / 100, 6))


@query("WITH " + _HITS + " SELECT q, CASE WHEN score >= 20 THEN CAST(t AS VARCHAR) ELSE 'unassigned' END AS target, score FROM best WHERE rn = 1")
def hsp_assign(spark, sf_dir):
    return A.assign(_scored(spark, sf_dir), "q", "t", "score", 20)


@query("WITH " + _HITS + """, a AS (SELECT o_orderstatus AS status, n_regionkey AS region FROM best JOIN orders ON o_orderkey = q JOIN supplier ON s_suppkey = t JOIN nation ON n_nationkey = s_nationkey WHERE rn = 1)
SELECT region, count(*) FILTER (WHERE status = 'F') AS F, count(*) FILTER (WHERE status = 'O') AS O, count(*) FILTER (WHERE status = 'P') AS P, count(*) FILTER (WHERE status IN ('F', 'O', 'P')) AS TOTAL FROM a GROUP BY 1""")
def assign_crosstab(spark, sf_dir):
    best = A.assign(_scored(spark, sf_dir), "q", "t", "score", float("-inf")).select("q", F.col("target").cast("long").alias("t"))
    o, s, n = (T.table(spark, sf_dir, x) for x in ("orders", "supplier", "nation"))
    rows = R.looked_up(best, o, {"q": "o_orderkey"}, {"status": "o_orderstatus"})
    rows = R.looked_up(R.looked_up(rows, s, {"t": "s_suppkey"}, {"nation": "s_nationkey"}), n, {"nation": "n_nationkey"}, {"region": "n_regionkey"})
    return M.crosstab(rows, "region", "status", ["F", "O", "P"])


_RBH = """f AS (SELECT l_partkey AS q, l_suppkey AS s, l_extendedprice AS v, l_orderkey * 10 + l_linenumber AS r FROM lineitem),
fw AS (SELECT q, s, v FROM f QUALIFY row_number() OVER (PARTITION BY q ORDER BY v DESC, r) = 1), bw AS (SELECT s, q AS back FROM f QUALIFY row_number() OVER (PARTITION BY s ORDER BY v DESC, r) = 1)"""


def _reciprocal(spark, sf_dir):
    f = T.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("query"), F.col("l_suppkey").alias("subject"), F.col("l_extendedprice").alias("identity"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"))
    return A.reciprocal_best(f, f.select(F.col("subject").alias("query"), F.col("query").alias("subject"), "identity", "row"))


@query("WITH " + _RBH + " SELECT fw.q AS query, fw.s AS subject, v AS identity, CASE WHEN back = q THEN '<=>' ELSE '->' END AS direction FROM fw JOIN bw ON fw.s = bw.s")
def reciprocal_best_hit(spark, sf_dir):
    return _reciprocal(spark, sf_dir)


@query("WITH " + _RBH + """, m AS (SELECT fw.q AS gene, s_nationkey AS strain, max(v) AS v FROM fw JOIN supplier ON s_suppkey = fw.s GROUP BY 1, 2)
SELECT g.p_partkey AS gene, n.n_nationkey AS strain, coalesce(v, 0) AS identity, CAST(coalesce(v, 0) > 50000 AS INTEGER) AS present FROM part g CROSS JOIN nation n LEFT JOIN m ON m.gene = g.p_partkey AND m.strain = n.n_nationkey""")
def homology_binarised(spark, sf_dir):
    s = T.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("strain"))
    hits = _reciprocal(spark, sf_dir).join(s, F.col("subject") == F.col("s_suppkey")).groupBy(F.col("query").alias("gene"), "strain").agg(F.max("identity").alias("identity"))
    return A.homology(T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene")), T.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("strain")), hits, 50000)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'N' AND pct >= 70 THEN 'Known' WHEN pct >= 30 THEN 'LowConf' ELSE 'Novel' END AS tier FROM (SELECT *, CASE WHEN l_linenumber = 1 THEN NULL ELSE TRY_CAST(replace(CAST(CAST(l_quantity * 2 AS INTEGER) AS VARCHAR) || '%', '%', '') AS DOUBLE) END AS pct FROM lineitem)")
def tier_classification(spark, sf_dir):
    line = T.table(spark, sf_dir, "lineitem")
    text = F.when(F.col("l_linenumber") != 1, F.concat((F.col("l_quantity") * 2).cast("int").cast("string"), F.lit("%")))
    return line.select("l_orderkey", "l_linenumber", C.similarity_tier(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")), X.percent(text)).alias("tier"))


@query("""WITH b AS (SELECT p_partkey, regexp_replace(p_type, '[^A-Za-z0-9]', '_', 'g') || '_' || CAST(greatest(round_even(p_retailprice * 50 / 10000, 0) * 10000, 10000) / 1000 AS INTEGER) || 'kb_' || CAST(greatest(0, least(100, round_even(p_size * 2 / 20.0::DOUBLE, 0) * 20)) AS INTEGER) || 'pct' AS name FROM part)
SELECT p_partkey, name, count(*) OVER (PARTITION BY name) AS n, dense_rank() OVER (ORDER BY name) AS group_id FROM b""")
def name_and_bin(spark, sf_dir):
    p = T.table(spark, sf_dir, "part")
    name = F.concat(X.safe_name(F.col("p_type")), F.lit("_"), (X.size_bin(F.col("p_retailprice") * 50) / 1000).cast("int").cast("string"), F.lit("kb_"), X.position_bin(F.col("p_size") * 2).cast("int").cast("string"), F.lit("pct"))
    rows = p.select("p_partkey", name.alias("name"))
    return R.with_group_ids(rows, "name").select("p_partkey", "name", "n", "group_id")


@query("SELECT c_custkey, c_name, 'unpositioned_' || row_number() OVER (ORDER BY c_custkey) AS label FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def unpositioned_anti(spark, sf_dir):
    c, o = T.table(spark, sf_dir, "customer"), T.table(spark, sf_dir, "orders")
    left = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")
    return R.labelled_rows(left, ["c_custkey"], "unpositioned_")


@query("""SELECT p_type AS cluster, count(DISTINCT l_suppkey) AS n_strains, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS sd, min(l_extendedprice) AS least, max(l_extendedprice) AS most, round(100 * stddev_samp(l_extendedprice) / avg(l_extendedprice), 4) AS cv,
CASE WHEN count(DISTINCT l_suppkey) < 2 THEN 'singleton' WHEN 100 * stddev_samp(l_extendedprice) / avg(l_extendedprice) > 30 THEN 'variable' ELSE 'consistent' END AS flag FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def cluster_validation(spark, sf_dir):
    line = T.table(spark, sf_dir, "lineitem").join(T.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = R.cluster_summary(line.withColumnRenamed("p_type", "cluster"), "cluster", "l_suppkey", "l_extendedprice")
    return rows.select("cluster", F.col("n_members").alias("n_strains"), "n", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), "least", "most", F.round("cv", 4).alias("cv"), C.cluster_flag(F.col("n_members"), F.col("cv")).alias("flag"))


@query("SELECT a.conv_id, roles, n, coalesce(o.c_mktsegment, 'none') AS segment FROM (SELECT conv_id, string_agg(coalesce(role, 'NA'), '/' ORDER BY turn) AS roles, count(*) AS n FROM conversations GROUP BY 1) a LEFT JOIN customer o ON o.c_custkey IS NOT DISTINCT FROM a.conv_id")
def ordered_pair_concat(spark, sf_dir):
    rows = R.joined_texts(T.table(spark, sf_dir, "conversations"), ["conv_id"], "role", "turn")
    out = R.looked_up(rows, T.table(spark, sf_dir, "customer"), {"conv_id": "c_custkey"}, {"segment": "c_mktsegment"}, {"segment": "none"})
    return out.select("conv_id", F.col("texts").alias("roles"), "n", "segment")


@query("SELECT p_partkey, p_brand || CASE WHEN rn <= 26 THEN '' WHEN rn <= 702 THEN chr(CAST(96 + (rn - 1) // 26 AS INTEGER)) ELSE chr(CAST(97 + (rn - 703) // 676 AS INTEGER)) || chr(CAST(97 + (rn - 703) // 26 % 26 AS INTEGER)) END || chr(CAST(97 + (rn - 1) % 26 AS INTEGER)) AS label FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part)")
def family_ids(spark, sf_dir):
    """Labels of three letters at most, as the SQL has it: the first runs on past z."""
    return R.lettered(T.table(spark, sf_dir, "part"), "p_brand", "p_partkey", "label", most=3).select("p_partkey", "label")


@query("SELECT event_id, lower(regexp_replace(split_part(event_type || '(12),x', ',', 1), '\\([0-9]+\\)$', '')) AS main, TRY_CAST(regexp_replace(props, '[^0-9]', '', 'g') AS DOUBLE) AS digits FROM events")
def first_token_clean(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    return e.select("event_id", F.lower(X.first_of_list(F.concat("event_type", F.lit("(12),x")))).alias("main"), X.digits_only(F.col("props")).alias("digits"))


@query("SELECT page_id, TRY_CAST(list_extract(n, 1) AS BIGINT) AS first_number, coalesce(TRY_CAST(list_extract(n, 2) AS BIGINT), -1) AS second_number FROM (SELECT page_id, regexp_extract_all(replace(url, ',', ''), '\\d+') AS n FROM pages)")
def url_regex_extract(spark, sf_dir):
    a, b = X.two_numbers(F.col("url"))
    return T.table(spark, sf_dir, "pages").select("page_id", a.alias("first_number"), F.coalesce(b, F.lit(-1)).alias("second_number"))


@query("SELECT s_suppkey, coalesce(new, n_name) AS name FROM supplier JOIN nation ON n_nationkey = s_nationkey LEFT JOIN (VALUES ('CHINA', 'CN'), ('FRANCE', 'FR'), ('BRAZIL', 'BR')) k(old, new) ON old = n_name")
def alias_rename(spark, sf_dir):
    s = R.looked_up(T.table(spark, sf_dir, "supplier"), T.table(spark, sf_dir, "nation"), {"s_nationkey": "n_nationkey"}, {"name": "n_name"})
    return R.recoded(s, "name", {"CHINA": "CN", "FRANCE": "FR", "BRAZIL": "BR"}).select("s_suppkey", "name")


@query("SELECT o_orderkey, TRY_CAST(replace(regexp_split_to_array(trim(replace(o_orderpriority, '-', ',5 ')), '\\s+')[1], ',', '.') AS DOUBLE) AS value, TRY_CAST(replace(regexp_split_to_array(trim(replace(o_orderpriority, '-', ',5 ')), '\\s+')[1], ',', '.') AS DOUBLE) >= 3 AS kin FROM orders")
def phenotype_parse(spark, sf_dir):
    value = X.phenotype_first_token(F.replace("o_orderpriority", F.lit("-"), F.lit(",5 ")))
    return T.table(spark, sf_dir, "orders").select("o_orderkey", value.alias("value"), (value >= 3).alias("kin"))


_VARIANTS = """v AS (SELECT p_brand AS base, p_partkey AS k, p_name || '.' || p_size AS name FROM part),
vp AS (SELECT a.base, a.k AS k_1, b.k AS k_2, 100.0 * (1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name))::DOUBLE) AS identity, 100.0 * least(length(a.name), length(b.name)) / greatest(length(a.name), length(b.name))::DOUBLE AS coverage FROM v a JOIN v b ON a.base = b.base AND a.k < b.k)"""


def _variants(spark, sf_dir):
    return T.table(spark, sf_dir, "part").select(F.col("p_brand").alias("base"), F.col("p_partkey").alias("k"), F.concat("p_name", F.lit("."), F.col("p_size").cast("string")).alias("name"))


def _identity(x, y):
    return 100.0 * (1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)))


def _variant_pairs(spark, sf_dir):
    """Pairs of different names of a brand and of equal ones; ``n``: how many pairs of parts have them."""
    from ..operators.sequence import class_pairs, variant_classes

    p = class_pairs(variant_classes(_variants(spark, sf_dir), "k"), "base", "k")
    a, b = F.length("name_1"), F.length("name_2")
    return p.withColumns({"identity": _identity(F.col("name_1"), F.col("name_2")), "coverage": 100.0 * F.least(a, b) / F.greatest(a, b)})


@query("WITH " + _VARIANTS + " SELECT base, count(*) AS n, round(avg(identity), 6) AS mean, round(stddev_pop(identity), 6) AS sd, round(min(identity), 6) AS least, round(max(identity), 6) AS most, count(*) FILTER (WHERE identity >= 80 AND coverage >= 50) AS n_merge FROM vp GROUP BY 1")
def variant_pair_compare(spark, sf_dir):
    """Equal names of a brand are compared once; few distances and lengths are left for each brand."""
    rows = _variant_pairs(spark, sf_dir).groupBy("base", "identity", "coverage").agg(F.sum("n").alias("n"))
    merge = F.coalesce(F.sum(F.when(C.conservative_merge(F.col("identity"), F.col("coverage")), F.col("n"))), F.lit(0))
    out = R.comparison_summary(rows, ["base"], "identity", merge.alias("n_merge"), count="n")
    return out.select("base", "n", *(F.round(c, 6).alias(c) for c in ("mean", "sd", "least", "most")), "n_merge")


@query("""SELECT tier, count(*) AS n, round(min(score), 6) AS least FROM (SELECT CASE WHEN i >= 98 AND c BETWEEN 20 AND 55 THEN 'VERY_HIGH' WHEN i >= 95 AND c BETWEEN 25 AND 60 THEN 'HIGH' WHEN i >= 90 AND c BETWEEN 30 AND 50 AND r <= 0.6 THEN 'MEDIUM' END AS tier, least(1.0, 0.5 * i / 100 + 0.3 * c / 100 + 0.2 * r) AS score
FROM (SELECT 100 - l_discount * 100 AS i, l_quantity * 2 AS c, l_tax * 10 AS r FROM lineitem)) WHERE tier IS NOT NULL GROUP BY 1""")
def artifact_tiers(spark, sf_dir):
    rows = T.table(spark, sf_dir, "lineitem").select((100 - F.col("l_discount") * 100).alias("i"), (F.col("l_quantity") * 2).alias("c"), (F.col("l_tax") * 10).alias("r"))
    score = C.artifact_confidence(F.col("i") / 100, F.col("c") / 100, F.col("r"))
    return rows.select(C.artifact_tier(F.col("i"), F.col("c"), F.col("r")).alias("tier"), score.alias("score")).where("tier IS NOT NULL").groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("score"), 6).alias("least"))


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + CAST(floor(value) AS BIGINT) AS t, event_id % 2 AS strand FROM events),
g AS (SELECT *, lead(s) OVER w - t AS gap, lead(strand) OVER w = strand AS same FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id))
SELECT user_id, count(*) AS n, min(gap) AS min_gap, count(*) FILTER (WHERE gap < 50000 AND same) AS n_split FROM g GROUP BY 1""")
def copy_gaps_split_flag(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    start = F.expr("unix_seconds(cast(ts as timestamp))")
    rows = A.copy_gaps(e.select("user_id", "event_id", start.alias("s"), (start + F.floor("value").cast("long")).alias("t"), (F.col("event_id") % 2).alias("strand")), ["user_id"], "s", "t", ["event_id"])
    same = F.lead("strand").over(Window.partitionBy("user_id").orderBy("s", "event_id")) == F.col("strand")
    rows = rows.withColumn("same", same)
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("gap").alias("min_gap"), F.count_if((F.col("gap") < 50000) & F.col("same")).alias("n_split"))


@query("""WITH r AS (SELECT l_suppkey, l_partkey, round_even(100.0::DOUBLE * min(l_quantity) / max(l_quantity), 1) AS ratio, avg(100 - l_discount * 100) AS pid, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT CASE WHEN ratio < 80 THEN 'TRUNCATED' WHEN round(pid, 6) >= 95 THEN 'ARTEFACT' ELSE 'VARIANT' END AS class, count(*) AS n, count(*) FILTER (WHERE n > 1) AS n_multi_copy FROM r GROUP BY 1""")
def variant_class(spark, sf_dir):
    rows = T.table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min("l_quantity").alias("a"), F.max("l_quantity").alias("b"), F.avg(100 - F.col("l_discount") * 100).alias("pid"), F.count(F.lit(1)).alias("n"))
    ratio = F.bround(100.0 * F.col("a") / F.col("b"), 1)
    return rows.select(C.variant_class(ratio, F.round("pid", 6)).alias("class"), "n").groupBy("class").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("n") > 1).alias("n_multi_copy")).withColumnRenamed("n_rows", "n")


@query("""WITH i AS (SELECT p_brand AS source, string_split(p_type || ' ', ' ') AS xs FROM part), x AS (SELECT source, trim(unnest(xs)) AS target, 1.0::DOUBLE / len(xs) AS w FROM i)
SELECT source, target, round(sum(w), 6) AS weight FROM x WHERE target <> '' GROUP BY 1, 2""")
def weighted_flow_links(spark, sf_dir):
    rows = M.weighted_items(T.table(spark, sf_dir, "part").select(F.col("p_brand").alias("source"), F.concat("p_type", F.lit(" ")).alias("list")), "list", " ")
    return rows.groupBy("source", F.col("item").alias("target")).agg(F.round(F.sum("weight"), 6).alias("weight"))


@query("SELECT p_type AS label, CAST(row_number() OVER (ORDER BY coalesce(i, 99), p_type) - 1 AS BIGINT) AS node FROM (SELECT DISTINCT p_type FROM part) LEFT JOIN (VALUES ('STANDARD', 1), ('ECONOMY', 2)) o(t, i) ON t = p_type")
def preferred_node_order(spark, sf_dir):
    kinds = T.table(spark, sf_dir, "part").select(F.col("p_type").alias("label")).distinct()
    return kinds.withColumn("node", (F.row_number().over(Window.orderBy(*A.in_listed_order(["STANDARD", "ECONOMY"], F.col("label")))) - 1).cast("long"))


@query("WITH " + T.PRESENCE + """, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY feature) AS rn, greatest(1, count(*) OVER (PARTITION BY entity) // 10) AS step FROM presence)
SELECT entity, feature FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY CASE WHEN (rn - 1) % step = 0 THEN 0 ELSE 1 END, rn) AS k FROM r) WHERE k <= 10""")
def systematic_sample(spark, sf_dir):
    return A.systematic_sample(T.presence(spark, sf_dir), ["entity"], ["feature"], 10)


@query("SELECT month(o_orderdate) AS step, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS least, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(median(o_totalprice), 4) AS mid, round(quantile_cont(o_totalprice, 0.75), 4) AS q3, max(o_totalprice) AS most FROM orders GROUP BY 1")
def accumulation_means(spark, sf_dir):
    from ..operators.summary import accumulation

    out = accumulation(T.table(spark, sf_dir, "orders").select(F.month("o_orderdate").cast("long").alias("step"), "o_totalprice"), "step", "o_totalprice")
    return out.select("step", F.round("mean", 4).alias("mean"), F.col("min").alias("least"), F.round("q1", 4).alias("q1"), F.round("median", 4).alias("mid"), F.round("q3", 4).alias("q3"), F.col("max").alias("most"))


@query("SELECT event_type, min(least(event_id, user_id)) AS first, max(greatest(event_id, user_id)) AS last, max(greatest(event_id, user_id)) - min(least(event_id, user_id)) AS size, round(avg((event_id + user_id) / 2), 6) AS mid, count(*) FILTER (WHERE lower(props) LIKE '%7%') AS flagged FROM events GROUP BY 1")
def region_extent(spark, sf_dir):
    out = R.extent(T.table(spark, sf_dir, "events"), ["event_type"], "event_id", "user_id", F.count_if(F.lower("props").contains("7")).alias("flagged"))
    return out.select("event_type", "first", "last", "size", F.round("middle", 6).alias("mid"), "flagged")


@query("SELECT c_custkey, printf('%.2f [%.2f-%.2f]', c_acctbal, c_acctbal - 10, c_acctbal + 10) AS interval_text, greatest(-500.0::DOUBLE, least(500.0::DOUBLE, c_acctbal)) AS inside, greatest(-500.0::DOUBLE, least(500.0::DOUBLE, c_acctbal)) <> c_acctbal AS was_clipped FROM customer")
def formatted_and_clipped(spark, sf_dir):
    b = F.col("c_acctbal")
    inside, moved = X.clipped(b, -500.0, 500.0)
    return T.table(spark, sf_dir, "customer").select("c_custkey", X.interval_text(b, b - 10, b + 10).alias("interval_text"), inside.alias("inside"), moved.alias("was_clipped"))


@query("WITH s AS (SELECT c_nationkey AS grp, c_custkey % 3 = 0 AS inside, c_acctbal < 0 AS split FROM customer), c AS (SELECT grp, count(*) FILTER (WHERE inside AND split) AS i, count(*) FILTER (WHERE NOT inside AND split) AS o FROM s GROUP BY 1) SELECT grp, i AS n_inside, o AS n_outside, CASE WHEN i > 0 AND o = 0 THEN 'group_only' WHEN i > 0 AND o > 0 THEN 'both' WHEN o > 0 THEN 'outside_only' ELSE 'none' END AS scope FROM c")
def split_scope(spark, sf_dir):
    c = T.table(spark, sf_dir, "customer")
    inside, split = F.col("c_custkey") % 3 == 0, F.col("c_acctbal") < 0
    rows = c.groupBy(F.col("c_nationkey").alias("grp")).agg(F.count_if(inside & split).alias("n_inside"), F.count_if(~inside & split).alias("n_outside"))
    return rows.withColumn("scope", C.split_scope(F.col("n_inside"), F.col("n_outside")))
