"""Queries on gene variants: names, lookups, statuses, copies and annotations. Parts stand for genes, brands for groups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import assign as A
from ..operators import classify as C
from ..operators import matrix as M
from ..operators import models as Mo
from ..operators import variants as V
from ..sources import readers as R
from . import tables as T
from .registry import query

#: Parts as variants of two-word genes, ``small, ring.3``.
_GENES = "g AS (SELECT p_partkey AS k, p_brand AS grp, replace(p_name, ' ', ', ') AS base, p_size % 5 AS number, replace(p_name, ' ', ', ') || '.' || (p_size % 5) AS feature, p_size, p_type, p_retailprice FROM part)"


def _genes(spark, sf_dir):
    base = F.replace("p_name", F.lit(" "), F.lit(", "))
    return T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("grp"), base.alias("base"), (F.col("p_size") % 5).alias("number"), F.concat(base, F.lit("."), (F.col("p_size") % 5).cast("string")).alias("feature"), "p_size", "p_type", "p_retailprice")


@query("WITH " + _GENES + ", n AS (SELECT k, CASE WHEN p_type = 'SMALL' THEN base ELSE feature END AS name, number FROM g) SELECT k, CASE WHEN name LIKE '%.%' THEN split_part(name, '.', 1) END AS base, CASE WHEN name LIKE '%.%' THEN number END AS number, CASE WHEN name LIKE '%.%' THEN '.' || number ELSE '' END AS suffix FROM n")
def suffix_parse(spark, sf_dir):
    name = F.when(F.col("p_type") == "SMALL", F.col("base")).otherwise(F.col("feature"))
    return _genes(spark, sf_dir).select("k", X.variant_base(name).alias("base"), X.variant_number(name).alias("number"), X.full_suffix(name).alias("suffix"))


@query("WITH " + _GENES + " SELECT DISTINCT grp, feature AS name FROM g")
def chunked_names(spark, sf_dir):
    """All variants of a brand in one comma list, cut into names of two parts again."""
    lists = _genes(spark, sf_dir).groupBy("grp").agg(F.array_join(F.array_sort(F.collect_set("feature")), ", ").alias("text"))
    return lists.select("grp", F.explode(X.chunk_names(F.col("text"), F.lit(2))).alias("name"))


_ACIDS = "".join(X._codon_table()[a + b + c] for a in "TCAG" for b in "TCAG" for c in "TCAG")
_LETTERS, _BASES = "abcdefghijklmnopqrstuvwxyz ", "ACGTACGTACGTACGTACGTACGTACA"
_CODON = "substr('" + _ACIDS + "', CAST(16 * (instr('TCAG', substr(rc, i * 3 + 1, 1)) - 1) + 4 * (instr('TCAG', substr(rc, i * 3 + 2, 1)) - 1) + instr('TCAG', substr(rc, i * 3 + 3, 1)) AS BIGINT), 1)"


@query(f"WITH d AS (SELECT p_partkey AS k, reverse(translate(translate(lower(p_name), '{_LETTERS}', '{_BASES}'), 'ACGT', 'TGCA')) AS rc FROM part) SELECT k, rc, array_to_string(list_transform(range(0, length(rc) // 3), lambda i: {_CODON}), '') AS protein FROM d")
def dna_translation(spark, sf_dir):
    rc = X.reverse_complement(F.translate(F.lower("p_name"), _LETTERS, _BASES))
    return T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), rc.alias("rc"), X.translate_dna(rc).alias("protein"))


@query("WITH t AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Merging' WHEN 'P' THEN 'weak 0.25' ELSE o_orderpriority END AS t FROM orders) SELECT o_orderkey, CASE WHEN t = 'Merging' THEN 1.0::DOUBLE WHEN t = 'weak 0.25' THEN 0.25 ELSE TRY_CAST(regexp_extract(t, '([0-9]+\\.?[0-9]*)', 1) AS DOUBLE) END AS value FROM t")
def phenotype_words(spark, sf_dir):
    status = F.col("o_orderstatus")
    text = F.when(status == "F", "Merging").when(status == "P", "weak 0.25").otherwise(F.col("o_orderpriority"))
    return T.table(spark, sf_dir, "orders").select("o_orderkey", X.phenotype_contains(text).alias("value"))


@query("""WITH e AS (SELECT p_partkey AS k, p_size / 10.0::DOUBLE - 0.1 AS ratio, (p_partkey * 7919 % 1000) / 1000.0::DOUBLE AS fdr, CASE WHEN p_type = 'SMALL' THEN 'Hypothetical_protein_' || p_partkey ELSE p_name END AS name FROM part),
l AS (SELECT *, CASE WHEN ratio <= 0.000001 THEN -99 ELSE log2(ratio) END AS lr, CASE WHEN fdr = 0 THEN 99 ELSE -log10(fdr) END AS nl FROM e)
SELECT k, round(lr, 9) AS effect, round(nl, 9) AS strength, CASE WHEN fdr < 0.05 AND lr > 1 THEN 'enriched' WHEN fdr < 0.05 AND lr < -1 THEN 'depleted' WHEN fdr < 0.05 THEN 'small effect' ELSE 'n.s.' END AS class,
CASE WHEN fdr < 0.01 AND abs(lr) > 2.5 THEN CASE WHEN name LIKE 'Hypothetical%' THEN 'hypo_' || k ELSE name END END AS label FROM l""")
def effect_sizes(spark, sf_dir):
    """Logarithms for a volcano plot, clipped to its axes, with classes and labels."""
    ratio = F.col("p_size") / 10.0 - 0.1
    rows = T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.when(ratio <= 0.000001, 0.0).otherwise(ratio).alias("ratio"), (F.col("p_partkey") * 7919 % 1000 / 1000.0).alias("fdr"), F.when(F.col("p_type") == "SMALL", F.concat(F.lit("Hypothetical_protein_"), F.col("p_partkey").cast("string"))).otherwise(F.col("p_name")).alias("name"))
    rows = rows.withColumns({"lr": X.log2_ratio(F.col("ratio")), "nl": X.neg_log10(F.col("fdr"))})
    return rows.select("k", F.round(X.clipped(F.col("lr"), -99.0, 99.0)[0], 9).alias("effect"), F.round(X.clipped(F.col("nl"), -99.0, 99.0)[0], 9).alias("strength"), X.volcano_class(F.col("fdr"), F.col("lr")).alias("class"), X.volcano_label(F.col("name"), F.col("fdr"), F.col("lr")).alias("label"))


@query("""WITH r AS (SELECT event_id, event_type, least(event_id, user_id) AS a, greatest(event_id, user_id) AS b, 2 * greatest(event_id, user_id) + 1 AS w FROM events), p AS (SELECT *, (a + b) / 2 AS mid, 100 * ((a + b) / 2) / w AS pct FROM r)
SELECT event_id, mid, round(pct, 9) AS percent, round(50.0::DOUBLE + (mid - 0) / 10000.0::DOUBLE * 900.0, 9) AS x, event_type || '_' || CAST(greatest(round_even((b - a) * 10 / 10000.0::DOUBLE, 0) * 10000, 10000) / 1000 AS INTEGER) || 'kb_' || CAST(greatest(0, least(100, round_even(pct / 20, 0) * 20)) AS INTEGER) || 'pct' AS name FROM p""")
def relative_positions(spark, sf_dir):
    a, b = F.least("event_id", "user_id"), F.greatest("event_id", "user_id")
    percent = X.relative_position(a, b, 2 * b + 1)
    return T.table(spark, sf_dir, "events").select("event_id", X.midpoint(a, b).alias("mid"), F.round(percent, 9).alias("percent"), F.round(X.affine(X.midpoint(a, b), 0.0, 10000.0, 50.0, 950.0), 9).alias("x"), X.binned_name(X.safe_known_name(F.col("event_type")), (b - a) * 10, percent).alias("name"))


@query("""WITH e AS (SELECT *, CASE WHEN event_type = 'view' THEN ' Intact ' ELSE event_type END AS completeness FROM events)
SELECT 'valid' AS rule, count(*) AS n FROM e WHERE user_id < event_id AND value > 0 UNION ALL SELECT 'intact', count(*) FROM e WHERE event_type = 'view'
UNION ALL SELECT 'named', count(*) FROM e WHERE event_type NOT LIKE 'cl%' AND event_type <> 'error' UNION ALL SELECT 'listed', count(*) FROM e WHERE event_type IN ('error', 'view')
UNION ALL SELECT 'covered', count(*) FROM e WHERE value / 20 >= 0.25""")
def region_filters(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").withColumn("completeness", F.when(F.col("event_type") == "view", " Intact ").otherwise(F.col("event_type")))
    found = {"valid": M.valid_regions(e, "user_id", "event_id", "value"), "intact": M.intact(e), "named": M.without_names(e, "event_type", ("cl",), ("error",)), "listed": M.listed(e, "event_type", ["error", "view"]), "covered": M.covered(e.withColumn("whole", F.lit(20.0)), "value", "whole")}
    out = None
    for rule, df in found.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("WITH " + _GENES + ", m AS (SELECT grp || base AS gene, count(DISTINCT number) AS n, avg(CASE WHEN p_size > 45 THEN 1.0 ELSE 0 END) AS rate FROM g GROUP BY 1) SELECT gene, n FROM m WHERE n > 1 AND rate <= 0")
def multi_variant_genes(spark, sf_dir):
    """Genes of several variants, none of whose parts is rejected."""
    g = _genes(spark, sf_dir).withColumn("gene", F.concat("grp", "base"))
    rates = g.groupBy("gene").agg(F.avg(F.when(F.col("p_size") > 45, 1.0).otherwise(0.0)).alias("rejection_rate"))
    several = V.multi_variant(g, "gene", "number").groupBy("gene").agg(F.count_distinct("number").alias("n"))
    return several.join(V.eligible_genes(rates).select("gene"), "gene")


@query("WITH " + _GENES + """, p AS (SELECT r.grp, r.k AS ref_k, o.k AS own_k, 100 - abs(r.p_retailprice - o.p_retailprice) / 10 AS identity, count(*) OVER (PARTITION BY r.grp) AS n FROM g r JOIN g o ON r.grp = o.grp AND r.p_size <= 25 AND o.p_size > 25),
s AS (SELECT grp, (SELECT count(*) FROM g x WHERE x.grp = p.grp AND x.p_size <= 25) AS n_ref_copies, (SELECT count(*) FROM g x WHERE x.grp = p.grp AND x.p_size > 25) AS n_own_copies, min(identity) AS least, max(identity) AS most, count(*) AS n_pairs FROM p GROUP BY grp)
SELECT s.grp, w.ref_k, w.own_k, round(least, 6) AS identity, round(most - least, 6) AS identity_spread, n_pairs, n_ref_copies, n_own_copies FROM s JOIN (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY grp ORDER BY identity, ref_k, own_k) = 1) w ON w.grp = s.grp WHERE n_ref_copies > 1 OR n_own_copies > 1""")
def copy_products(spark, sf_dir):
    """The most divergent pair of all copies of one genome with all of another, task by task."""
    g = _genes(spark, sf_dir).select("grp", "k", "p_size", F.col("p_retailprice").alias("v"))
    worst = V.extreme_copies(g.where("p_size <= 25"), g.where("p_size > 25"), ["grp"], "k", "v", lambda a, b: 100 - F.abs(a - b) / 10)
    return worst.select("grp", "ref_k", "own_k", F.round("identity", 6).alias("identity"), F.round("identity_spread", 6).alias("identity_spread"), "n_pairs", "n_ref_copies", "n_own_copies")


@query("WITH " + _GENES + ", f AS (SELECT DISTINCT feature, split_part(base, ', ', 1) AS first, number FROM g), w AS (SELECT DISTINCT first || '.' || number AS name FROM f UNION SELECT feature FROM f WHERE number < 2) SELECT name, coalesce((SELECT min(feature) FROM f WHERE feature = name), (SELECT min(feature) FROM f WHERE first || '.' || f.number = name)) AS feature FROM w")
def name_fallback(spark, sf_dir):
    f = _genes(spark, sf_dir).select("feature", "base", "number").distinct()
    names = f.select(F.concat(F.substring_index("base", ",", 1), F.lit("."), F.col("number").cast("string")).alias("name"))
    return V.by_name_or_first(names.unionByName(f.where("number < 2").select(F.col("feature").alias("name"))), f)


@query("""WITH e AS (SELECT DISTINCT user_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + CAST(floor(value) AS BIGINT) AS t, CASE WHEN user_id % 2 = 0 THEN 1 ELSE event_id % 2 END AS strand FROM events),
g AS (SELECT *, lead(s) OVER (PARTITION BY user_id ORDER BY s, t, strand) - t AS gap FROM e),
v AS (SELECT user_id, count(*) AS n_copies, min(gap) AS least_gap, min(strand) = max(strand) AS same_strand, min(t - s + 1) / max(t - s + 1) AS r FROM g GROUP BY 1 HAVING count(*) > 1)
SELECT user_id, n_copies, least_gap, same_strand, round_even(r, 3) AS ratio, r < 0.5 AS truncated, CASE WHEN least_gap < 5000 AND same_strand AND r < 0.9 THEN 'split_unequal' WHEN least_gap < 5000 AND same_strand THEN 'split_similar' WHEN least_gap < 5000 THEN 'close' ELSE 'distant' END AS flag, coalesce(least_gap < 5000 AND same_strand, false) AS is_split FROM v""")
def copy_split_verdicts(spark, sf_dir):
    start = F.expr("unix_seconds(cast(ts as timestamp))")
    e = T.table(spark, sf_dir, "events").select("user_id", start.alias("s"), (start + F.floor("value").cast("long")).alias("t"), F.when(F.col("user_id") % 2 == 0, 1).otherwise(F.col("event_id") % 2).alias("strand"))
    return C.copy_verdicts(e.withColumn("length", F.col("t") - F.col("s") + 1), ["user_id"], "s", "t", "strand", "length")


@query("""WITH c AS (SELECT c_nationkey AS grp, count(*) FILTER (WHERE c_mktsegment <> 'BUILDING' AND c_acctbal < -800) AS s, count(*) FILTER (WHERE c_mktsegment <> 'BUILDING' AND c_acctbal >= 9500) AS i FROM customer GROUP BY 1)
SELECT grp, s AS outside_split, i AS outside_intact, CASE WHEN s > 0 THEN 'also_outside' WHEN i > 0 THEN 'split_unique' ELSE 'unique' END AS uniqueness FROM c""")
def split_uniqueness(spark, sf_dir):
    outside, b = F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal")
    rows = T.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("grp")).agg(F.count_if(outside & (b < -800)).alias("outside_split"), F.count_if(outside & (b >= 9500)).alias("outside_intact"))
    return rows.withColumn("uniqueness", C.split_uniqueness(F.col("outside_split"), F.col("outside_intact")))


_STATUS = _GENES + """, c AS (SELECT *, CASE p_type WHEN 'SMALL' THEN 'ARTEFACT' WHEN 'LARGE' THEN 'VARIANT' WHEN 'PROMO' THEN 'TRUNCATED' END AS cls, number > 0 AS is_variant FROM g),
pr AS (SELECT *, CASE WHEN cls = 'ARTEFACT' AND k % 2 = 1 AND p_size > 10 THEN 'KEEP (multi-copy)' WHEN cls = 'ARTEFACT' THEN 'REMOVE' WHEN cls IS NOT NULL THEN 'KEEP' WHEN is_variant THEN 'KEEP (not validated)' ELSE 'KEEP (not a variant)' END AS status FROM c WHERE p_retailprice < 950),
ab AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM pr WHERE pr.grp = c.grp AND pr.base = c.base AND pr.cls = 'ARTEFACT') THEN 'REMOVE (paired artefact)' WHEN EXISTS (SELECT 1 FROM pr WHERE pr.grp = c.grp AND pr.base = c.base) THEN 'KEEP (other variant in genome)' ELSE 'KEEP (gene missing)' END AS status FROM c WHERE p_retailprice >= 950),
st AS (SELECT grp, 'present' AS section, status FROM pr UNION ALL SELECT grp, 'absent', status FROM ab)"""


def _statuses(spark, sf_dir):
    t = F.col("p_type")
    g = _genes(spark, sf_dir).withColumns({"cls": F.when(t == "SMALL", "ARTEFACT").when(t == "LARGE", "VARIANT").when(t == "PROMO", "TRUNCATED"), "is_variant": F.col("number") > 0})
    present, absent = g.where("p_retailprice < 950"), g.where("p_retailprice >= 950")
    status = C.present_status(F.col("is_variant"), F.col("cls"), F.col("k") % 2 + 1, F.col("p_size"))
    marks = present.select("grp", "base", (F.coalesce("cls", F.lit("")) == "ARTEFACT").alias("artefact"))
    paired = V.paired_artifacts(absent, marks).select("k", F.lit(True).alias("paired"))
    found = absent.join(present.select("grp", "base").distinct(), ["grp", "base"], "left_semi").select("k", F.lit(True).alias("found"))
    judged = absent.join(paired, "k", "left").join(found, "k", "left").fillna(False, ["paired", "found"])
    return present.select("grp", F.lit("present").alias("section"), status.alias("status")).unionByName(judged.select("grp", F.lit("absent").alias("section"), C.absent_status(F.col("paired"), F.col("found")).alias("status")))


@query("WITH " + _STATUS + " SELECT section, status, count(*) AS n FROM st GROUP BY 1, 2")
def feature_statuses(spark, sf_dir):
    return _statuses(spark, sf_dir).groupBy("section", "status").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + _STATUS + " SELECT section, count(*) AS n, count(*) FILTER (WHERE status LIKE 'REMOVE%') AS n_removed, count(*) FILTER (WHERE status NOT LIKE 'REMOVE%') AS n_kept, count(DISTINCT grp) FILTER (WHERE status LIKE 'REMOVE%') AS groups_affected FROM st GROUP BY 1")
def removal_summary(spark, sf_dir):
    return V.removal_totals(_statuses(spark, sf_dir))


_HOME = "Supplier#000000003"


@query(f"""WITH v AS (SELECT DISTINCT p_brand || ' ' || p_name AS base, p_size % 5 AS number, s_name AS strain FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey),
t AS (SELECT base, number, base || '.' || number AS variant, count(*) AS times, min(strain) AS first, bool_or(strain = '{_HOME}') AS home FROM v GROUP BY 1, 2),
c AS (SELECT r_regionkey AS grp, t.*, number = r_regionkey AS own FROM t, region),
k AS (SELECT grp, base, max(CASE WHEN number = 0 THEN variant END) AS zero, bool_or(number = 0 AND home) AS zero_home, bool_or(number = 0 AND own) AS zero_own, max(CASE WHEN number = 0 THEN first END) AS zero_first,
  arg_min(variant, number) FILTER (WHERE home) AS low, arg_min(own, number) FILTER (WHERE home) AS low_own, arg_min(variant, (-times, number)) FILTER (WHERE NOT own) AS other, arg_min(first, (-times, number)) FILTER (WHERE NOT own) AS other_first FROM c GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN zero_home THEN 1 WHEN zero IS NOT NULL THEN 2 WHEN low IS NULL THEN 5 WHEN NOT low_own THEN 3 WHEN other IS NOT NULL THEN 4 ELSE 5 END AS rank FROM k WHERE NOT zero_own)
SELECT grp, base, CASE rank WHEN 1 THEN zero WHEN 2 THEN zero WHEN 3 THEN low WHEN 4 THEN other ELSE base END AS reference, CASE rank WHEN 2 THEN zero_first WHEN 4 THEN other_first ELSE '{_HOME}' END AS strain, rank FROM r""")
def reference_variants(spark, sf_dir):
    line, p, s, r = (T.table(spark, sf_dir, x) for x in ("lineitem", "part", "supplier", "region"))
    v = line.join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.concat_ws(" ", "p_brand", "p_name").alias("base"), (F.col("p_size") % 5).alias("number"), F.col("s_name").alias("strain")).distinct()
    v = v.withColumn("variant", F.concat("base", F.lit("."), F.col("number").cast("string")))
    groups = F.broadcast(r.select(F.col("r_regionkey").alias("grp")))  # five regions
    return C.reference_variant(v.crossJoin(groups).withColumn("own", F.col("number") == F.col("grp")), _HOME)


@query("WITH " + _GENES + """, f AS (SELECT DISTINCT grp, feature, base FROM g), b AS (SELECT DISTINCT grp, feature, unnest(string_split(base, ', ')) AS word FROM g),
e AS (SELECT grp, k, feature AS entry, unnest(string_split(base, ', ')) AS word, CASE p_type WHEN 'SMALL' THEN 'Yes, split' WHEN 'LARGE' THEN 'no' WHEN 'PROMO' THEN 'checked: not split' WHEN 'ECONOMY' THEN '' ELSE 'maybe' END AS verdict, CASE WHEN p_size > 25 THEN 'UNIQUE to group' ELSE 'ALSO OUTSIDE' END AS uniqueness FROM g WHERE p_retailprice < 950),
h AS (SELECT b.grp, feature, arg_min(verdict, k) AS verdict, arg_min(uniqueness, k) AS uniqueness FROM b JOIN e ON e.grp = b.grp AND e.word = b.word GROUP BY 1, 2),
q AS (SELECT DISTINCT b.grp, b.feature FROM b JOIN (SELECT grp, unnest(string_split(base, ', ')) AS word FROM g WHERE p_size % 5 = 0) x ON x.grp = b.grp AND x.word = b.word),
c AS (SELECT f.grp, f.feature, CASE WHEN q.grp IS NULL THEN 'none' WHEN h.grp IS NULL THEN 'duplicate' WHEN lower(verdict) LIKE 'yes%' THEN 'split' WHEN lower(verdict) LIKE 'no%' OR lower(verdict) LIKE '%not split%' THEN 'not_split_duplicate' ELSE 'unchecked' END AS category, verdict, uniqueness, 'copies of ' || f.feature AS t FROM f LEFT JOIN q ON q.grp = f.grp AND q.feature = f.feature LEFT JOIN h ON h.grp = f.grp AND h.feature = f.feature)
SELECT grp, feature, category, CASE category WHEN 'none' THEN 'no' WHEN 'duplicate' THEN 'yes, ' || t WHEN 'split' THEN 'split gene (1 functional copy)' || CASE WHEN uniqueness LIKE '%UNIQUE%' THEN ', split unique to group' ELSE ', split also in other strains' END WHEN 'not_split_duplicate' THEN 'yes, ' || t || ' (' || verdict || ')' ELSE 'likely split, needs check (' || t || ')' END AS note FROM c""")
def paralog_notes(spark, sf_dir):
    g = _genes(spark, sf_dir).withColumn("bases", F.split("base", ", "))
    t = F.col("p_type")
    verdict = F.when(t == "SMALL", "Yes, split").when(t == "LARGE", "no").when(t == "PROMO", "checked: not split").when(t == "ECONOMY", "").otherwise("maybe")
    reviewed = g.where("p_retailprice < 950").select("grp", F.col("feature").alias("entry"), "bases", verdict.alias("verdict"), F.when(F.col("p_size") > 25, "UNIQUE to group").otherwise("ALSO OUTSIDE").alias("uniqueness"), F.col("k").alias("row"))
    paralogs = g.where("number = 0").select("grp", F.col("feature").alias("entry"), "bases", F.col("k").alias("row"))
    features = g.select("grp", "feature", "bases").distinct()
    return V.annotate(features, reviewed, paralogs, features.select("grp", "feature", F.concat(F.lit("copies of "), "feature").alias("text")))


@query("""WITH w AS (SELECT p_partkey AS task, p_brand AS strain, split_part(p_name, ' ', 2) AS a, split_part(p_name, ' ', 1) AS b FROM part), n AS (SELECT DISTINCT p_brand AS strain, split_part(p_name, ' ', CASE WHEN p_type = 'SMALL' THEN 2 ELSE 1 END) AS gene, p_type AS aa FROM part WHERE p_size < 20)
SELECT task, gene, aa FROM w JOIN n ON n.strain = w.strain AND n.gene = CASE WHEN EXISTS (SELECT 1 FROM n x WHERE x.strain = w.strain AND x.gene = a) THEN a ELSE b END""")
def first_known_names(spark, sf_dir):
    p, word = T.table(spark, sf_dir, "part"), lambda i: F.split("p_name", " ")[i]
    wanted = p.select(F.col("p_brand").alias("strain"), F.col("p_partkey").alias("task"), F.array(word(1), word(0)).alias("names"))
    known = p.where("p_size < 20").select(F.col("p_brand").alias("strain"), F.when(F.col("p_type") == "SMALL", word(1)).otherwise(word(0)).alias("gene"), F.col("p_type").alias("aa")).distinct()
    return V.first_known(wanted, known).select("task", "gene", "aa")


@query("WITH m AS (SELECT s_nationkey AS grp, s_suppkey AS strain, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS rn FROM supplier), v AS (SELECT DISTINCT s_nationkey AS grp, p_type AS variant FROM supplier, part) SELECT v.grp, variant, strain FROM v JOIN m ON m.grp = v.grp WHERE rn <= 3")
def task_fan_out(spark, sf_dir):
    s = T.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("grp"), F.col("s_suppkey").alias("strain"), F.col("s_acctbal").alias("rank"))
    kinds = T.table(spark, sf_dir, "part").select(F.col("p_type").alias("variant")).distinct()
    return V.fan_out(s.select("grp").distinct().crossJoin(kinds), s).select("grp", "variant", "strain")


@query("SELECT c_custkey AS k, CASE WHEN c_acctbal <= 0 THEN 'reference sequence missing' ELSE 'group sequence missing' END AS reason FROM customer c WHERE c_acctbal <= 0 OR NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def failed_tasks(spark, sf_dir):
    c = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal")
    own = T.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"))
    return V.failed_lookups(c.select("k"), c.where("c_acctbal > 0"), own, ["k"])


@query("SELECT p_brand, round(avg(p_retailprice), 6) AS mean, arg_min(p_type, p_partkey) AS first, count(*) AS n_strains FROM part GROUP BY 1")
def variant_means(spark, sf_dir):
    out = V.variant_averages(T.table(spark, sf_dir, "part"), ["p_brand"], ["p_retailprice"], ["p_type"], "p_partkey")
    return out.select("p_brand", F.round("p_retailprice", 6).alias("mean"), F.col("p_type").alias("first"), "n_strains")


@query("SELECT p_brand, count(*) AS n, count(*) FILTER (WHERE p_type LIKE '%SMALL%') AS n_small, count(*) FILTER (WHERE p_type LIKE '%LARGE%') AS n_large FROM part GROUP BY 1")
def class_counts(spark, sf_dir):
    return V.class_counts_by_group(T.table(spark, sf_dir, "part"), "p_brand", "p_type", ["SMALL", "LARGE"])


@query("""WITH c AS (SELECT p_brand AS feature, l_suppkey AS strain, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2), m AS (SELECT s_nationkey AS grp, s_suppkey AS strain FROM supplier), z AS (SELECT grp, count(*) AS size FROM m GROUP BY 1), a AS (SELECT feature, sum(n) AS total FROM c GROUP BY 1)
SELECT m.grp, c.feature, CAST(sum(n) AS BIGINT) AS n_in, CAST(any_value(total) - sum(n) AS BIGINT) AS n_out, CASE WHEN min(n) = max(n) THEN CAST(min(n) AS VARCHAR) ELSE min(n) || '-' || max(n) END || ' copies in ' || count(*) || '/' || any_value(size) || ' group strains' AS text FROM c JOIN m ON m.strain = c.strain JOIN a ON a.feature = c.feature JOIN z ON z.grp = m.grp GROUP BY 1, 2""")
def copy_ranges(spark, sf_dir):
    line, p, s = (T.table(spark, sf_dir, x) for x in ("lineitem", "part", "supplier"))
    copies = line.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("feature"), F.col("l_suppkey").alias("strain")).agg(F.count(F.lit(1)).alias("n"))
    rows = V.copy_counts(copies, s.select(F.col("s_nationkey").alias("grp"), F.col("s_suppkey").alias("strain")))
    return rows.select("grp", "feature", "n_in", "n_out", V.range_text(*(F.col(c) for c in ("low", "high", "have", "size"))).alias("text"))


@query("WITH c AS (SELECT c_nationkey AS grp, c_name AS name, c_acctbal >= 0 AS p, row_number() OVER (PARTITION BY c_nationkey, c_acctbal >= 0 ORDER BY c_name) AS line FROM customer) SELECT coalesce(a.grp, b.grp) AS grp, CAST(coalesce(a.line, b.line) AS INTEGER) AS line, a.name AS present, b.name AS absent FROM (SELECT * FROM c WHERE p) a FULL JOIN (SELECT * FROM c WHERE NOT p) b ON a.grp = b.grp AND a.line = b.line")
def side_layout(spark, sf_dir):
    c = T.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("grp"), F.when(F.col("c_acctbal") >= 0, "present").otherwise("absent").alias("section"), F.col("c_name").alias("name"))
    return V.side_by_side(c, "grp", "section", "name").select("grp", "line", "present", "absent")


@query("SELECT p_brand AS base_gene, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INTEGER) AS comparison, p_name AS variant1, p_type AS variant2, 's' || p_size AS strain1, p_retailprice AS identity FROM part")
def nested_rows(spark, sf_dir):
    p = T.table(spark, sf_dir, "part")
    detail = F.array(F.struct(F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("strain1"), F.col("p_retailprice").alias("identity")))
    docs = p.groupBy(F.col("p_brand").alias("base_gene")).agg(F.array_sort(F.collect_list(F.struct(F.col("p_partkey").alias("k"), F.col("p_name").alias("variant1"), F.col("p_type").alias("variant2"), detail.alias("pairwise")))).alias("comparisons"))
    one, two = V.result_rows(docs)
    return one.drop("k").join(two, ["base_gene", "comparison"])


@query("WITH c AS (SELECT DISTINCT p_name AS a, p_type AS b FROM part WHERE p_size <= 25), m AS (SELECT DISTINCT p_type AS a, p_name AS b FROM part WHERE p_size > 45) SELECT c.a AS variant1, c.b AS variant2 FROM c WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.a = c.b AND m.b = c.a)")
def unmerged_pairs(spark, sf_dir):
    p = T.table(spark, sf_dir, "part")
    pair = lambda df, a, b: df.select(F.col(a).alias("variant1"), F.col(b).alias("variant2")).distinct()
    return V.without_merged(pair(p.where("p_size <= 25"), "p_name", "p_type"), pair(p.where("p_size > 45"), "p_type", "p_name"))


_STRAIN_GENES = "sg AS (SELECT DISTINCT s_nationkey AS strain, p_brand AS gene FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey)"


def _strain_genes(spark, sf_dir):
    line, s, p = (T.table(spark, sf_dir, x) for x in ("lineitem", "supplier", "part"))
    return line.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("s_nationkey").alias("strain"), F.col("p_brand").alias("gene")).distinct()


@query("WITH " + _STRAIN_GENES + " SELECT strain, CASE WHEN strain % 3 = 2 THEN gene || '_' || strain ELSE gene END AS gene FROM sg")
def renamed_genes(spark, sf_dir):
    g, k = _strain_genes(spark, sf_dir), F.col("strain") % 3
    names = g.withColumn("name", F.when(k == 0, "None").when(k == 2, F.concat("gene", F.lit("_"), F.col("strain").cast("string"))))
    return Mo.renamed(g, names)


@query("WITH " + _STRAIN_GENES + ", n AS (SELECT n_nationkey AS strain, count(gene) AS n_genes, count(*) FILTER (WHERE gene IN ('Brand#1', 'Brand#2')) AS n_reactions FROM nation LEFT JOIN sg ON sg.strain = n_nationkey GROUP BY 1) SELECT * FROM n")
def model_summaries(spark, sf_dir):
    g = _strain_genes(spark, sf_dir)
    sets = T.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("strain")).join(g.groupBy("strain").agg(F.collect_set("gene").alias("genes")), "strain", "left").select("strain", F.coalesce("genes", F.array().cast("array<string>")).alias("genes"))
    return Mo.model_summary(sets, g.where("gene IN ('Brand#1', 'Brand#2')").select("strain", F.col("gene").alias("reaction")))


@query("SELECT n_name AS label, CAST(row_number() OVER (ORDER BY n_nationkey) AS INTEGER) AS place FROM nation")
def natural_groups(spark, sf_dir):
    """NATION_2 before NATION_10."""
    return T.table(spark, sf_dir, "nation").select(F.col("n_name").alias("label"), F.row_number().over(Window.orderBy(*A.natural_order(F.col("n_name")))).alias("place"))


@query("WITH l AS (SELECT p_brand, list_sort(list(DISTINCT p_name)) AS x FROM part GROUP BY 1) SELECT p_brand, len(x) AS n, x[1] AS item_1, x[2] AS item_2, x[3] AS item_3 FROM l")
def ragged_items(spark, sf_dir):
    grouped = M.items_by_group(T.table(spark, sf_dir, "part"), "p_brand", "p_name")
    return grouped.select("p_brand", "n").join(M.item_columns(grouped, "p_brand", 3), "p_brand")


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("WITH c AS (SELECT p_type AS t, count(*) FILTER (WHERE p_size <= 25) AS low, count(*) FILTER (WHERE p_size > 25) AS high FROM part GROUP BY 1) SELECT name AS \"column\", " + ", ".join(f"CAST(max(CASE WHEN t = '{t}' THEN v END) AS BIGINT) AS {t}" for t in _TYPES) + " FROM (SELECT t, 'low' AS name, low AS v FROM c UNION ALL SELECT t, 'high', high FROM c) GROUP BY 1")
def transposed_counts(spark, sf_dir):
    wide = T.table(spark, sf_dir, "part").groupBy("p_type").agg(F.count_if(F.col("p_size") <= 25).alias("low"), F.count_if(F.col("p_size") > 25).alias("high"))
    return M.transposed(wide, "p_type", _TYPES)


@query("WITH h AS (SELECT l_partkey AS gene, s_nationkey AS strain, max(s_name) AS id FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2) SELECT p_partkey AS gene, n_nationkey AS strain, coalesce(id, 'None') AS id FROM part CROSS JOIN nation LEFT JOIN h ON gene = p_partkey AND strain = n_nationkey")
def gene_ids(spark, sf_dir):
    s = T.table(spark, sf_dir, "supplier")
    hits = T.table(spark, sf_dir, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_partkey").alias("gene"), F.col("s_nationkey").alias("strain")).agg(F.max("s_name").alias("id"))
    return M.gene_matrix(T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene")), T.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("strain")), hits)


@query("WITH p AS (SELECT p_partkey AS k, p_brand AS strain FROM part) SELECT 'BSU_' || k AS tag, strain, CASE k % 4 WHEN 0 THEN 'BSU_' || k WHEN 1 THEN 'CUSTOM_' || k WHEN 2 THEN 'BSU' || k ELSE 'X' || k END AS locus_tag FROM p")
def alias_lookup(spark, sf_dir):
    """Each part's tag under one of the spellings that the lookup knows."""
    k, n = F.col("p_partkey").cast("string"), F.col("p_partkey") % 4
    p = T.table(spark, sf_dir, "part")
    features = p.select(F.col("p_brand").alias("strain"), F.when(n == 0, F.concat(F.lit("BSU_"), k)).when(n == 1, F.concat(F.lit("CUSTOM_"), k)).when(n == 2, F.concat(F.lit("BSU"), k)).otherwise(F.concat(F.lit("X"), k)).alias("locus_tag"), F.when(n == 3, F.concat(F.lit("p [locus_tag="), k, F.lit("]"))).alias("product"), F.col("p_partkey").alias("start"), (F.col("p_partkey") + 1).alias("end"))
    return R.by_alias(p.select(F.concat(F.lit("BSU_"), k).alias("tag")), features).select("tag", "strain", "locus_tag")
