"""URL filters: declared host and path rules, and association rules mined from labels.

FP-growth (pyspark.ml) mines combinations of URL tokens together with the label
``block``. A combination becomes a blocking rule when its support and its
confidence reach the parameters; a rule is dropped when a shorter one within it
is at least as confident. So that a long URL doesn't make every combination of
its words frequent,

* tokens that stand on just the same labelled pages are one class, mined as one:
  a rule with two of them has an equally confident one within it;
* tokens that are rules with confidence 1 alone, or whose blocked pages are too
  few, take no part in longer rules;
* rules are pruned size by size: what holds a rule of confidence 1 goes no further.

A rule is a list of classes and matches where each of them has a token. Rules
match pages through an inverted index: each rule stands under the tokens of its
rarest class, page tokens are joined with that index, and the other classes are
checked on the hits.

Defined results: a null url or one without ``://`` has an empty host and path
and no tokens; equal urls get equal verdicts, repeated rows stay; an empty
pages table gives an empty result; without labelled pages no rule is mined and
pages outside the declared rules are allowed; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import small_side, write_table

# The declared rules as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = "label:block"
#: Least share of the labelled pages, and least share of blocked ones among those that match.
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.6
#: And the least number of rows behind a rule, for small tables; 0: the share alone decides.
MIN_PAGES = 0
_RULES = "antecedent array<string>, classes array<array<string>>, support double, confidence double, rule_id string"


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def declared_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: the host and its last two labels, its first label, path words, extension, query keys, fragment."""
    labels = F.split(host, r"\.")
    words = F.filter(F.split(path, "/"), lambda x: (x != "") & ~x.rlike(r"^[0-9]+$") & ~x.contains("."))
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    one = lambda on, token: F.when(on, F.array(token)).otherwise(F.array().cast("array<string>"))
    last = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    return F.array_distinct(
        F.concat(
            one(host != "", F.concat(F.lit("host:"), host)),
            one(F.size(labels) >= 2, F.concat(F.lit("site:"), F.array_join(F.slice(labels, -2, 2), "."))),
            one(F.size(labels) >= 3, F.concat(F.lit("sub:"), labels[0])),
            F.transform(words, lambda x: F.concat(F.lit("path:"), x)),
            one(last != "", F.concat(F.lit("ext:"), last)),
            F.transform(keys, lambda x: F.concat(F.lit("key:"), x)),
            one(url.contains("#"), F.lit("fragment")),
        )
    )


def tokenised(pages: DataFrame) -> DataFrame:
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    known = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url").withColumns({"host": host, "path": path})
    return known.withColumn("tokens", F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(url_tokens(F.col("url"), F.col("host"), F.col("path"))))


def _token_classes(labelled: DataFrame) -> DataFrame:
    """(token, n_all, n_block, of): ``of`` is the least token of those that stand on the same rows. Rows are told apart by their tokens; two 64-bit sums stand for the rows of a token."""
    held = F.array_sort("tokens")
    rows = labelled.groupBy(held.alias("tokens")).agg(F.count(F.lit(1)).alias("n_all"), F.count_if("blocked").alias("n_block"))
    each = rows.select(F.explode("tokens").alias("token"), "n_all", "n_block", F.xxhash64("tokens").alias("h"), F.xxhash64(F.lit(1), "tokens").alias("g"))
    tokens = each.groupBy("token").agg(F.sum("n_all").alias("n_all"), F.sum("n_block").alias("n_block"), F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g"))
    first = tokens.groupBy("h", "g", "n_all").agg(F.min("token").alias("of"))
    return tokens.join(first, ["h", "g", "n_all"]).select("token", "n_all", "n_block", "of")


def _mixed_rows(labelled: DataFrame, wanted: DataFrame) -> DataFrame:
    """Labelled rows with those of their tokens that are ``wanted``, found once for each set of tokens."""
    keyed = labelled.select(F.array_sort("tokens").alias("tokens"), "blocked")
    sets = keyed.select("tokens").distinct().select("tokens", F.explode("tokens").alias("token"))
    kept = sets.join(small_side(wanted), "token").groupBy("tokens").agg(F.collect_list("token").alias("kept"))
    return keyed.join(kept, "tokens").select("kept", "blocked")


def _minimal(sets: DataFrame, min_confidence: float) -> list[DataFrame]:
    """Of combinations (antecedent, n_block, n_all) the rules without a shorter one within that is at least as confident, size by size.

    ``top`` is the greatest confidence of a rule within a combination, itself included; one whose top is 1 is in no minimal rule.
    """
    confidence = F.col("n_block") / F.col("n_all")
    own = F.when(confidence >= min_confidence, confidence).otherwise(0.0)
    sets = sets.select("antecedent", "n_block", "n_all", own.alias("own"), F.array_join("antecedent", " ").alias("id"), F.size("antecedent").alias("size"))
    found, below, size = [], None, 0
    while True:
        size += 1
        now = sets.where(F.col("size") == size)
        if below is None:
            now = now.withColumn("inner", F.lit(0.0))
        else:
            parts = now.select("id", F.explode(F.transform("antecedent", lambda x: F.array_join(F.array_remove("antecedent", x), " "))).alias("part"))
            inner = parts.join(below.select(F.col("id").alias("part"), "top"), "part").groupBy("id").agg(F.max("top").alias("inner"), F.count(F.lit(1)).alias("n"))
            now = now.join(inner.where(F.col("n") == size).drop("n"), "id")  # a missing part has top 1
        level, _ = write_table(now.select("antecedent", "n_block", "n_all", "own", "inner", "id", F.greatest("own", "inner").alias("top")), "rule-level")
        if level.isEmpty():
            return found
        found.append(level.where(F.col("own") > F.col("inner")).select("antecedent", "n_block", "n_all"))
        below = level.where(F.col("top") < 1)


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_pages: int = MIN_PAGES) -> DataFrame:
    """Rows (tokens, blocked boolean) to rules (rule_id, antecedent, classes, support, confidence), from all rows. ``min_support`` is a share of the rows; ``min_pages`` a number besides."""
    spark = labelled.sparkSession
    labelled, _ = write_table(labelled.where(F.size("tokens") > 0).select("tokens", "blocked"), "labelled")
    n = labelled.count()
    if not n:
        return spark.createDataFrame([], _RULES)
    least = max(1, min_pages, math.ceil(min_support * n - 1e-9))
    tokens, _ = write_table(_token_classes(labelled).where(F.col("n_block") >= least), "token-classes")
    single, mixed = tokens.where("n_block = n_all and token = of"), tokens.where("n_block < n_all and token = of").select("token")
    rows, _ = write_table(_mixed_rows(labelled, mixed), "mixed-rows")
    items = rows.select(F.when(F.col("blocked"), F.concat("kept", F.array(F.lit(BLOCK)))).otherwise(F.col("kept")).alias("items"))
    among = rows.count()  # rows that have any such token
    found = [single.select(F.array("token").alias("antecedent"), "n_block", "n_all")]
    if among:
        sets = FPGrowth(itemsCol="items", minSupport=min(1.0, max(0.0, (least - 0.5) / among)), minConfidence=1.0).fit(items).freqItemsets
        with_label = F.array_contains("items", BLOCK)
        whole = sets.where(~with_label).select(F.array_sort("items").alias("antecedent"), F.col("freq").alias("n_all"))
        block = sets.where(with_label & (F.size("items") > 1)).select(F.array_sort(F.array_remove("items", BLOCK)).alias("antecedent"), F.col("freq").alias("n_block"))
        found += _minimal(write_table(block.join(whole, "antecedent"), "rule-sets")[0], min_confidence)
    rules = found[0]
    for level in found[1:]:
        rules = rules.unionByName(level)
    rules = rules.withColumn("rule_id", F.array_join("antecedent", " "))
    members = tokens.groupBy("of").agg(F.array_sort(F.collect_set("token")).alias("class"))
    classes = rules.select("rule_id", F.explode("antecedent").alias("of")).join(members, "of").groupBy("rule_id").agg(F.collect_list("class").alias("classes"))
    return rules.join(classes, "rule_id").select("antecedent", "classes", (F.col("n_block") / n).alias("support"), (F.col("n_block") / F.col("n_all")).alias("confidence"), "rule_id")


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, mined_rule, confidence) of the best rule of each page that any rule matches; ``pages`` has ``url`` and ``tokens``.

    Among equally confident rules the one with the greatest name wins; a rule's name on a page has the greatest token there of each class.
    """
    urls = pages.select("url", "tokens").distinct()
    counts = urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    wanted = rules.select("rule_id", F.explode("classes").alias("class")).select("rule_id", "class", F.explode("class").alias("token"))
    rarest = wanted.join(counts, "token", "left").groupBy("rule_id", "class").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).groupBy("rule_id").agg(F.min(F.struct("n", "class")).alias("rarest"))
    index, _ = write_table(rules.join(rarest, "rule_id").select(F.explode("rarest.class").alias("token"), "rule_id", "classes", "confidence"), "rule-index")
    hits = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(small_side(index), "token")
    hits = hits.where(F.forall("classes", lambda c: F.arrays_overlap(c, "tokens")))
    name = F.array_join(F.array_sort(F.transform("classes", lambda c: F.array_max(F.array_intersect(c, "tokens")))), " ")
    return hits.groupBy("url").agg(F.max(F.struct("confidence", name.alias("rule_id"))).alias("best")).select("url", F.col("best.rule_id").alias("mined_rule"), F.col("best.confidence").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule for every page.

    A page is labelled by the row of ``labels`` whose doc_id is its page_id
    (repeated labels: any that blocks); toxic or low quality means block.
    """
    known = tokenised(pages)
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.max((F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)).alias("blocked"))
    mined, _ = write_table(mine_rules(known.join(marks, "page_id").select("tokens", "blocked"), min_support, min_confidence, min_pages), "mined-rules")
    found = match_rules(known, mined)
    rule, verdict = declared_rule(F.col("host"), F.col("path"), rules)
    out = known.join(found, "url", "left")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")).alias("verdict"), "mined_rule")
