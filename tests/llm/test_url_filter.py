import itertools
import random
import time

from loomgrid.llm import url_filter


def brute_rules(rows, min_support, min_confidence):
    """All token sets with enough blocked rows and confidence and no shorter one within that is at least as confident."""
    tokens, least = sorted({t for ts, _ in rows for t in ts}), max(1, -(-int(min_support * len(rows) * 1e6) // 10**6))
    found = {}
    for size in range(1, len(tokens) + 1):
        for ts in itertools.combinations(tokens, size):
            have = [b for row, b in rows if set(ts) <= set(row)]
            if sum(have) >= least and sum(have) / len(have) >= min_confidence:
                found[ts] = sum(have) / len(have)
    return {ts: c for ts, c in found.items() if not any(set(o) < set(ts) and found[o] >= c for o in found)}


def test_rules_and_matches_against_brute_force(spark):
    rng = random.Random(12)
    for seed in range(3):
        rows = [([t for t in "abcdefg" if rng.random() < 0.5], rng.random() < 0.5) for _ in range(60)]
        rows = [(ts + ["h", "i"] * ("a" in ts), b) for ts, b in rows]  # a, h and i stand on the same rows
        want = brute_rules([r for r in rows if r[0]], 0.05, 0.55)
        mined = url_filter.mine_rules(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"), 0.05, 0.55)
        got = {ts: r.confidence for r in mined.collect() for ts in map(tuple, map(sorted, itertools.product(*r.classes)))}
        assert got == want, seed
        pages = [(f"u{i}", sorted(t for t in "abcdefghi" if rng.random() < 0.5)) for i in range(40)]
        best = {r.url: r.mined_rule for r in url_filter.match_rules(spark.createDataFrame(pages, "url string, tokens array<string>"), mined).collect()}
        for url, ts in pages:
            fits = [(c, " ".join(r)) for r, c in want.items() if set(r) <= set(ts)]
            assert best.get(url) == (max(fits)[1] if fits else None)


def test_long_urls_that_repeat(spark):
    """Forty path words on a dozen labelled pages, some of which are blocked: no combination of them is written out."""
    words = [f"w{i}" for i in range(40)]
    urls = [("https://a.net/" + "/".join(words), i % 3 > 0) for i in range(12)] + [("https://b.net/" + "/".join(words[:20] + ["x"]), False) for _ in range(5)] + [(f"https://c.net/p{i}", False) for i in range(30)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)] + [(100, "https://d.net/w30/q"), (101, "https://d.net/w3")], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, int(b)) for i, (_, b) in enumerate(urls)], "doc_id long, quality int, toxic int")
    began = time.time()
    got = {r.page_id: (r.verdict, r.mined_rule) for r in url_filter.judge(pages, labels).collect()}
    assert time.time() - began < 90
    assert got[0] == ("block", "site:a.net") and got[100] == ("block", "path:w30") and got[101][0] == "allow" and got[12][0] == "allow"


def test_support_is_a_share_and_pages_a_parameter(spark):
    rows = spark.createDataFrame([(["a"], True)] * 2 + [(["b"], False)] * 6, "tokens array<string>, blocked boolean")
    assert [r.rule_id for r in url_filter.mine_rules(rows).collect()] == ["a"]
    assert url_filter.mine_rules(rows, min_pages=3).count() == 0 == url_filter.mine_rules(rows, min_support=0.3).count()
