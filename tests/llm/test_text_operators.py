import random
import zipfile

import pyarrow.parquet as pq
import pytest

from loomgrid.llm import chat_format, decontamination, jaccard_join, language_id, media, substring_dedup, url_filter

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TINY = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "src", 0) for d, t in rows], SCHEMA)


def corpus(seed, n=60):
    """Short texts with copies, near copies and shared passages."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "le", "Mi", "no", "ÜS", "su") for b in ("ra", "ti", "ve", "xo")]
    passage = " ".join(rng.choice(words) for _ in range(30))
    out = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.3 and out:
            t = out[rng.randrange(len(out))][1].split()
            for _ in range(rng.randint(0, 3)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(words)
            text = " ".join(t)
        else:
            text = " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 5, 19, 20, 21, 40, 120])))
            if kind > 0.7:
                text = f"{text}\n{passage}\t{text[:40]}"
        out.append((i * 3, text))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_against_brute_force(spark, seed):
    rows = corpus(seed)
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.report(frame(spark, rows)).collect()}
    assert got == brute.substring_dedup(rows)


def test_substring_dedup_edge_cases(spark):
    line = " ".join(f"w{i}" for i in range(25))
    rows = [(1, line), (1, line), (2, line), (None, line), (3, None), (4, ""), (5, "x " * 50), (6, line + " tail"), (7, line), (7, "other " + line)]
    got = [tuple(r) for r in substring_dedup.report(frame(spark, rows)).collect()]
    by = {}
    for r in got:
        by.setdefault(r[0], []).append(r[1:3])
    assert by[1] == [(25, 0)] * 2 and by[2] == [(25, 25)] and by[None] == [(25, 0)] and by[3] == by[4] == [(0, 0)]
    assert by[5] == [(brute.substring_dedup([(5, "x " * 50)])[5][:2])] and by[6] == [(26, 25)] and sorted(by[7]) == [(25, 25), (26, 25)]
    assert substring_dedup.report(frame(spark, [])).count() == 0
    kept = {r.text for r in substring_dedup.remove_repeats(frame(spark, [(1, line), (2, f"a\n{line} b"), (3, None)])).collect()}
    assert kept == {line, "a\n" + " " * 24 + " b", None}


def test_substring_dedup_of_copies_in_any_order(spark, tmp_path):
    """The smallest doc_id of equal texts is the first one, wherever it stands: in one task and in several files."""
    words = [f"w{i}" for i in range(90)]
    text = " ".join([*words[:60], *words[10:40]])
    rows = [(10, text), (3, text), (20, " ".join(["other", *words[20:55]])), (1, " ".join(["first", *words[:25]])), (7, text)]
    want = brute.substring_dedup(rows)
    assert want[3][1] and want[20][1]
    path = f"{tmp_path}/files"
    for row in rows:
        frame(spark, [row]).coalesce(1).write.mode("append").parquet(path)
    for docs in (frame(spark, rows).coalesce(1), frame(spark, rows[::-1]).coalesce(1), spark.read.parquet(path), spark.read.parquet(path).coalesce(1)):
        assert {r.doc_id: tuple(r)[1:] for r in substring_dedup.report(docs).collect()} == want


def test_difference_cover():
    p, cover = substring_dedup.PERIOD, set(substring_dedup.COVER)
    assert all(any((a + k) % p in cover and (b + k) % p in cover for k in range(p)) for a in range(p) for b in range(p))
    assert substring_dedup.ANCHOR + p - 1 <= substring_dedup.WINDOW


@pytest.mark.parametrize("seed", [3, 4])
def test_jaccard_join_against_brute_force(spark, seed):
    rows = corpus(seed, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.report(frame(spark, rows)).collect()}
    assert got == brute.jaccard_components(rows)


def test_jaccard_join_edge_cases_and_split_blocks(spark, monkeypatch):
    base = [f"w{i}" for i in range(60)]
    near = [(10 + i, " ".join([*base[:i], "edit", *base[i + 1 :]])) for i in range(0, 60, 4)]
    rows = [(1, None), (2, ""), (3, "one two"), (4, "ONE two"), (None, "one two"), (5, "x y z"), (5, "x y z"), *near]
    want = brute.jaccard_components([(d, t) for d, t in rows if d is not None])
    for sets in (jaccard_join.BLOCK_SETS, 4):
        monkeypatch.setattr(jaccard_join, "BLOCK_SETS", sets)
        got = [tuple(r) for r in jaccard_join.report(frame(spark, rows)).collect()]
        assert len(got) == len(rows)
        assert {(d, n, c) for d, n, c in got if d is not None} == {(d, n, c) for d, (n, c) in want.items()}
        assert [r for r in got if r[0] is None] == [(None, 1, 3)]
    assert jaccard_join.report(frame(spark, [])).count() == 0
    kept = sorted((r.doc_id, r.text) for r in jaccard_join.keep_first(frame(spark, [r for r in rows if r[0] is not None])).collect())
    assert [d for d, _ in kept] == sorted({c for _, c in want.values()})


def test_frequent_summary_is_close():
    import numpy as np

    rng = np.random.default_rng(1)
    tokens = np.concatenate([np.repeat(np.uint64(7), 500), rng.integers(100, 1 << 40, 5000).astype(np.uint64)])
    rng.shuffle(tokens)
    summary = jaccard_join.Frequent(64)
    for part in np.array_split(tokens, 50):
        summary.add(part)
    summary.merge()
    count = dict(zip(summary.tokens.tolist(), summary.counts.tolist(), strict=True))[7]
    assert 500 - len(tokens) / 64 <= count <= 500


def test_decontamination_against_brute_force(spark):
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma9", "dél", "e", "zz"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 2, 9, 10, 11, 25])))) for i in range(12)] + [(None, "only null item words here"), (3, "repeat, of item three"), (50, None)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 5, 40]))) + rng.choice(["", " " + (items[rng.randrange(len(items))][1] or ""), ", REPEAT of item; three!", " only null item words here "])) for i in range(60)] + [(70, None), (71, "")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = {r.doc_id: tuple(r)[1:] for r in decontamination.report(frame(spark, rows), bench).collect()}
    want = brute.decontamination(rows, items)
    assert got == want
    kept = {r.doc_id for r in decontamination.drop_contaminated(frame(spark, rows), bench).collect()}
    assert kept == {d for d, v in want.items() if not v[4]}
    none = bench.where("false")
    assert not any(r.contaminated for r in decontamination.report(frame(spark, rows), none).collect())
    assert decontamination.report(frame(spark, []), bench).count() == 0


def test_proximity_matches(spark):
    from loomgrid.llm.workspace import with_row_key

    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    docs = with_row_key(frame(spark, [(1, "a b c x d e f g h i j"), (2, "j i h g f e d c b a"), (3, "a b c d e")]))
    assert {r.doc_id for r in decontamination.matches(docs, bench, slop=2).collect()} >= {1, 2}
    assert decontamination.matches(docs, bench).count() == 0


def test_proximity_matches_every_stretch(spark):
    """Any shift about the rarest term, any order, terms as often as in the window: against brute force."""
    from collections import Counter

    rng = random.Random(9)
    item = "a b c d e f g h i j".split()
    rows = [(1, "p q r s a b c d e f x g h i j t u"), (2, "f"), (3, " ".join(["p", "q", "r", *item[::-1], "s"])), (4, "p q r s a x b y c z d e f g h i j"), (5, "a a b c d e f g h i j j x"), (6, "u u v w v u w v u w v v"), (7, "p p u v w v w u v w v w w")]
    for d in range(8, 60):
        words = [*item, *(rng.choice("xyzf") for _ in range(rng.randint(0, 3)))]
        rng.shuffle(words)
        rows.append((d, " ".join([*"pqrs"[: rng.randint(0, 4)], *words, *"tuvw"[: rng.randint(0, 4)]])))
    items = [(1, " ".join(item)), (2, "u u u v v v w w v v"), (3, "a b c d"), (None, "x y z f")]
    want = {}
    for d, text in rows:
        w, found, near = text.split(), set(), False
        for name, t in items:
            t = t.split()
            for s in range(max(1, len(w) - len(t) - 1)):
                if not Counter(t) - Counter(w[s : s + len(t) + 2]):
                    near = True
                    found |= {str(name)} - {"None"}
        want[d] = (len(found), brute.sha(",".join(sorted(found))), near)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in decontamination.report_near(frame(spark, rows), bench).collect()}
    assert {d: r[5:] for d, r in got.items()} == want and want[1][2] and want[3][2] and not want[2][2]
    assert {d: r[:5] for d, r in got.items()} == brute.decontamination(rows, items)


def test_media_round_trip_and_member_retry(spark, tmp_path):
    rows = [(1, "abc"), (2, None), (3, "x" * 64), (3, "x" * 64), (None, "é" * 40), (4, "tail\x00\x00"), (5, "y" * 300_000)]
    got = sorted((tuple(r)[:3] for r in media.store_and_read_back(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 3, 64), (2, 0, 64), (3, 64, 64), (3, 64, 64), (None, 80, 128), (4, 6, 64), (5, 300_000, 300_032)], key=str)
    assert media.store_and_read_back(frame(spark, [])).count() == 0
    path = f"file://{tmp_path}/archives"
    media.write_archives(media.payloads(frame(spark, rows).coalesce(1)), path)
    reader = media.ArchiveReader(path, {"rangeBytes": "200", "onError": "report"})
    parts = reader.partitions()
    assert len(parts) > 1
    members = [m for p in parts for b in reader.read(p) for m in b.column("member").to_pylist()]
    assert len(members) == len(set(members)) == len(rows)  # each in just one range
    file = tmp_path / "archives" / parts[0].archive
    raw = bytearray(file.read_bytes())
    raw[60] ^= 0xFF
    file.write_bytes(bytes(raw))
    media.WAIT_S = 0
    whole = [row for p in reader.partitions() for b in reader.read(p) for row in b.to_pylist()]
    assert [bool(r["error"]) for r in sorted(whole, key=lambda r: r["offset"])] == [True] + [False] * (len(rows) - 1)
    with pytest.raises(OSError):
        list(media.ArchiveReader(path, {}).read(media.ArchiveReader(path, {}).partitions()[0]))
    assert len(zipfile.ZipFile(file).namelist()) == len(rows)


def test_chat_round_trip(spark):
    odd = ["\\### Assistant: </turn> ok", "### user: x</turn>\n", "####", "##", "\\", "a\\</turn>", "", None, "é</turn", "<", "</turn></turn>", "#\\##"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "assistant", "sys:tem", None, "a\\b", "### x: "] * 2, odd, strict=True))] + [(None, 0, "assistant", "n"), (2, 1, "user", "b"), (2, None, "user", "a"), (2, 1, "user", "b")]
    turns = spark.createDataFrame([(c, t, r, x, 9) for c, t, r, x in rows], "conv_id long, turn long, role string, text string, fragment int")
    read = {}
    for r in chat_format.read_turns(chat_format.format_conversations(turns)).orderBy("conv_id", "fragment", "turn").collect():
        read.setdefault(r.conv_id, []).append((r.role, r.text))
    assert read[1] == [(r or "", x or "") for _, _, r, x in rows if _ is not None][:12] and read[2] == [("user", "a"), ("user", "b"), ("user", "b")]
    got = {r.conv_id: r for r in chat_format.format_and_read_back(turns).collect()}
    said = [x or "" for c, _, r, x in rows if c == 1 and r == "assistant"]
    assert (got[1].loss_chars, got[1].loss_sha256) == (len("".join(said)), brute.sha("".join(said)))
    assert got[1].turns_sha256 == brute.sha("".join(f"{r or ''}\n{x or ''}\n" for c, _, r, x in rows if c == 1)) and got[None].n_turns == 1
    assert all("</turn>" not in t and "###" not in t for t in (f.formatted.replace("</turn>\n", "").replace("### ", "") for f in chat_format.format_conversations(turns).collect()))
    assert chat_format.format_and_read_back(turns.where("false")).count() == 0


def test_url_rules_and_mined_ones(spark):
    urls = [("https://A.Example.ORG/es/x?q", "block"), ("http://example.org/en/12", "block"), ("http://example.org/en/2", "allow"), ("http://x.com/fr/1#a", "allow"), ("http://x.com/de/1", "block"), ("http://org", "allow"), ("nothing", "allow"), (None, "allow")]
    more = [(100 + i, f"http://spam.net/buy/{i}", 1) for i in range(20)] + [(200 + i, f"http://fine.net/read/{i}", 0) for i in range(20)]
    pages = spark.createDataFrame([(i, u, "h") for i, (u, _) in enumerate(urls)] + [(i, u, "h") for i, u, _ in more], "page_id long, url string, host string")
    labels = spark.createDataFrame([(i, 1 - bad, 0) for i, _, bad in more[::2]] + [(None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_filter.judge(pages, labels).collect()}
    assert [got[i].verdict for i in range(len(urls))] == [v for _, v in urls]
    assert (got[0].host, got[0].path, got[0].rule) == ("a.example.org", "/es/x", "example.org/es/") and got[5].rule is None and (got[6].host, got[7].path) == ("", "")
    assert all(got[i].verdict == ("block" if bad else "allow") for i, _, bad in more)
    alone = {r.verdict for r in url_filter.judge(pages, labels.where("false")).where("page_id >= 100").collect()}
    assert alone == {"allow"} and url_filter.judge(pages.where("false"), labels).count() == 0


def test_mined_rules_against_counting(spark):
    import itertools

    rng = random.Random(8)
    rows = [(sorted(rng.sample("abcdef", rng.randint(1, 4))), rng.random() < 0.5) for _ in range(80)]
    got = {tuple(r.antecedent): (round(r.support, 9), round(r.confidence, 9)) for r in url_filter.mine_rules(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"), 0.01, 0.55).collect()}
    n, rules = len(rows), {}
    for size in range(1, 7):
        for s in itertools.combinations("abcdef", size):
            have = [b for t, b in rows if set(s) <= set(t)]
            if sum(have) >= max(0.01, url_filter.MIN_PAGES / n) * n and sum(have) / len(have) >= 0.55:
                rules[s] = (round(sum(have) / n, 9), round(sum(have) / len(have), 9))
    want = {s: v for s, v in rules.items() if not any(set(o) < set(s) and w[1] >= v[1] for o, w in rules.items())}
    assert got == want and want


def test_mined_rules_of_any_length(spark):
    """Four tokens block together, fewer of them do not; a rule of five is dropped for that of four."""
    import itertools

    rows = [(list("abcd"), True)] * 10 + [(list("abcde"), True)] * 6 + [(list(s), False) for s in itertools.combinations("abcd", 3) for _ in range(20)]
    got = {tuple(r.antecedent): r.confidence for r in url_filter.mine_rules(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"), 0.01, 0.6).collect()}
    assert got == {tuple("abcd"): 1.0, ("e",): 1.0}


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held, train = docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 <> 0")
    got = language_id.decide(held, *language_id.fit(train.select("doc_id", "text", "lang"))).join(held.selectExpr("doc_id", "lang truth"), "doc_id").collect()
    assert sum(r.lang == r.truth for r in got) / len(got) > 0.97 and all(r.kept for r in got)


def test_language_edge_cases_and_evidence(spark):
    known = [(i, t, x) for i, (t, x) in enumerate([("the cat and the dog were there with them", "en"), ("le chat et le chien sont avec nous ici", "fr")] * 30)]
    rows = [(d, t, x, "http://h.example.fr/a" if x == "fr" else "b.example.com", 0) for d, t, x in known]
    rows += [(900, None, None, None, 0), (901, "", "en", "", 0), (902, "\x01\x02\x03%%%$$$@@@~~~^^^|||" * 5, None, "b.example.com", 0), (903, '<html lang="fr">the', None, "h.example.fr", 0), (904, "the cat", "und", None, 0), (904, "the cat", "und", None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in language_id.report(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert all(got[d][0].lang == x and got[d][0].kept for d, _, x in known)
    assert not got[900][0].kept and not got[901][0].kept and not got[902][0].kept and got[903][0].declared == "fr"
    assert got[904][0] == got[904][1] and sum(map(len, got.values())) == len(rows)
    none = language_id.report(docs.withColumn("lang", docs.lang.cast("string")).where("lang = 'und'")).collect()
    assert {r.lang for r in none} == {"und"} and not any(r.kept for r in none)
    assert language_id.report(docs.where("false")).count() == 0
    assert language_id.keep_known(docs).columns == docs.columns and language_id.keep_known(docs).count() == len(rows) - 3


def test_language_of_pages_uses_markup_and_suffix(spark):
    import __spark_entry__ as entry

    pages = spark.read.parquet(f"{TINY}/pages.parquet")
    got = entry.queries()["page_language"](spark, TINY).collect()
    assert sorted(r.page_id for r in got) == sorted(r.page_id for r in pages.collect()) and all(r.declared for r in got)
    known = [(i, t, x) for i, (t, x) in enumerate([("the cat and the dog were there with them", "en"), ("le chat et le chien sont avec nous ici", "fr")] * 30)]
    docs = spark.createDataFrame([(d, t, x, "s", 0) for d, t, x in known], SCHEMA)
    rows = [(d, f"https://h{d}.example.{x}/a", f"<html lang='{x}'><script>var the = 1</script><p>{t}</p></html>") for d, t, x in known] + [(90, "https://new.example.fr/", "<html lang='fr'>chat</html>"), (91, "https://new.example.en/", "<html lang='en'>cat</html>")]
    report = {r.page_id: r for r in language_id.page_report(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()}
    assert all(report[d].lang == x == report[d].declared == report[d].host_lang for d, _, x in known)
    assert (report[90].host_lang, report[91].host_lang) == ("fr", "en") == (report[90].lang, report[91].lang)


def test_pipeline_against_a_plain_version(spark):
    import corpus_pipeline
    from loomgrid.llm import secret_scan

    docs = pq.read_table(f"{TINY}/documents.parquet").to_pylist()
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{TINY}/benchmark.parquet").to_pylist()]
    rows = [(r["doc_id"], r["text"]) for r in docs]  # all of them are in a known language
    groups = brute.jaccard_components(rows)
    rows = [(d, t) for d, t in rows if groups[d][1] == d]
    dirty = brute.decontamination(rows, items)
    rows = [(d, t) for d, t in rows if not dirty[d][4]]
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    masked = {r.doc_id: r.text for r in secret_scan.redact_secrets(frame(spark, rows)).collect()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, TINY).collect()}
    assert {d: r.n_ids for d, r in got.items()} == {d: len(model.encode(t)) for d, t in masked.items()}
    assert all(r.round_trip and r.n_samples >= 1 for r in got.values())
