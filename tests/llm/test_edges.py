"""Rows out of order, clashing columns, long texts, shuffled joins and divided blocks, against plain versions."""

import collections
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgrid.llm import chat_format, decontamination, jaccard_join, language_id, media, secret_scan, sentence_pieces, substring_dedup, token_files, url_filter, workspace
from loomgrid.llm import textbytes as tb

from . import brute
from .test_text_operators import SCHEMA, corpus, frame

#: Names that the operators use inside.
CLASHING = ["_key0", "_key1", "_key0_of", "k1", "k2", "print", "root", "anchors", "at", "term", "salt", "guess", "score", "host", "declared", "markup", "suffix", "n", "v", "first", "key", "__x", "__d", "n_bytes", "start", "leader", "near"]


def with_clashes(df):
    return df.select(*df.columns, *(F.lit(f"own {c}").alias(c) for c in CLASHING if c not in df.columns))


def odd_corpus():
    """Nulls, empty and very long texts, ties and repeated rows, out of order."""
    rng = random.Random(4)
    rows = [(d, t) for d, t in corpus(7, 30)]
    base = " ".join(f"w{rng.randrange(4000)}" for _ in range(30_000))
    rows += [(900, base), (200, base), (901, f"x {base}"), (902, None), (903, ""), (904, "one two")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    rows = odd_corpus()
    return rows, with_clashes(frame(spark, [*rows, (904, "one two"), (902, None)])).repartition(5).cache()


def by_id(df, n=None):
    out = collections.defaultdict(set)
    for r in df.collect():
        out[r[0]].add(tuple(r)[1:n])
    assert all(len(x) == 1 for x in out.values())  # repeated rows get equal results
    return {d: next(iter(x)) for d, x in out.items()}


def test_substring_dedup_of_odd_rows(odd):
    rows, docs = odd
    assert by_id(substring_dedup.report(docs)) == brute.substring_dedup(rows)


def test_jaccard_join_of_odd_rows(odd):
    rows, docs = odd
    assert by_id(jaccard_join.report(docs)) == brute.jaccard_components(rows)


def test_decontamination_of_odd_rows(spark, odd):
    rows, docs = odd
    items = [(1, " ".join(rows[0][1].split()[:12]) if rows[0][1] else "one two"), (2, "one two"), (3, next(t for d, t in rows if d == 200)[-300:])]
    bench = with_clashes(spark.createDataFrame(items, "item_id long, text string"))
    assert by_id(decontamination.report(docs, bench), 6) == brute.decontamination(rows, items)


def test_other_operators_take_odd_rows(spark, odd):
    rows, docs = odd
    texts = {d: t or "" for d, t in rows}
    assert {d: r[0] for d, r in by_id(media.store_and_read_back(docs)).items()} == {d: len(t.encode()) for d, t in texts.items()}
    assert set(by_id(secret_scan.scan_digests(docs))) == set(texts) == set(by_id(language_id.report(docs)))
    path = __import__("public_tokenizers").path
    plain = sorted(tuple(r) for r in token_files.store_and_read_back(frame(spark, rows), path("word_bpe_49k.json")).collect())
    assert {d: n for d, _, n, _ in plain} == {r.doc_id: r.n_tokens for r in token_files.store_and_read_back(docs, path("word_bpe_49k.json")).collect()}
    got = by_id(sentence_pieces.report(docs, path("piece_bpe_32k.model")), 4)
    assert {d for d, r in got.items() if not r[2]} == set() and got[903][0] == 0


def test_pages_and_turns_with_clashing_columns_and_long_texts(spark):
    long = "https://a.net/" + "/".join(f"p{i}" for i in range(2000)) + "?q=" + "x" * 200_000
    pages = spark.createDataFrame([(1, long), (2, None), (2, None), (3, "http://x.com/de/1")], "page_id long, url string")
    pages = pages.select("*", *(F.lit("own").alias(c) for c in ("host", "path", "tokens", "rule", "verdict", "mined_rule", "token", "best")))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = [(r.page_id, r.host, r.verdict) for r in url_filter.judge(pages, labels).collect()]
    assert sorted(got) == [(1, "a.net", "allow"), (2, "", "allow"), (2, "", "allow"), (3, "x.com", "block")]
    said = "a\\###\n" * 300_000
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", said), (1, 2, "assistant", None)], "conv_id long, turn long, role string, text string")
    turns = turns.select("*", *(F.lit("own").alias(c) for c in ("formatted", "fragment", "turns", "loss", "loss_starts")))
    row = chat_format.format_and_read_back(turns).collect()
    assert [(r.conv_id, r.n_turns, r.loss_chars, r.loss_sha256) for r in row] == [(1, 3, len(said), brute.sha(said))]


def test_mined_rules_tie_by_name(spark):
    rows = [(["a", "z"], True)] * 8 + [(["b", "z"], True)] * 8 + [(["z"], False)] * 40
    rules = url_filter.mine_rules(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"), 0.01, 0.6)
    pages = spark.createDataFrame([("u", ["a", "b"]), ("v", ["a", "b"])], "url string, tokens array<string>")
    assert {(r.url, r.mined_rule) for r in url_filter.match_rules(pages, rules).collect()} == {("u", "b"), ("v", "b")}  # of equal confidence the larger name


def test_operators_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    """In one task, in several files, forwards and backwards."""
    rows = corpus(11, 50)
    rows += [(1000 - d, t) for d, t in rows[:20]]
    want = brute.substring_dedup(rows), brute.jaccard_components(rows)
    items = [(i, t) for i, (_, t) in enumerate(rows[:6])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for part in (rows[::-2], rows[-2::-2]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/files")
    assert sorted(rows) != rows
    for docs in (frame(spark, rows[::-1]).coalesce(1), spark.read.parquet(f"{tmp_path}/files")):
        assert (by_id(substring_dedup.report(docs)), by_id(jaccard_join.report(docs))) == want
        assert by_id(decontamination.report(docs, bench)) == brute.decontamination(rows, items)


def test_anchors_are_combined_by_stretch(monkeypatch):
    """Whatever the stretches, just the anchors are found that occur at two places."""
    rng = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [" ".join(rng.choice("abc") + str(rng.randrange(60)) for _ in range(30)) + f" {passage}" * (i % 3) for i in range(40)]
    k1 = np.arange(40) + 7
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(40)), pa.array(texts), pa.array(k1), pa.array(k1.astype(np.int32))], names=["doc_id", "text", "k1", "k2"])
    places = collections.defaultdict(set)
    for d, text in enumerate(texts):
        w = text.split()
        for at in range(len(w) - substring_dedup.ANCHOR + 1):
            if at % substring_dedup.PERIOD in substring_dedup.COVER:
                places[tuple(w[at : at + substring_dedup.ANCHOR])].add((d, at))
    want = {(d, d + 7, at) for x in places.values() if len(x) > 1 for d, at in x}
    for stretch in (1, 900, 1 << 30):
        monkeypatch.setattr(substring_dedup, "COMBINE_BYTES", stretch)
        rows = pa.Table.from_batches(list(substring_dedup._anchors(b for i in range(0, 40, 5) for b in [batch.slice(i, 5)]))).sort_by("key").combine_chunks()
        assert rows.num_rows < sum(map(len, places.values())) + len(places)
        got = [tuple(r.values()) for b in substring_dedup._repeated(iter(rows.to_batches(max_chunksize=13))) for r in b.to_pylist()]
        assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize(("seed", "sets", "elements"), [(21, 2, 1 << 20), (22, 5, 1 << 20), (23, 1000, 60)])
def test_divided_blocks(spark, monkeypatch, seed, sets, elements):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", sets)
    monkeypatch.setattr(jaccard_join, "BLOCK_ELEMENTS", elements)
    rng = random.Random(seed)
    rows = corpus(seed, 60)
    for k in range(4):  # chains of near copies: their ends are no links of the leader
        words = [f"c{k}x{i}" for i in range(60)]
        for i in range(14):
            words[4 * i % 60] = f"edit{k}{i}"
            rows.append((500 + 20 * k + i, " ".join(words)))
    rng.shuffle(rows)
    want = brute.jaccard_components(rows)
    assert by_id(jaccard_join.report(frame(spark, rows))) == want


def test_block_links_with_known_components():
    rng = np.random.default_rng(5)
    base = np.sort(rng.choice(10_000, 40, replace=False)).astype(np.uint64)
    sets = [np.sort(np.r_[rng.choice(base, 36, replace=False), rng.choice(np.arange(10_000, 20_000), 4, replace=False).astype(np.uint64)]) for _ in range(30)]
    link = lambda a, b: 4 * len(np.intersect1d(a, b)) >= 3 * len(np.union1d(a, b))
    probing = np.arange(30) % 3 == 0
    known = np.where(probing, np.arange(30), 99)
    got = jaccard_join.block_links(sets, known, probing)
    parent = {i: (99 if k == 99 else i) for i, k in enumerate(known.tolist())} | {99: 99}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, j in itertools.combinations(range(30), 2):
        if (probing[i] or probing[j]) and link(sets[i], sets[j]):
            parent[top(i)] = top(j)
    assert all((got[i] == got[j]) == (top(i) == top(j)) for i in range(30) for j in range(30))


def near_items(rows, items, slop):
    """doc_id to the items with a window whose terms stand, as often, within its length + slop words."""
    out = {}
    for d, text in rows:
        w, found = brute.TERM.findall((text or "").translate(brute.UPPER)), set()
        for name, t in items:
            t = brute.TERM.findall((t or "").translate(brute.UPPER))
            for window in [t[i : i + 10] for i in range(max(1, len(t) - 9))] if t else []:
                need, length = collections.Counter(window), len(window) + slop
                if any(not need - collections.Counter(w[s : s + length]) for s in range(max(1, len(w) - length + 1))):
                    found.add(name)
        out[d] = found
    return out


@pytest.mark.parametrize("slop", [1, 3])
def test_matches_within_bounds_and_by_shuffles(spark, monkeypatch, slop):
    """A very frequent term, windows of one word, several rarest terms in a window; broadcast and salted joins agree with brute force."""
    rng = random.Random(slop)
    rare = [f"r{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice([*rare, "the", "the"]) for _ in range(rng.choice([1, 4, 10, 13])))) for i in range(10)] + [(77, "the"), (None, "the r1"), (78, None)]
    rows = []
    for d in range(70):
        words = ["the" if rng.random() < 0.5 else rng.choice(rare) for _ in range(rng.choice([0, 3, 25]))]
        t = (items[rng.randrange(10)][1]).split()
        for _ in range(rng.randint(0, slop + 1)):
            t.insert(rng.randrange(len(t) + 1), "zz")
        if rng.random() < 0.5:
            rng.shuffle(t)
        rows.append((d, " ".join([*words, *t, *words[:4]])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {d: {str(x) for x in v if x is not None} for d, v in near_items(rows, items, slop).items()}
    exact = brute.decontamination(rows, items)
    assert len(set(map(len, want.values()))) > 1
    for most in (workspace.BROADCAST_ROWS, 0):
        monkeypatch.setattr(workspace, "BROADCAST_ROWS", most)
        got = by_id(decontamination.report_near(frame(spark, rows), bench, slop))
        assert {d: r[:5] for d, r in got.items()} == exact
        assert {d: r[5:7] for d, r in got.items()} == {d: (len(v), brute.sha(",".join(sorted(v)))) for d, v in want.items()}


def test_shuffled_small_sides_of_other_operators(spark, monkeypatch):
    monkeypatch.setattr(workspace, "BROADCAST_ROWS", 0)
    rows = [(i, "the cat and the dog were there" if i % 2 else "le chat et le chien sont ici", "en" if i % 2 else "fr", f"h{i % 3}.fr", 0) for i in range(40)]
    docs = spark.createDataFrame([*rows, (90, None, None, None, 0)], SCHEMA)
    assert language_id.keep_known(docs).count() == 40
    pages = spark.createDataFrame([(i, f"http://spam.net/buy/{i}" if i % 2 else f"http://fine.net/read/{i}") for i in range(40)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    assert {(r.page_id % 2, r.verdict) for r in url_filter.judge(pages, labels).collect()} == {(0, "allow"), (1, "block")}


def test_archives_of_two_jobs(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/archives"
    for k in (1, 2):
        media.write_archives(media.payloads(frame(spark, [(k, f"text {k}"), (10 + k, "x" * 5000)])), path)
    assert sorted(r.key for r in media.read_archives(spark, path).collect()) == [1, 2, 11, 12]
    monkeypatch.setattr(media, "MOST_RANGES", 2)
    reader = media.ArchiveReader(path, {"rangeBytes": "10"})
    ranges = reader.partitions()
    assert len(ranges) <= 3 and sorted(k for p in ranges for b in reader.read(p) for k in b.column("key").to_pylist()) == [1, 2, 11, 12]
    media.write_archives(media.payloads(frame(spark, [(5, "new")])), path, "overwrite")
    assert [r.key for r in media.read_archives(spark, path).collect()] == [5]


def test_language_posterior_against_brute_force(spark):
    rng = random.Random(3)
    words = {"en": "the and with were there cat dog house".split(), "fr": "le et avec sont ici chat chien maison".split()}
    rows = []
    for i in range(120):
        lang = rng.choice(["en", "fr"])
        code = rng.choice([None, lang, lang, "en", "fr", "xx"])
        text = " ".join(rng.choice(words[lang] if rng.random() < 0.8 else words["en"]) for _ in range(rng.choice([1, 2, 12])))
        rows.append((i, (f'<html lang="{code}">' if code else "") + text, lang if rng.random() < 0.7 else None, rng.choice(["a.example.fr", "b.example.fr", "c.org", "plain", ""]), 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    langs, logp = language_id.fit(docs.select("doc_id", "text", "lang"))
    names, n = [*langs, "und"], len(langs) + 1
    scores, guess = {}, {}
    for d, text, *_ in rows:
        raw = np.frombuffer(text.encode(), np.uint8)
        bucket, _ = language_id.trigrams(raw, np.array([0, len(raw)]))
        scores[d] = [float(logp[k][bucket].astype(np.float32).sum()) for k in range(n - 1)] + [-np.log(language_id.BUCKETS) * len(bucket)]
        guess[d] = int(np.argmax(scores[d])) if len(bucket) else n - 1
    host = {d: s for d, _, _, s, _ in rows}
    suffix = {d: s.rsplit(".", 1)[1] if "." in s else "" for d, s in host.items()}
    code = {d: t[12:14] if t.startswith("<html") else None for d, t, *_ in rows}
    got = {r.doc_id: r for r in language_id.decide(docs, langs, logp).collect()}
    codes = {c for c in code.values() if c}
    for d, *_ in rows:
        others = [x for x in guess if x != d]
        count = lambda fits: np.array([sum(guess[x] == k for x in others if fits(x)) for k in range(n)], float)  # noqa: E731, B023
        share = lambda c, up, w: (c + w * up) / (c.sum() + w)
        even = np.r_[np.full(n - 1, (1 - language_id.UNKNOWN_PRIOR) / (n - 1)), language_id.UNKNOWN_PRIOR]
        corpus_ = share(count(lambda x: True), even, language_id.SUFFIX_WEIGHT)
        own_suffix = share(count(lambda x: suffix[x] == suffix[d]), corpus_, language_id.SUFFIX_WEIGHT)  # noqa: B023
        prior = share(count(lambda x: (suffix[x], host[x]) == (suffix[d], host[d])), own_suffix, language_id.HOST_WEIGHT)  # noqa: B023
        given = np.ones(n)
        if code[d]:
            own = np.array([0.9 if code[d] == x else 0.1 / len(codes) for x in names])
            given = (count(lambda x: code[x] == code[d]) + language_id.DECLARED_WEIGHT * own) / (count(lambda x: code[x]) + language_id.DECLARED_WEIGHT)  # noqa: B023
        post = np.array(scores[d]) * language_id.TEMPER + np.log(prior) + np.log(given)
        post = np.exp(post - post.max())
        best = int(post.argmax())
        assert got[d].lang == names[best] and got[d].confidence == pytest.approx(post[best] / post.sum(), abs=2e-5)
        assert got[d].host_lang == names[int(prior.argmax())] and got[d].text_lang == names[guess[d]] and got[d].declared == code[d]


def test_trigrams_in_blocks():
    texts = [b"", b"abc", b"ab", b"hello there", b"", b"x" * 40, b"", b"yz"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    whole = sorted(zip(*(x.tolist() for x in language_id.trigrams(data, offsets)), strict=True))
    for step in (1, 2, 3, 7, 1000):
        assert sorted(pair for block in language_id.trigram_blocks(data, offsets, step) for pair in zip(*(x.tolist() for x in block), strict=True)) == whole
    assert not list(language_id.trigram_blocks(data[:2], np.array([0, 2])))


def test_language_ties_go_to_the_first(spark):
    docs = spark.createDataFrame([(1, "abc abc", "xx", "h", 0), (2, "abc abc", "aa", "h", 0), (3, "abc abc", None, "g", 0)], SCHEMA)
    assert {r.lang for r in language_id.report(docs).collect()} == {"aa"}


def total_weight(words, text):
    """log of the summed weights of all segmentations of a text, and the weight of its ids, by plain dynamic programming."""
    chars = text.replace(" ", sentence_pieces.SPACE_MARK)
    back = np.full(len(chars) + 1, -np.inf)
    back[-1] = 0
    for at in range(len(chars) - 1, -1, -1):
        for size in range(1, min(words.longest, len(chars) - at) + 1):
            piece = words.model.piece_to_id(chars[at : at + size])
            known = piece != words.model.unk_id() and words.bytes_of[piece] and not words.model.is_byte(piece)
            if known or size == 1:
                weight = words.weight[piece] if known else len(chars[at].encode()) * words.weight[words.byte_id[0]]
                back[at] = np.logaddexp(back[at], weight + back[at + size])
    return back[0]


def test_log_probabilities_of_whole_texts():
    """Of every sample of whole texts, by its own pieces and a sum over all segmentations, chunk by chunk as texts are cut."""
    words = sentence_pieces.vocabulary(__import__("public_tokenizers").path("piece_bpe_32k.model"))
    texts = ["Hello world, naïve café!", "日本 x \U0001f600\U0001f600 end", "a  b   c", "The quick brown fox " * 6]
    chunks = [sentence_pieces.chunks_of_text(t.encode()) for t in texts]
    table = sentence_pieces.Lattices(words)
    table.texts(chunks)
    paths, threshold = sentence_pieces.sample_paths(table, chunks, tb.mix(np.arange(4).astype(np.uint64)), 3)
    for path in paths:
        ids, off = table.ids(path.edge, path.texts(), 4)
        data, at = words.decode(ids, off)
        for i, t in enumerate(texts):
            own = ids[off[i] : off[i + 1]]
            assert data[at[i] : at[i + 1]].tobytes().decode() == t
            want = words.weight[own].sum() - sum(total_weight(words, c.decode()) for c in chunks[i])
            assert path.logp[i] == pytest.approx(want, abs=1e-6)
    assert all((np.diff([p.score[i] for p in paths]) < 0).all() and paths[-1].score[i] >= threshold[i] for i in range(4))


def test_all_segmentations_come_once():
    words = sentence_pieces.vocabulary(__import__("public_tokenizers").path("piece_bpe_32k.model"))
    chunks = [sentence_pieces.chunks_of_text(b"hello ab")]
    from .test_sentence_pieces import segmentations

    every = {a + b for a, _ in segmentations(words, chunks[0][0]) for b, _ in segmentations(words, chunks[0][1])}
    table = sentence_pieces.Lattices(words)
    table.texts(chunks)
    paths, threshold = sentence_pieces.sample_paths(table, chunks, np.array([5], np.uint64), len(every) + 2)
    got = [tuple(table.ids(p.edge, p.texts(), 1)[0].tolist()) for p in paths if np.isfinite(p.score[0])]
    assert len(got) == len(set(got)) == len(every) and set(got) == every and threshold[0] == -np.inf


def test_tokens_that_look_special():
    encoder = token_files.WordEncoder(__import__("public_tokenizers").path("word_bpe_49k.json"))
    chunks = [x.encode() for x in ("<|endoftext|>", "<|ENDOFTEXT|>", "a<|endoftext|>b", "--Word--", "É!", "İx", "don't", "x<y", "ŉ")]
    assert encoder(chunks) == [encoder.tokenizer.encode(c.decode(), add_special_tokens=False).ids for c in chunks]


def test_starts_of_files(spark):
    rows = [(p, s, f"f{p}{s}", 1, n) for p, s, n in [(0, 0, 5), (0, 1, 7), (2, 0, 1), (2, 1, 2), (2, 2, 4), (5, 0, 9)]]
    manifest = spark.createDataFrame(rows[::-1], "part long, seq long, path string, n_docs long, n_ids long")
    got = [r.start for r in token_files.with_starts(spark, manifest).orderBy("part", "seq").collect()]
    assert got == [0, 5, 12, 13, 15, 19]


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, *a):
            return None

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

            @staticmethod
            def getConf():  # noqa: N802
                return Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        workspace.shared_root(Session())


def test_pipeline_stages_on_odd_rows(spark, tmp_path, odd):
    """Each stage keeps the documents' columns, takes nulls, repeated rows and clashing columns, and an empty table."""
    import corpus_pipeline

    rows, docs = odd
    rows = [(d, t) for d, t in rows]
    spark.createDataFrame([(1, "one two")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = docs.withColumn("text", F.when(F.col("doc_id") == 200, F.concat("text", F.lit(" token=abcdefgh"))).otherwise(F.col("text")))
    source = docs.withColumn("k", F.lit(1))
    empty = source.where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, source, str(tmp_path))
        assert stage(spark, empty, str(tmp_path)).count() == 0
        if name != "sentence_pieces":
            assert out.columns == source.columns and {r["__x"] for r in out.select("__x").collect()} == {"own __x"}
        found = {r.doc_id: r for r in out.collect()}
        if name == "language_id":
            assert 902 not in found and 903 not in found and 900 in found
        if name == "near_duplicates":
            want = brute.jaccard_components([(d, t + " token=abcdefgh" if d == 200 else t) for d, t in rows])
            assert set(found) == {c for _, c in want.values()} and out.where("doc_id = 904").count() == 1
        if name == "decontamination":
            assert set(found) == {d for d, _ in rows} - {904}
        if name == "secret_scan":
            assert found[200].text.endswith(" [secret:assign]") and found[902].text is None and len(found) == len(rows)
        if name == "sentence_pieces":
            assert found[902].n_ids == 0 and found[900].round_trip
