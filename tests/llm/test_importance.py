import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgrid.llm import crc, importance, workspace
from loomgrid.llm import textbytes as tb

_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(0x41, 0x5B)})


def words_of(text):
    return _WORDS.findall((text or "").translate(_LOWER))


def features_of(text, n, buckets):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(rows, target, n=1, buckets=10_000, percent=10, least=20, seed=2024):
    """(doc_id, n_features, weight, score, rank) of every row."""
    found = [features_of(t, n, buckets) for _, t in rows]
    s, t = collections.Counter(x for f in found for x in f), collections.Counter(x for _, text in target for x in features_of(text, n, buckets))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in s}
    out = []
    for (d, text), f in zip(rows, found, strict=True):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    eligible = sorted((i for i, (_, text) in enumerate(rows) if len(words_of(text)) >= least), key=lambda i: (-out[i][3], -math.inf if out[i][0] is None else out[i][0]))
    for rank, i in enumerate(eligible[: percent * len(eligible) // 100], 1):
        out[i][4] = rank
    return sorted(map(tuple, out), key=repr)


def test_crc_of_words_and_of_strings_put_together():
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcé😀xyz0189", k=rng.choice([0, 1, 2, 5, 9, 63, 64, 65, 200, 3000]))) for _ in range(300)]
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    got = crc.words(data, off[:-1], off[1:])
    assert got.tolist() == [zlib.crc32(x) for x in raw]
    both = crc.combine(got, got[::-1], np.array([len(x) for x in raw[::-1]]))
    assert both.tolist() == [zlib.crc32(a + b) for a, b in zip(raw, raw[::-1], strict=True)]
    assert crc.words(data, off[:0], off[:0]).tolist() == [] == crc.combine(got[:0], got[:0], off[:0]).tolist()


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_ngrams(n):
    texts = ["one two three four five six", "", None, "a", "x é", "😀 " * 9, "w" * 300 + " b c"]
    data, offsets = tb.column_bytes(pa.array(texts))
    starts, ends, first = tb.word_bounds(data, offsets, importance._BETWEEN)
    got = collections.Counter((int(r), int(x)) for _, row, found in crc.ngrams(crc.words(data, starts, ends), ends - starts, first, n) for r, x in zip(row, found, strict=True))
    assert got == collections.Counter((r, x) for r, t in enumerate(texts) for x in features_of(t, n, 1 << 32))


def odd_rows():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)] + ["Äpfel", "DON'T", "x-ray", "😀", "a" * 90]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(60)))) for i in range(400)]
    rows += [(500, None), (501, ""), (502, "?!"), (None, "one two " * 15), (None, None), (503, "word " * 30_000), (504, "Z" * 70_000)]
    rows += [(7, rows[7][1]), (7, "again " * 25), *((600 + i, "same words in all of these rows " * 4) for i in range(80))]
    return rows, [(1, " ".join(vocabulary[:90])), (2, None), (3, "same words one two again")]


@pytest.fixture(scope="module")
def tables(spark):
    rows, target = odd_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit("own").alias(c) for c in ("score", "rank", "part", "nth", "k1", "weight"))).repartition(6).cache()
    return docs, spark.createDataFrame(target, "item_id long, text string")


@pytest.mark.parametrize("n,buckets,percent,least", [(1, 10_000, 10, 20), (2, 977, 35, 1), (3, 64, 100, 0), (1, 10, 0, 20)])
def test_against_brute_force(tables, n, buckets, percent, least):
    docs, target = tables
    rows, items = odd_rows()
    got = importance.ranked(importance.scored(docs, target, n, buckets), percent, least).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, items, n, buckets, percent, least)


def test_shuffled_join_and_empty_tables(spark, tables, monkeypatch):
    docs, target = tables
    rows, items = odd_rows()
    monkeypatch.setattr(workspace, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, importance.report(docs, target).collect()), key=repr) == brute(rows, items)
    none = docs.where("doc_id < 0")
    assert importance.report(none, target).count() == 0
    assert sorted(map(tuple, importance.report(docs, target.where("item_id < 0")).collect()), key=repr) == brute(rows, [])


def test_resampled_documents(tables):
    docs, target = tables
    rows, items = odd_rows()
    drawn = importance.resampled(docs, target, percent=30)
    assert drawn.columns == docs.columns
    want = {(d, t) for (d, t) in rows if any(x[0] == d and x[4] for x in brute(rows, items, percent=30) if x[1] == len(words_of(t)))}
    assert {(r.doc_id, r.text) for r in drawn.collect()} == want


def test_drawn_documents_are_nearer_to_the_target(spark):
    docs, target = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    means = {bool(r.drawn): r.w for r in importance.report(docs, target).where("n_features >= 20").groupBy(F.col("rank").isNotNull().alias("drawn")).agg(F.avg("weight").alias("w")).collect()}
    assert means[True] > means[False]
