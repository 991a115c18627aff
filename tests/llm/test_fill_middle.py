import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrid.llm import fill_middle
from loomgrid.llm import textbytes as tb

from .brute import sha

UNITS = {"lines": r"[^\n]*\n|[^\n]+", "words": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+", "chars": r"(?s)."}


def units_of(text, units):
    if units == "words":  # a unit begins where a word does, and at the beginning
        at = [0] + [m.start() for m in re.finditer(r"(?<=[\x20\x09-\x0D])[^\x20\x09-\x0D]", text)] + [len(text)]
        return [text[a:b] for a, b in zip(at[:-1], at[1:], strict=True) if a < b]
    return re.findall(UNITS[units], text)


def brute(doc_id, text, units="lines", marks=("<P>", "<S>", "<M>"), seed=7, rate=100, spm_rate=50):
    text = text or ""
    parts = units_of(text, units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(parts) + 1), h[1] % (len(parts) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (parts[:a], parts[a:b], parts[b:]))
    p, s, m = marks
    if not text or any(x in text for x in marks) or h[2] % 100 >= rate:
        return doc_id, len(parts), "plain", None, None, text
    form = "spm" if h[3] % 100 < spm_rate else "psm"
    return doc_id, len(parts), form, len(prefix), len(middle), f"{s}{suffix}{p}{prefix}{m}{middle}" if form == "spm" else f"{p}{prefix}{s}{suffix}{m}{middle}"


def texts():
    rng = random.Random(8)
    out = ["".join(rng.choices("ab\n\n é 😀<S", k=rng.randrange(60))) for _ in range(250)]
    out += [None, "", "\n", "\n\n\n", "no end", "a\r\nb\r\n", "has <M> in it\nx\n", "x<\n<P\nS>\n>", "line\n" * 20_000, "x" * 50_000, "é" * 9000 + "\n" + "z" * 3]
    return out


def odd_rows():
    rows = list(enumerate(texts()))
    return rows + [(3, rows[3][1]), (3, "other\ntext\n"), (None, "a\nb\nc\n"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    made = spark.createDataFrame(odd_rows(), "doc_id long, text string")
    return made.select("*", *(F.lit("own").alias(c) for c in ("n", "form", "output", "h1", "digest"))).repartition(5).cache()


@pytest.mark.parametrize("units,chunk", [("lines", 4096), ("lines", 3), ("words", 5), ("chars", 7)])
def test_against_brute_force(docs, units, chunk):
    got = fill_middle.rearranged(docs, units, chunk=chunk)
    want = sorted((brute(d, t, units) for d, t in odd_rows()), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    back = got.select("doc_id", fill_middle.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert sorted(((r.doc_id, r.t) for r in back), key=repr) == sorted(((d, t or "") for d, t in odd_rows()), key=repr)


def test_rates_and_marks(docs):
    marks = ("[pre]", "{suf}", "<|mid|>")
    for rate, spm_rate in ((0, 50), (40, 100), (100, 0)):
        got = fill_middle.rearranged(docs, marks=marks, seed=11, rate=rate, spm_rate=spm_rate)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted((brute(d, t, "lines", marks, 11, rate, spm_rate) for d, t in odd_rows()), key=repr)
        back = got.select("doc_id", fill_middle.restored(F.col("output"), F.col("form"), marks).alias("t")).collect()
        assert sorted(((r.doc_id, r.t) for r in back), key=repr) == sorted(((d, t or "") for d, t in odd_rows()), key=repr)
    for bad in (("<P>", "<P>", "<M>"), ("", "a", "b"), ("<<P>", "<S>", "<M>"), ("ab", "ba", "c")):
        with pytest.raises(ValueError):
            fill_middle.rearranged(docs, marks=bad)


def test_report(spark, docs):
    want = {(d, n, form, a, b, sha(out), sha(t or "")) for (d, t) in odd_rows() for _, n, form, a, b, out in [brute(d, t)]}
    assert {tuple(r) for r in fill_middle.report(docs).collect()} == want
    assert fill_middle.report(docs.where("doc_id < 0")).count() == 0


def test_only_owning_chunks_are_scanned_again(monkeypatch):
    data, offsets = tb.column_bytes(__import__("pyarrow").array(["a\n" * 100_000, "b", ""]))
    chunks = fill_middle.Chunks(data, offsets, "lines", 64)
    read, plain = [], chunks._borders
    monkeypatch.setattr(chunks, "_borders", lambda a, b: read.append(b - a) or plain(a, b))
    assert chunks.places(np.array([77_777, 1, 0])).tolist() == [2 * 77_777, 200_001, 200_001] and sum(read) <= 64
