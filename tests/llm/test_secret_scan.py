import hashlib
import random
import re

import pyarrow as pa
import pytest

from loomgrid.llm import secret_scan as s
from loomgrid.llm import textbytes as tb

ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def base_spans(texts):
    data, off = tb.column_bytes(pa.array(texts))
    got = s.scanner().documents(data, off)
    return [[x for x in s._in_chars(sorted(got.get(i, [])), data[off[i] : off[i + 1]].tobytes()) if x[1] < 3] for i in range(len(texts))]


def test_same_as_regex_search_on_random_texts():
    rng = random.Random(7)
    parts = ["token", "secret", "=", ":", " ", '"', "'", "abc", "AKIA", "A1B2C3D4E5F6", "0123456789abcdef", "api_key", "APIKEY", "é", "ſecret", "\n", "-", "passwd", "x" * 5, "ab12" * 9, "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    texts += ["", "a" * 5000, "token" + " " * 3000 + "=abcdefgh", "secret=token:abcdef", "token==abcdef", "é" * 300 + "token=abcdef"]
    assert base_spans(texts) == [brute(t) for t in texts]


def test_rules_beyond_the_base_ones_and_redaction(spark):
    key = "-----BEGIN RSA PRIVATE KEY-----"
    rows = [(1, f"x {key} y", "a"), (2, None, "b"), (3, "", "c"), (3, "token=abcdef token=abcdef", "d"), (None, "token=abcdef", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {(r.doc_id, r.spans): r for r in s.scan_digests(docs).collect()}
    assert got[(1, f"pem:2:{2 + len(key)}")].n_more == 1 and got[(2, "")].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert (None, "assign:0:12") in got and len(got) == 5
    clean = {r.spans: r.text for r in s.redact_secrets(docs).collect()}
    assert clean == {"a": "x [secret:pem] y", "b": None, "c": "", "d": "[secret:assign] [secret:assign]", "e": "[secret:assign]"}
    found = s.find_secrets(docs).collect()
    assert ("assign", 13, 25, "token=abcdef") in [tuple(r)[1:] for r in found]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert s.scan_digests(docs).count() == 0 and s.redact_secrets(docs).count() == 0


def test_rules_over_line_feeds_are_refused():
    with pytest.raises(ValueError):
        s.compile_search((s.Rule("x", r"a\x0Ab", 1),))


JWT = re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")


def test_further_kinds_as_regex_search():
    rng = random.Random(9)
    parts = ["eyJ", ".", "a", "eyJa.eyJb.c", "-", " ", "ghp_", "AbC0" * 12, "gho_x", "-----BEGIN ", "RSA PRIVATE KEY-----", "PRIVATE KEY-----", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    data, off = tb.column_bytes(pa.array(texts))
    got = s.scanner().documents(data, off)
    for i, t in enumerate(texts):
        want = [(m.start(), 3, m.end()) for m in re.finditer("-----BEGIN [A-Z ]*PRIVATE KEY-----", t)]
        want += [(m.start(), 4, m.end()) for m in re.finditer("gh[pousr]_[A-Za-z0-9]+", t) if len(m[0]) >= 40]
        want += [(m.start(), 5, m.end()) for m in JWT.finditer(t)]
        assert [x for x in s._in_chars(sorted(got.get(i, [])), t.encode()) if x[1] > 2] == sorted(want), t


def test_time_grows_with_the_text_alone():
    import time

    texts = ["eyJ" * 350_000 + ".aeyJa.eyJb.c", "eyJ" + "a" * 1_000_000 + ".eyJa.b", "token " * 170_000 + "token=abcdef", "token=" * 170_000, "gho_" * 250_000]
    for text in texts:
        began = time.process_time()
        data, off = tb.column_bytes(pa.array([text]))
        got = s.scanner().documents(data, off)
        assert time.process_time() - began < 8, text[:10]
        want = brute(text) + [(m.start(), 4, m.end()) for m in re.finditer("gh[pousr]_[A-Za-z0-9]+", text) if len(m[0]) >= 40]
        assert sorted(got.get(0, [])) == sorted(want + ([(len(text) - 11, 5, len(text))] if text.endswith(".c") else [(0, 5, len(text))] if text.endswith("a.b") else []))


def test_lanes_that_remember():
    """States that every lane hands on to the next one."""
    from loomgrid.llm.automaton import compile_rules

    import numpy as np

    rng = random.Random(5)
    for pattern in ("a[bc]*d", "(?:aa)+b", "x[^y]*y"):
        found = compile_rules([pattern], search=True)
        for _ in range(20):
            data = np.frombuffer("".join(rng.choices("abcdxy", weights=[1, 30, 30, 0.2, 0.2, 0.2], k=rng.randrange(4000))).encode(), np.uint8)
            state, want = 0, []
            for b in data.tolist():
                state = found.rows[state][found.byte_class[b]]
                want.append(state)
            assert found.states(data, 16).tolist() == want
