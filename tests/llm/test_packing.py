import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from loomgrid.llm import packing, tokenizing

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute_best_fit(lengths, capacity):
    """Best fit over single pieces, longest first: the room left in each sequence, sorted."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        r = min(fits) if fits else capacity
        if fits:
            room.remove(r)
        room.append(r - n)
    return sorted(room)


@pytest.mark.parametrize("capacity,n", [(1, 5), (7, 0), (10, 40), (64, 300), (100, 500)])
def test_plan_is_best_fit(capacity, n):
    rng = random.Random(capacity)
    lengths = [min(capacity, 1 + int(rng.expovariate(3 / capacity))) for _ in range(n)]
    counts = np.bincount(lengths, minlength=capacity + 1) if n else np.zeros(capacity + 1, int)
    filled, placed = collections.defaultdict(list), collections.Counter()
    for length, first, last, sequence, per, offset in packing.plan(counts):
        for i in range(last - first):
            filled[sequence + i // per].append((offset + i % per * length, length))
            placed[length, first + i] += 1
    assert sorted(placed) == [(x, r) for x in range(1, capacity + 1) for r in range(counts[x])] and set(placed.values()) <= {1}
    for held in filled.values():
        ends = 0
        for at, length in sorted(held):
            assert at == ends
            ends += length
        assert ends <= capacity
    assert sorted(filled) == list(range(len(filled)))
    assert sorted(capacity - sum(x for _, x in held) for held in filled.values()) == brute_best_fit(lengths, capacity)


def test_plan_does_not_grow_with_the_counts():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 5, 4097)
    small, large = packing.plan(counts), packing.plan(counts * 10**9)
    assert len(large) < 3 * len(small)


def ids_of(tokenizer, text, capacity, end):
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
    return [(i // capacity, i, ids[i : i + capacity]) for i in range(0, len(ids), capacity)]


def held_against(rows, got, capacity, end=packing.END_ID):
    """Every piece once, ids as the library's, sequences filled without gaps."""
    tokenizer = Tokenizer.from_file(PATH)
    want = collections.Counter((d, p, a, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, t in rows for p, a, x in ids_of(tokenizer, t, capacity, end))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        ends = 0
        for at, n in sorted(held):
            assert at == ends
            ends += n
        assert ends <= capacity
    lengths = [x[3] for x in want.elements()]
    assert len(sequences) == len(brute_best_fit(lengths, capacity))


def test_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held_against(rows, packing.pieces_of(packing.pack(docs, PATH)).collect(), packing.CAPACITY)


def test_odd_rows(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns, several tasks."""
    rng = random.Random(5)
    words = ["alpha", "Beta", "x1", "don't", "\U0001f600", "ß", "#!"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(40)))) for i in range(300)]
    rows += [(500, None), (501, ""), (None, "a b"), (None, None), (7, rows[7][1]), (502, "word " * 3000), (503, "y" * 9000)] + [(600 + i, "one two three") for i in range(200)]
    made = spark.createDataFrame([(d, t, 1, "own", 2) for d, t in rows], "doc_id long, text string, part int, ids string, length int").repartition(6)
    held_against(rows, packing.pieces_of(packing.pack(made, PATH, 64)).collect(), 64)
    none = made.where("doc_id < -1")
    assert packing.pack(none, PATH).count() == 0 == packing.pieces_of(packing.pack(none, PATH)).count()


def test_sequences_hold_their_ids(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four")], "doc_id long, text string")
    tokenizer = Tokenizer.from_file(PATH)
    rows = packing.pack(docs, PATH, 8, 49407).collect()
    got = {(s.doc_id, s.piece): r.ids[s.offset : s.offset + s.length] for r in rows for s in r.segments}
    assert got == {(d, 0): [*tokenizer.encode(t, add_special_tokens=False).ids, 49407] for d, t in ((1, "one two three"), (2, "four"))}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_every_shipped_tokenizer(name):
    """And of one that differs from the short way's by its normalizer alone."""
    import json

    import pyarrow as pa

    texts = ["Hello World", "", None, " two  spaces\n\n\tTab ", "İSTANBUL ΣΑΣ ß", "don't <|endoftext|> a<|endoftext|>b", "x" * 700, "\U0001f600 naïve café ́", "1234 5.6e7", "AB cd " * 400]
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    ids, offsets = tokenizing.Encoder(path).column(pa.array(texts), (9,))
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [[*plain.encode(t or "", add_special_tokens=False).ids, 9] for t in texts]
    assert (tokenizing.Encoder(path).table is not None) == (name == "word_bpe_49k.json")
    made = json.loads(plain.to_str())
    made["normalizer"] = None
    assert not tokenizing._is_short_way(Tokenizer.from_str(json.dumps(made)))
    assert tokenizing.id_bytes(path) == 2 and tokenizing.id_bytes(path, 1 << 16) == 4
