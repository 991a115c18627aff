import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from loomgrid.llm import huffman, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(rows):
    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 50, 20000])
def test_huffman_round_trip_and_kraft(n):
    rng = np.random.default_rng(n)
    counts = np.zeros(n + 3, np.int64)
    counts[rng.permutation(n + 3)[:n]] = (rng.pareto(0.7, n) * 3 + 1).astype(np.int64)
    lengths = huffman.code_lengths(counts)
    assert lengths.max() <= huffman.LIMIT and (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1
    for m in (0, 1, 1023, 1024, 1025, 5000):
        symbols = rng.choice(np.flatnonzero(counts), m)
        bits, at = huffman.encode(symbols, lengths, huffman.codes_of(lengths))
        assert (huffman.decode(bits, at, m, huffman.decoding_table(lengths)) == symbols).all()


def test_whole_table_against_the_library(spark):
    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = brute(sorted((r["doc_id"], r["text"]) for r in rows))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(map(tuple, token_files.store_and_read_back(docs, PATH).collect())) == want


def test_edge_cases(spark):
    odd = ["", None, "a b\x1cc  d\n\n\te", "<|endoftext|> x<|startoftext|>y", "café ́x", "it's 2024!!! don't we'll", "\U0001f600 " * 30, "z" * 5000, "İSTANBUL ΣΑΣ"]
    rows = [(i, t) for i, t in enumerate(odd)] + [(50, "same"), (50, "same")]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, start string, n_tokens int")
    assert sorted(map(tuple, token_files.store_and_read_back(docs, PATH).collect())) == sorted(brute(rows))
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.store_and_read_back(none, PATH).count() == 0
    null = spark.createDataFrame([(None, "b a"), (1, "c")], "doc_id long, text string")
    assert sorted((r.start, r.doc_id) for r in token_files.store_and_read_back(null, PATH).collect()) == [(0, None), (3, 1)]
