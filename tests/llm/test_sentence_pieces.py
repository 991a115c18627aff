import collections

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece

from loomgrid.llm import sentence_pieces as s
from loomgrid.llm import textbytes as tb

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", "  a  b \n c ", "x▁y", "é́", "\U0001f600 ok", "\x00\x01", "a" * 300, "   ", " ", "\ttab", "ＡＢ ﬁ", "<s> </s> <unk> <0x0A>"]


def segmentations(words, chunk):
    text, out = chunk.decode().replace(" ", s.SPACE_MARK), []

    def extend(at, pieces, weight):
        if at == len(text):
            out.append((tuple(pieces), weight))
        for size in range(1, min(words.longest, len(text) - at) + 1):
            piece = words.model.piece_to_id(text[at : at + size])
            if piece != words.model.unk_id() and words.bytes_of[piece] and not words.model.is_byte(piece):
                extend(at + size, [*pieces, piece], weight + words.weight[piece])

    extend(0, [], 0.0)
    return out


def test_same_ids_and_texts_as_the_library(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    encoded = s.encode(docs, PATH)
    assert {r.doc_id: r.ids for r in encoded.collect()} == {d: model.encode(t) for d, t in rows}
    assert {r.doc_id: r.text for r in s.decode(encoded, PATH).collect()} == {d: model.decode(model.encode(t)) for d, t in rows}


@pytest.mark.parametrize("k", [1, 3])
def test_samples_have_the_distribution_without_replacement(k):
    words, n = s.vocabulary(PATH), 20_000
    chunks = s.chunks_of_text(b"hello ab")
    every = [(a + b, x + y) for a, x in segmentations(words, chunks[0]) for b, y in segmentations(words, chunks[1])]
    total = np.logaddexp.reduce([w for _, w in every])
    p = {pieces: float(np.exp(w - total)) for pieces, w in every}
    table = s.Lattices(words)
    table.texts([chunks] * n)
    paths, threshold = s.sample_paths(table, [chunks] * n, tb.mix(np.arange(n).astype(np.uint64)), k)
    seen, weighted, counts = [set() for _ in range(n)], np.zeros(n), [collections.Counter() for _ in paths]
    for path, count in zip(paths, counts, strict=True):
        ids, off = table.ids(path.edge, path.texts(), n)
        q = np.exp(s.log_inclusion(path.logp, threshold))
        for i in range(n):
            pieces = tuple(ids[off[i] : off[i + 1]].tolist())
            assert pieces not in seen[i] and abs(np.log(p[pieces]) - path.logp[i]) < 1e-6
            seen[i].add(pieces)
            count[pieces] += 1
            weighted[i] += p[pieces] / q[i]
    assert abs(weighted.mean() - 1) < 5 * weighted.std() / n**0.5 + 1e-9  # inclusion scores weight without bias
    for best in sorted(p, key=p.get)[-3:]:
        assert abs(counts[0][best] / n - p[best]) < 0.02
        if k > 1:
            assert abs(counts[1][best] / n - sum(p[o] * p[best] / (1 - p[o]) for o in p if o != best)) < 0.02


def test_report_edge_cases(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "abc"), (50, None), (60, "same text"), (60, "same text")]
    got = s.report(spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, n_ids int"), PATH).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert len(got) == len(rows) and by[60][0] == by[60][1] and by[0][0].n_samples == 1 and by[50][0].n_ids == 0
    assert not by[2][0].round_trip and all(by[i][0].round_trip for i in range(len(ODD)) if i != 2)
    assert all(len(set(r.sample_crc32)) == r.n_samples for r in got)
    assert s.report(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_independent_of_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    one = sorted(map(tuple, s.report(docs.coalesce(1), PATH).collect()), key=lambda r: r[0])
    many = sorted(map(tuple, s.report(docs.repartition(7), PATH).collect()), key=lambda r: r[0])
    assert one == many


class _Docs:
    """Stands for a table: gives the function that runs in the tasks."""

    sparkSession = None

    def selectExpr(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def test_memory_of_a_task_does_not_grow_with_its_batches(monkeypatch):
    import tracemalloc

    import public_tokenizers
    import pyarrow as pa

    monkeypatch.setattr(s, "tune", lambda spark: spark)
    run = s.report(_Docs(), public_tokenizers.path("piece_bpe_32k.model"))
    text = "some words that come again and again " * 400
    batch = lambda n: pa.RecordBatch.from_pydict({"doc_id": list(range(n)), "text": [text] * n})
    list(run([batch(1)]))
    tracemalloc.start()
    rows = sum(x.num_rows for x in run([batch(80)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 80 and peak < 30e6  # of 1.2 MB of text; it was 57 MB in slices of 1 MB


def test_powers_are_not_kept_for_the_next_operator():
    import pyarrow as pa

    from loomgrid.llm import textbytes as tb

    for part in tb.slices([pa.RecordBatch.from_pydict({"text": ["two words"]})]):
        data, off = tb.column_bytes(part.column("text"))
        starts, ends, _ = tb.word_bounds(data, off)
        tb.Hasher(1).words(data, starts, ends)
    assert not tb._POWERS
