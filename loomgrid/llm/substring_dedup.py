"""Substring deduplication by difference-cover anchors.

A window of ``WINDOW`` words repeats when its word sequence starts earlier in
the corpus too. Hashing every window would shuffle a row for each word. Instead
short anchors of ``ANCHOR`` words are hashed only at positions whose residue
modulo ``PERIOD`` is in a difference cover: for any two positions some shift
below the period brings both onto the cover, so two equal windows of
ANCHOR + PERIOD words or more always share an aligned anchor.

0. A document whose whole text has a smaller doc_id elsewhere repeats as a whole.
   Such copies are known from narrow rows of text hashes and only marked; they
   take no part in the steps below.
1. Each task combines the anchors of a stretch of text: those that occur several
   times in it are known to repeat, and one row stands for them. What is left is
   shuffled by hash, so a passage that a third of all documents share is one row
   for each stretch and not one for each document; the known ones are spread at
   random. A stream over each sorted partition keeps the anchors that occur at
   two places or more (constant memory, however often one occurs).
2. Where documents have repeated anchors, they extend: each window around one
   is hashed to 96 bits with its place in corpus order as one integer, the
   first place of a group is found by a combining aggregation, and only the
   firsts come back to their documents.
3. A document drops the words covered by candidate windows that are not firsts.

Each step writes its small result (positions, never text) to the shared folder,
so that its shuffle can be dropped before the next.

Defined results: null or empty texts have no words; rows without a doc_id take
no part and lose nothing; exact repetitions of a row (doc_id and text) are one
document and get the same result; rows that share a doc_id but not the text are
ordered by a hash of the text; an empty table gives an empty result; other
columns are ignored by the report.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .workspace import small_side, tune, with_row_key, write_table

WINDOW, ANCHOR, PERIOD = 20, 8, 13
# A perfect difference set; every non-zero residue modulo 13 is a difference of two of them.
COVER = (0, 1, 3, 9)
_ANCHOR_HASH, _FIRST_HASH, _SECOND_HASH = 11, 12, 13
#: Anchors of so many bytes of text are combined before they are shuffled.
COMBINE_BYTES = 4 << 20
#: Kinds of rows: the only anchor of its hash in a stretch, one for several, and each of those several.
ONE, SEVERAL, KNOWN = 0, 1, 2


def _words(part: pa.RecordBatch):
    data, offsets = tb.column_bytes(part.column("text"))
    starts, ends, first = tb.word_bounds(data, offsets)
    return data, starts, ends, first


def _combined(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """(key, kind, doc_id, k1, at) of the anchors (h, doc_id, k1, at) of one stretch of text."""
    h, doc, k1, at = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(h, kind="stable")
    h, doc, k1, at = h[order], doc[order], k1[order], at[order]
    new = np.r_[True, h[1:] != h[:-1]]
    several = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1
    spread = tb.mix(doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + k1.view(np.uint64) + at.astype(np.uint64)).view(np.int64)
    head = np.flatnonzero(new & several)
    kind = np.r_[np.where(several, KNOWN, ONE), np.full(len(head), SEVERAL)].astype(np.int8)
    row = np.r_[np.arange(len(h)), head]
    return pa.RecordBatch.from_arrays([pa.array(np.r_[np.where(several, spread, h), h[head]]), pa.array(kind), pa.array(doc[row]), pa.array(k1[row]), pa.array(at[row].astype(np.int32))], names=["key", "kind", "doc_id", "k1", "at"])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher, cover = tb.Hasher(_ANCHOR_HASH), np.isin(np.arange(PERIOD), COVER)
    held, sent, size = [], set(), 0
    for part in tb.slices(batches):
        data, starts, ends, first = _words(part)
        wanted = np.diff(first) >= WINDOW
        doc, k1 = (part.column(n).to_numpy() for n in ("doc_id", "k1"))
        for i in np.flatnonzero(wanted).tolist():
            if (row := (doc[i], k1[i])) in sent:  # an exact repetition of a row within the stretch
                wanted[i] = False
            sent.add(row)
        rows, at = tb.window_rows(first, ANCHOR)
        place = at - first[rows]
        keep = cover[place % PERIOD] & wanted[rows]
        rows, at, place = rows[keep], at[keep], place[keep]
        found = hasher.windows(hasher.words(data, starts, ends), ANCHOR)
        if len(rows):
            held.append((found[at].view(np.int64), doc[rows], k1[rows], place))
        size += len(data)
        if size >= COMBINE_BYTES and held:
            yield _combined(held)
            held, sent, size = [], set(), 0
    if held:
        yield _combined(held)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, the known ones and those whose hash another row has too. The last row of a batch waits for the next."""
    tb.release()
    held: pa.RecordBatch | None = None
    before = None  # the hash before the held row
    names = ["doc_id", "k1", "at"]
    for batch in batches:
        known = batch.column("kind").to_numpy() == KNOWN
        if known.any():
            yield batch.select(names).take(pa.array(np.flatnonzero(known)))
            batch = batch.take(pa.array(np.flatnonzero(~known)))
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        h = batch.column("key").to_numpy()
        same = np.zeros(len(h), bool)
        same[1:] = h[1:] == h[:-1]
        if before is not None:
            same[0] = h[0] == before
        twin = same.copy()
        twin[:-1] |= same[1:]
        twin &= batch.column("kind").to_numpy() == ONE
        if len(h) > 1:
            yield batch.select(names).take(pa.array(np.flatnonzero(twin[:-1])))
            before = int(h[-2])
        held = batch.slice(len(h) - 1)
    if held is not None and before is not None and held.column("kind")[0].as_py() == ONE and held.column("key")[0].as_py() == before:
        yield held.select(names)


def _candidates(anchors: np.ndarray, of: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, start) of the windows that hold one of the anchors, distinct and ascending."""
    start = (anchors[:, None] - np.arange(PERIOD)).ravel()
    row = np.repeat(of, PERIOD)
    ok = (start >= 0) & (start + WINDOW <= n_words[row])
    key = np.unique(row[ok].astype(np.int64) << 32 | start[ok])
    return key >> 32, key & 0xFFFFFFFF


def _list_column(part: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, row of each value) of a list column; null counts as empty."""
    column = part.column(name)
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(lengths)), lengths)


def _windows(bits: int):
    """Texts with their anchors and corpus order to (h, g, place): order << bits | start, for the first of equal windows in a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = tb.Hasher(_FIRST_HASH), tb.Hasher(_SECOND_HASH)
        for part in tb.slices(batches, most=4 << 20):
            data, starts, ends, first = _words(part)
            rows, start = _candidates(*_list_column(part, "anchors"), np.diff(first))
            at = first[rows] + start
            h = one.windows(one.words(data, starts, ends), WINDOW)[at].view(np.int64)
            g = (two.windows(two.words(data, starts, ends), WINDOW)[at] >> np.uint64(33)).astype(np.int32)
            place = part.column("nth").to_numpy()[rows] << bits | start
            order = np.lexsort((place, g, h))
            a, b = h[order], g[order]
            lead = order[np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]] if len(order) else order
            yield pa.RecordBatch.from_arrays([pa.array(x[lead]) for x in (h, g, place)], names=["h", "g", "place"])

    return run


_ROW = ("doc_id", "k1")


def _same(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & a["k1"].eqNullSafe(b["k1"])


def copies(known: DataFrame) -> DataFrame:
    """(doc_id, k1) of the documents whose whole text has a smaller doc_id elsewhere."""
    texts = known.select("doc_id", "k1", "k2").distinct()
    first = texts.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("k1").alias("x"), F.col("k2").alias("y"), "first")
    return texts.join(first, (texts["k1"] == F.col("x")) & (texts["k2"] == F.col("y"))).where(F.col("doc_id") > F.col("first")).select(*_ROW)


def repeated_anchors(known: DataFrame) -> DataFrame:
    """(doc_id, k1, anchors): positions of the anchors that occur elsewhere too."""
    rows = known.mapInArrow(_anchors, "key long, kind tinyint, doc_id long, k1 long, at int")
    sorted_rows = rows.repartition("key").sortWithinPartitions("key")
    repeated = sorted_rows.mapInArrow(_repeated, "doc_id long, k1 long, at int")
    return repeated.groupBy(*_ROW).agg(F.collect_set("at").alias("anchors"))  # a set: exact repetitions of a row find the same


def in_order(anchors: DataFrame) -> tuple[DataFrame, int]:
    """The rows with ``nth``, an integer in order of (doc_id, k1), and the bits that a position needs below it."""
    ordered = anchors.repartitionByRange(*_ROW).sortWithinPartitions(*_ROW).withColumn("id", F.monotonically_increasing_id())
    ordered, _ = write_table(ordered, "ordered-anchors")
    within = F.col("id").bitwiseAND((1 << 33) - 1)
    part, row, at = ordered.agg(F.max(F.shiftright("id", 33)), F.max(within), F.max(F.array_max("anchors"))).first()
    row_bits, bits = int(row or 0).bit_length(), int(at or 0).bit_length()
    if int(part or 0).bit_length() + row_bits + bits > 63:
        raise ValueError("documents too many or too long for places of 63 bits")
    return ordered.withColumn("nth", F.shiftleft(F.shiftright("id", 33), row_bits).bitwiseOR(within)).drop("id"), bits


def first_windows(known: DataFrame, ordered: DataFrame, bits: int) -> DataFrame:
    """(nth, firsts): starts of the candidate windows that begin nowhere earlier."""
    extended = known.join(ordered, _same(known, ordered)).select(known["text"], "nth", "anchors")
    places = extended.mapInArrow(_windows(bits), "h long, g int, place long").groupBy("h", "g").agg(F.min("place").alias("place"))
    return places.groupBy(F.shiftright("place", bits).alias("nth")).agg(F.collect_list(F.col("place").bitwiseAND((1 << bits) - 1).cast("int")).alias("firsts"))


def _covered(part: pa.RecordBatch, first: np.ndarray) -> np.ndarray:
    """True for each word that a candidate window other than a first covers."""
    n_words = np.diff(first)
    copy = part.column("copy").to_numpy(zero_copy_only=False).astype(bool) & (n_words >= WINDOW)
    rows, start = _candidates(*_list_column(part, "anchors"), n_words)
    values, of = _list_column(part, "firsts")
    gone = ~np.isin(rows << 32 | start, of.astype(np.int64) << 32 | values)
    step = np.zeros(int(first[-1]) + 1, np.int64)
    np.add.at(step, first[rows[gone]] + start[gone], 1)
    np.add.at(step, first[rows[gone]] + start[gone] + WINDOW, -1)
    return (np.cumsum(step)[:-1] > 0) | np.repeat(copy, n_words)


def _marked(docs: DataFrame) -> DataFrame:
    """The documents with what was found for them; small tables stay in the shared folder."""
    tune(docs.sparkSession)
    keyed = with_row_key(docs)
    known = keyed.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    copied, _ = write_table(copies(known), "copies")
    ordered, bits = in_order(repeated_anchors(known.join(small_side(copied), list(_ROW), "left_anti")))
    firsts, _ = write_table(first_windows(known, ordered, bits), "firsts")
    none = F.lit(None).cast("array<int>")
    found = ordered.join(firsts, "nth", "left").select(*_ROW, "anchors", "firsts", F.lit(False).alias("copy"))
    found, _ = write_table(found.unionByName(copied.select(*_ROW, none.alias("anchors"), none.alias("firsts"), F.lit(True).alias("copy"))), "repeats")
    return keyed.join(found, _same(keyed, found), "left").select(keyed["doc_id"], keyed["text"], "anchors", "firsts", F.coalesce("copy", F.lit(False)).alias("copy"))


def report(docs: DataFrame) -> DataFrame:
    """One row for each document: n_words, n_removed, and the digest of the kept words joined by a space."""

    def run(batches):
        for part in tb.slices(batches):
            data, starts, ends, first = _words(part)
            covered = _covered(part, first)
            removed = np.r_[0, np.cumsum(covered)][first]
            raw, offsets = data.tobytes(), tb.column_bytes(part.column("text"))[1]
            digests = []
            for i in range(part.num_rows):
                words = raw[offsets[i] : offsets[i + 1]].split()
                if removed[i + 1] > removed[i]:
                    words = [w for w, gone in zip(words, covered[first[i] : first[i + 1]].tolist(), strict=True) if not gone]
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(first)), pa.array(np.diff(removed)), pa.array(digests)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _marked(docs).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) without the repeated words; the space around kept words stays as it was."""

    def run(batches):
        for part in tb.slices(batches):
            data, starts, ends, first = _words(part)
            gone = _covered(part, first)
            step = np.zeros(len(data) + 1, np.int64)
            np.add.at(step, starts[gone], 1)
            np.add.at(step, ends[gone], -1)
            keep = np.cumsum(step)[:-1] == 0
            raw = data[keep].tobytes()
            at = np.r_[0, np.cumsum(keep)][tb.column_bytes(part.column("text"))[1]].tolist()
            texts = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pc.if_else(part.column("text").is_null(), pa.scalar(None, pa.string()), texts)], names=["doc_id", "text"])

    return _marked(docs).mapInArrow(run, "doc_id long, text string")
