"""Language identification by Bayesian evidence fusion.

The posterior of a language multiplies
* the likelihood of the text under byte-trigram models of each language, with a
  uniform model for the class ``und`` (no known language),
* the likelihood of the declared markup language (``<html lang=...>``) under a
  confusion table: how often documents of a language declare that code, and
* a prior of the document's host, smoothed towards that of its address suffix,
  and that towards the whole corpus.

Only the trigram models come from a bounded sample of labelled rows
(``SAMPLE_ROWS``, by hash of doc_id). The confusion table and the priors are
grouped aggregations over the text verdicts of all documents; a document's own
verdict is taken out of the counts that judge it, so its text speaks once. Texts
are never shuffled: scoring leaves narrow rows, and these meet their host's
counts through a salted join, so that a host with a third of all rows is spread.

Defined results: null or empty texts have no text evidence and are rejected, and
so are texts that look like no language on their own, whatever their host's are;
a null or empty source counts as one host without a suffix; rows without a
known language label don't train; without any label every document is ``und``
and rejected; ties go to the alphabetically first language; repeated rows get
equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .workspace import row_key, rows_in, tune, write_table

UNKNOWN = "und"
#: About so many labelled rows train the trigram models.
SAMPLE_ROWS = 4000
BUCKETS = 1 << 14
#: Trigrams overlap, so their likelihoods are tempered; pseudo-counts of hosts, suffixes, declared codes; prior of ``und``; least posterior.
TEMPER, HOST_WEIGHT, SUFFIX_WEIGHT, DECLARED_WEIGHT, UNKNOWN_PRIOR, LEAST = 1 / 3, 20.0, 100.0, 10.0, 1e-3, 0.5
SALT = 16


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of the byte trigrams within each row; A-Z lower-cased, runs of digits and punctuation as they are."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = tb.LOWER[data].astype(np.uint32)
    h = x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)
    h = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    bucket = (h >> np.uint32(18)).astype(np.int64)
    keep = np.ones(len(bucket), bool)
    for back in (1, 2):
        at = offsets[1:-1] - back
        keep[at[(at >= 0) & (at < len(keep))]] = False
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:-2]
    return bucket[keep], rows[keep]


def trigram_blocks(data: np.ndarray, offsets: np.ndarray, step: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for so many bytes at a time: one text may be very long."""
    for a in range(0, len(data) - 2, step):
        b = min(a + step, len(data) - 2) + 2
        low = int(np.searchsorted(offsets, a, "right")) - 1
        high = int(np.searchsorted(offsets, b, "left"))
        bucket, row = trigrams(data[a:b], np.clip(offsets[low : high + 1], a, b) - a)
        yield bucket, row + low


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, log probability by language and bucket) from about ``sample_rows`` rows (doc_id, text, lang)."""
    rows = labelled.where("lang IS NOT NULL AND lang <> '' AND text IS NOT NULL").where(F.col("lang") != UNKNOWN)
    n = rows.count()
    share = min(1.0, sample_rows / n) if n else 1.0
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches):
            langs, code = np.unique(np.array(part.column("lang").to_pylist(), object).astype(str), return_inverse=True)
            for bucket, row in trigram_blocks(*tb.column_bytes(part.column("text"))):
                found, counts = np.unique(code[row] * BUCKETS + bucket, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(langs[found // BUCKETS].tolist(), pa.string()), pa.array(found % BUCKETS), pa.array(counts)], names=["lang", "bucket", "n"])

    counted = chosen.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # languages x BUCKETS at most
    langs = sorted(set(counted["lang"]))
    total = np.full((len(langs), BUCKETS), 0.5)
    np.add.at(total, (np.searchsorted(langs, counted["lang"].to_numpy(str)) if len(langs) else np.zeros(0, int), counted["bucket"].to_numpy(np.int64)), counted["n"].to_numpy(np.float64))
    return langs, np.log(total / total.sum(axis=1, keepdims=True)) if len(langs) else total


def declared_language(text: Column) -> Column:
    """The first two letters of the lang attribute of an html tag, lower-case; else null."""
    found = F.lower(F.regexp_extract(text, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2})""", 1))
    return F.when((text.contains("<html") | text.contains("<HTML")) & (found != ""), found)


def address_host(address: Column) -> Column:
    """Host of a URL, or the name itself, lower-case."""
    return F.lower(F.regexp_extract(F.coalesce(address, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)", 1))


def address_suffix(host: Column) -> Column:
    return F.when(host.contains("."), F.substring_index(host, ".", -1)).otherwise("")


def scored(evidence: DataFrame, langs: list[str], logp: np.ndarray) -> DataFrame:
    """Rows (doc_id, k1, k2, text, declared, host, suffix) to narrow rows with ``score`` (tempered log likelihood by class, ``und`` last), ``n_grams`` and ``guess``."""
    table = np.ascontiguousarray(logp.T.astype(np.float32)) if len(langs) else np.zeros((BUCKETS, 0), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches):
            n = part.num_rows
            counts, sums = np.zeros(n, np.int64), np.zeros((n, len(langs) + 1))
            for bucket, row in trigram_blocks(*tb.column_bytes(part.column("text"))):
                counts += np.bincount(row, minlength=n)
                for k in range(len(langs)):
                    sums[:, k] += np.bincount(row, table[:, k][bucket], n)
            sums[:, -1] = -np.log(BUCKETS) * counts
            guess = np.where(counts > 0, sums.argmax(axis=1), len(langs))
            score = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (len(langs) + 1)), pa.array((sums * TEMPER).ravel()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "k1", "k2", "declared", "host", "suffix")), score, pa.array(counts), pa.array(guess.astype(np.int32))], names=["doc_id", "k1", "k2", "declared", "host", "suffix", "score", "n_grams", "guess"])

    return evidence.select("doc_id", "k1", "k2", "declared", "host", "suffix", "text").mapInArrow(run, "doc_id long, k1 long, k2 int, declared string, host string, suffix string, score array<double>, n_grams long, guess int")


def class_counts(rows: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    """(keys, ``name``): how many rows of each key have each guess, as an array."""
    counted = rows.groupBy(*keys, "guess").agg(F.count(F.lit(1)).alias("n"))
    each = [F.sum(F.when(F.col("guess") == i, F.col("n")).otherwise(0)) for i in range(n)]
    return counted.groupBy(*keys).agg(F.array(*each).cast("array<double>").alias(name))


def host_counts(rows: DataFrame, n: int) -> DataFrame:
    """(suffix, host, at_host, at_suffix, at_all): guesses counted at each level."""
    total = lambda name, column: F.array(*(F.sum(F.col(column)[i]) for i in range(n))).alias(name)
    by_host = class_counts(rows, ["suffix", "host"], n, "at_host")
    by_suffix = by_host.groupBy("suffix").agg(total("at_suffix", "at_host"))
    corpus = by_suffix.agg(total("at_all", "at_suffix"))
    return by_host.join(by_suffix, "suffix").crossJoin(F.broadcast(corpus))  # with one row


def declared_counts(rows: DataFrame, n: int) -> DataFrame:
    """(declared, at_code, at_codes, codes): guesses of the rows that declare a code, and of all that declare any. Codes have two letters, so there are few."""
    by_code = class_counts(rows.where("declared IS NOT NULL"), ["declared"], n, "at_code")
    every = by_code.agg(F.array(*(F.sum(F.col("at_code")[i]) for i in range(n))).alias("at_codes"), F.count(F.lit(1)).alias("codes"))
    return by_code.crossJoin(F.broadcast(every))  # with one row


def _others(counts: str) -> Column:
    """Counts without the row's own guess."""
    return F.transform(counts, lambda c, i: F.greatest(c - F.when(i == F.col("guess"), 1.0).otherwise(0.0), F.lit(0.0)))


def _smoothed(counts: Column, parent: Column, weight: float) -> Column:
    """Shares of counts, with ``weight`` more of them spread as the parent has it."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x) + weight
    return F.zip_with(counts, parent, lambda c, up: (c + weight * up) / total)


def decide(docs: DataFrame, langs: list[str], logp: np.ndarray, markup: str = "text") -> DataFrame:
    """doc_id, k1, k2, lang, confidence, text_lang, declared, host_lang, kept for every row of ``docs`` (doc_id, text, source). The declared language is read from the column ``markup``."""
    tune(docs.sparkSession)
    names, n = [*langs, UNKNOWN], len(langs) + 1
    host, (doc_id, k1, k2) = address_host(F.col("source").cast("string")), row_key()
    keyed = docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"), k1.alias("k1"), k2.alias("k2"), host.alias("host"), declared_language(F.col(markup).cast("string")).alias("declared"))
    evidence = keyed.withColumn("suffix", address_suffix(F.col("host")))
    rows, _ = write_table(scored(evidence, langs, logp), "language-scores")
    hosts = host_counts(rows, n).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "k1"), F.lit(SALT)).cast("int"))
    joined = salted.join(hosts, ["suffix", "host", "salt"]).join(F.broadcast(declared_counts(rows, n)), "declared", "left")  # codes of two letters

    even = F.array(*(F.lit(UNKNOWN_PRIOR if i == n - 1 else (1 - UNKNOWN_PRIOR) / max(n - 1, 1)) for i in range(n)))
    out = joined.withColumn("corpus_prior", _smoothed(_others("at_all"), even, SUFFIX_WEIGHT))
    out = out.withColumn("suffix_prior", _smoothed(_others("at_suffix"), F.col("corpus_prior"), SUFFIX_WEIGHT))
    out = out.withColumn("prior", _smoothed(_others("at_host"), F.col("suffix_prior"), HOST_WEIGHT))
    own_code = F.array(*(F.when(F.col("declared") == name, 0.9).otherwise(0.1 / F.greatest(F.col("codes"), F.lit(1))) for name in names))
    given = F.zip_with(F.zip_with(_others("at_code"), own_code, lambda c, up: c + DECLARED_WEIGHT * up), _others("at_codes"), lambda c, all_: c / (all_ + DECLARED_WEIGHT))
    out = out.withColumn("given", F.coalesce(F.when(F.col("at_code").isNotNull(), given), F.array_repeat(F.lit(1.0), n)))
    log_post = F.zip_with(F.zip_with("score", "prior", lambda a, b: a + F.log(b)), "given", lambda a, b: a + F.log(b))
    out = out.withColumn("post", log_post).withColumn("top", F.array_max("post"))
    out = out.withColumn("mass", F.aggregate("post", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top"))))
    name_of = lambda at: F.element_at(F.array(*(F.lit(x) for x in names)), at.cast("int"))
    out = out.withColumn("lang", name_of(F.array_position("post", F.col("top")))).withColumn("confidence", F.round(1 / F.col("mass"), 6))
    kept = (F.col("lang") != UNKNOWN) & (F.col("guess") < n - 1) & (F.col("confidence") >= LEAST)
    return out.select("doc_id", "k1", "k2", "lang", "confidence", name_of(F.col("guess") + 1).alias("text_lang"), "declared", name_of(F.array_position("prior", F.array_max("prior"))).alias("host_lang"), kept.alias("kept"))


def report(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row for each document: lang, confidence, text_lang, declared, host_lang, kept. Labels are the column ``lang``; it trains only."""
    return decide(docs, *fit(docs.select("doc_id", "text", "lang"), sample_rows)).drop("k1", "k2")


def page_text(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags become spaces."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")


def page_report(pages: DataFrame, docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The report for each page (page_id, url, html) by models fitted on ``docs``: the host is that of the url, the declared language that of the html."""
    rows = pages.select(F.col("page_id").alias("doc_id"), page_text(F.col("html")).alias("text"), F.col("url").alias("source"), F.col("html").alias("markup"))
    return decide(rows, *fit(docs.select("doc_id", "text", "lang"), sample_rows), markup="markup").drop("k1", "k2").withColumnRenamed("doc_id", "page_id")


def keep_known(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents in a known language, with all their columns."""
    verdicts = decide(docs, *fit(docs.select("doc_id", "text", "lang"), sample_rows))
    rejected, _ = write_table(verdicts.where("NOT kept").select("doc_id", "k1", "k2").distinct(), "rejected")
    return rows_in(docs, rejected, "left_anti")
