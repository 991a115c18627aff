"""Benchmark decontamination by a positional inverted index, in DataFrame functions only.

Benchmark items become windows of ten words. A first pass over the documents
counts the windows' terms, and each window is filed under its rarest term, with
its next rarest. The index holds postings (document, term, position) as written
tables, and lists are intersected from the rarest on. First come the lists of
the two rarest terms of every window, for all documents: a posting of a rarest
term stays where a next rarest one stands near it (for exact matches just at its
own offset). Where any stay, the document's postings of all other terms of the
benchmark are stored too, and looked up around the places that stayed: a window
matches where every term has a posting at the position its offset asks for.
Proximity matches ask for the same terms, as often, within the window's length
plus a slop, in any order.

No text is shuffled but that of documents where a place stays, when there are
too many of them for a broadcast. Terms are broadcast when their measured
number and size are within bounds. Else a sieve of bits drops most unknown
words where they are read, counts are combined before they meet the terms, and
joins by term are salted, so that a very frequent term is spread.

Defined results: null or empty texts have no words and no hits; an item without
words has no window; a null item_id marks hits but is not counted or listed;
repeated items count once; repeated rows get equal results; rows that share a
doc_id but not the text are judged apart; empty tables give no hits; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import is_small, rows_in, same_row, small_side, with_row_key, write_table

# The bytes between words once A-Z are lower-cased, and the window's length.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Words that may stand between the terms of a proximity match.
SLOP = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Where terms are joined by a shuffle, the rows of one term are spread over so many keys.
SALTS = 32
#: Bits of the sieve for a term, and its most longs (16 MB).
SIEVE_BITS, SIEVE_LONGS = 16, 1 << 21
_KEYS = ("doc_id", "k1", "k2")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z only; ``lower`` does it for texts of ASCII alone, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN), "")


def windows(items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Written tables of the distinct windows (wid, terms) and of the items that have them (wid, item_id)."""
    split = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text").cast("string")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (size - 1)))
    each, _ = write_table(split.select("item_id", "w", F.explode(starts).alias("i")).select("item_id", F.slice("w", F.col("i"), size).alias("terms")).distinct(), "item-windows")
    found, _ = write_table(each.select("terms").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    named, _ = write_table(each.where("item_id IS NOT NULL").join(found, "terms").select("wid", "item_id"), "window-items")
    return found, named


def sieve(terms: DataFrame, longs: int) -> DataFrame:
    """One row with ``bits``: a hashed bit for each term."""
    h = F.xxhash64("term")
    filled = terms.select(F.pmod(h, F.lit(longs)).alias("i"), F.pmod(F.shiftrightunsigned(h, 32), F.lit(64)).cast("int").alias("bit")).groupBy("i").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("b"))
    whole = terms.sparkSession.range(longs).withColumnRenamed("id", "i").join(filled, "i", "left").select(F.struct("i", F.coalesce("b", F.lit(0).cast("long")).alias("b")).alias("x"))
    return whole.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]).alias("bits"))


def sieved_words(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, at, term): the places of words that may be among ``terms``."""
    longs = min(SIEVE_LONGS, max(1, 1 << (SIEVE_BITS * terms.count() // 64).bit_length()))
    placed = F.transform(words(F.col("text")), lambda x, i: F.struct(i.alias("at"), x.alias("term")))

    def maybe(x):
        h = F.xxhash64(x["term"])
        return F.getbit(F.get("bits", F.pmod(h, F.lit(longs)).cast("int")), F.pmod(F.shiftrightunsigned(h, 32), F.lit(64)).cast("int")) == 1

    both = docs.crossJoin(F.broadcast(sieve(terms, longs)))  # with one row of bounded size
    return both.select(*_KEYS, F.inline(F.filter(placed, maybe)))


def by_term(rows: DataFrame, terms: DataFrame, how: str) -> DataFrame:
    """``rows`` (doc_id, at, term, ...) joined with a table of terms: by a broadcast within the bounds, else by a salted shuffle."""
    if is_small(terms):
        return rows.join(F.broadcast(terms), "term", how)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "at"), F.lit(SALTS)).cast("int"))
    return salted.join(terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["term", "salt"], how).drop("salt")


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, at, term): the places, from 0, of the words among ``terms``, a written table; once for repeated rows."""
    if is_small(terms):
        placed = docs.select(*_KEYS, F.posexplode(words(F.col("text"))).alias("at", "term"))
    else:
        placed = sieved_words(docs, terms)
    return by_term(placed, terms, "left_semi").select(*_KEYS, "at", "term").distinct()


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): occurrences of ``terms`` in the documents; absent ones are left out."""
    if is_small(terms):
        found = docs.select(F.explode(words(F.col("text"))).alias("term")).join(F.broadcast(terms), "term", "left_semi")
        return found.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return sieved_words(docs, terms).groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(terms, "term")


def filed_windows(docs: DataFrame, found: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, offset, wid, terms, next_term, next_offset): each window under its rarest term by the documents' counts, with its next rarest, if it has several; windows with an absent term are left out."""
    counts, _ = write_table(term_counts(docs, terms), "term-counts")
    each = found.select("wid", "terms", F.posexplode("terms").alias("offset", "term")).join(small_side(counts), "term")
    ranked = each.groupBy("wid").agg(F.array_sort(F.collect_list(F.struct("n", "offset", "term"))).alias("r"), F.first("terms").alias("terms"))
    first, more = F.col("r")[0], F.get(F.filter("r", lambda x: x["term"] != F.col("r")[0]["term"]), F.lit(0))
    return ranked.where(F.size("r") == F.size("terms")).select(first["term"].alias("term"), first["offset"].alias("offset"), "wid", "terms", more["term"].alias("next_term"), more["offset"].alias("next_offset"))


def matches(docs: DataFrame, items: DataFrame, size: int = WINDOW, slop: int = 0) -> DataFrame:
    """``window_matches`` of the items' windows."""
    return window_matches(docs, windows(items, size)[0], size, slop)


def window_matches(docs: DataFrame, found: DataFrame, size: int = WINDOW, slop: int = 0) -> DataFrame:
    """(doc_id, k1, k2, wid, start, length, exact): the matches of the windows (wid, terms) of at most ``size`` terms.

    Exact ones are every occurrence, from ``start`` and ``length`` long. With a
    ``slop`` over 0 there are proximity matches too, with null in those columns:
    all terms of a window, as often as there and in any order, within a stretch
    of its length + slop words.
    """
    terms, _ = write_table(found.select(F.explode("terms").alias("term")).distinct(), "terms")
    filed, _ = write_table(filed_windows(docs, found, terms), "filed-windows")
    leading, _ = write_table(filed.select(F.explode(F.array("term", "next_term")).alias("term")).where("term IS NOT NULL").distinct(), "leading-terms")
    index, _ = write_table(postings(docs, leading), "leading-postings")
    reach = size - 1 + slop
    beside = F.collect_list(F.struct("at", "term")).over(Window.partitionBy(*_KEYS).orderBy("at").rangeBetween(-reach, reach))  # at most 2 reach + 1
    by_rarest = by_term(index.withColumn("beside", beside), filed.drop("terms"), "inner")
    fits = F.exists("beside", lambda x: (x["term"] == F.col("next_term")) & (F.lit(slop > 0) | (x["at"] == F.col("at") - F.col("offset") + F.col("next_offset"))))
    staying, _ = write_table(by_rarest.where(F.col("next_term").isNull() | fits).select(*_KEYS, "at", "term").distinct(), "staying-postings")
    having, _ = write_table(staying.select(*_KEYS).distinct(), "documents-with-places")
    others, _ = write_table(postings(rows_in(docs, having, "left_semi"), terms), "postings")

    asked = staying.select(*_KEYS, "at", "term", F.explode(F.sequence(F.col("at") - reach, F.col("at") + reach)).alias("place")).where("place >= 0")
    listed = others.select(*(F.col(c).alias(f"of_{c}") for c in _KEYS), F.col("at").alias("of_place"), F.col("term").alias("other"))
    same = F.col("doc_id").eqNullSafe(F.col("of_doc_id")) & (F.col("k1") == F.col("of_k1")) & (F.col("k2") == F.col("of_k2")) & (F.col("place") == F.col("of_place"))
    around = asked.join(listed, same).groupBy(*_KEYS, "at", "term").agg(F.collect_list(F.struct("place", "other")).alias("near"))  # at most 2 reach + 1
    both = by_term(around, filed.drop("next_term", "next_offset"), "inner")

    n, first = F.size("terms"), F.col("at") - F.col("offset")
    in_place = F.size(F.filter("near", lambda x: F.get("terms", x["place"] - first) == x["other"]))
    exact = (first >= 0) & (in_place == n)
    both = both.withColumn("exact", exact)
    if slop:
        often = lambda t, at: F.size(F.filter("near", lambda x: (x["other"] == t) & (x["place"] >= at) & (x["place"] < at + n + slop)))
        wanted = lambda t: F.size(F.filter("terms", lambda x: x == t))
        all_in = lambda at: F.forall(F.array_distinct("terms"), lambda t: often(t, at) >= wanted(t))
        every = F.size(F.array_except("terms", F.transform("near", lambda x: x["other"]))) == 0
        both = both.where(F.col("exact") | (every & F.exists(F.sequence(F.col("at") - n - slop + 1, F.col("at")), all_in)))
    else:
        both = both.where("exact")
    return both.select(*_KEYS, "wid", F.when(F.col("exact"), first).alias("start"), F.when(F.col("exact"), n).alias("length"), "exact")


def hit_words(found: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, n_hit): the words that exact matches cover."""
    covered = found.where("exact").select(*_KEYS, F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("place")).distinct()
    return covered.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n_hit"))


def matched_items(found: DataFrame, named: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, exact_items, near_items): sorted item ids; the second are all."""
    windows_of = found.groupBy(*_KEYS, "wid").agg(F.max("exact").alias("exact"))
    items_of = windows_of.join(small_side(named), "wid", "left").groupBy(*_KEYS, "item_id").agg(F.max("exact").alias("exact"))
    return items_of.groupBy(*_KEYS).agg(F.array_sort(F.collect_list(F.when(F.col("exact"), F.col("item_id")))).alias("exact_items"), F.array_sort(F.collect_list("item_id")).alias("near_items"))


def report_near(docs: DataFrame, items: DataFrame, slop: int = SLOP) -> DataFrame:
    """One row for each document: n_words, n_hit, n_items, items_sha256, contaminated; and of proximity matches, exact ones among them, n_near_items, near_items_sha256, near."""
    keyed = with_row_key(docs)
    found, named = windows(items)
    found, _ = write_table(window_matches(keyed, found, slop=slop), "matches")
    hits, _ = write_table(hit_words(found), "hits")
    by_items, _ = write_table(matched_items(found, named), "matched-items")
    out = keyed.select(*_KEYS, F.size(words(F.col("text"))).cast("long").alias("n_words"))
    for more in (hits, by_items):
        both = out.join(small_side(more), same_row(out, more), "left")
        out = both.select(*(out[c] for c in out.columns), *(more[c] for c in more.columns if c not in _KEYS))
    none = F.array().cast("array<string>")
    exact, near, n_hit = F.coalesce("exact_items", none), F.coalesce("near_items", none), F.coalesce("n_hit", F.lit(0).cast("long"))
    digest = lambda listed: F.sha2(F.array_join(listed, ","), 256)
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(exact).cast("long").alias("n_items"), digest(exact).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        F.size(near).cast("long").alias("n_near_items"), digest(near).alias("near_items_sha256"), F.col("near_items").isNotNull().alias("near"),
    )


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The same without proximity matches."""
    return report_near(docs, items, slop=0).drop("n_near_items", "near_items_sha256", "near")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without exact hits, with all their columns."""
    found, _ = windows(items)
    bad, _ = write_table(window_matches(with_row_key(docs), found).select(*_KEYS).distinct(), "contaminated")
    return rows_in(docs, bad, "left_anti")
