"""Similarity join of word n-gram sets at an exact Jaccard threshold, by a prefix-tree join.

A document's set holds its distinct 5-word shingles (the whole sequence for
shorter ones), as 64-bit hashes in one global order: ordinary shingles by hash,
then those that a mergeable frequency summary over the whole corpus calls
frequent, rarer first. Two sets that reach the threshold t share at least l
elements among the first n - ceil(t n) + l of each, for any l; prefixes here
take l = n / 8, so sets of linked documents share many of them.

1. One pass gives each document's set size and 128-bit set fingerprint, so that
   equal sets are one class, and the frequency summary.
2. Prefix elements are shuffled; a stream over each sorted partition links every
   class that shares an element to the smallest such class, its leader. All
   classes with a leader in common form a block: any two that share a prefix
   element meet in the block of that element's leader. A class with too few
   shared elements for any link leaves; others leave the blocks in which they
   share least, as long as fewer elements are lost than a link has to share.
3. In a block the sets are stored in a trie. A probe walks it level by level,
   sharing the overlap of common prefixes, and prunes subtrees that cannot reach
   the required overlap with what remains of both sets. Once a probe has joined
   sets into one component, only sets outside the largest one probe on: the
   links left out lie within a component.
4. Blocks of more than ``BLOCK_SETS`` sets or ``BLOCK_ELEMENTS`` elements are
   dealt into parts, each with the leader in it, and joined part by part first.
   Near copies mostly end in the leader's component; only sets outside it, if
   there are any, then meet all parts of their block.
5. The links, as stars, give connected components.

Pairs are never written out one by one, and no set, fingerprint or link reaches
the driver; only the frequent shingles do, at most ``FREQUENT`` of them.

Defined results: null or empty texts have the empty set and stand alone; equal
texts are linked; repeated rows get equal results; a null doc_id takes part in
links but never names a component (null where all are null); an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .components import components
from .workspace import rows_in, same_row, tune, with_row_key, write_table

SHINGLE = 5
# The threshold 3/4 as a fraction.
NUMERATOR, DENOMINATOR = 3, 4
#: At most so many shingles are called frequent; and none below so many occurrences.
FREQUENT, LEAST_FREQUENT = 1_000_000, 32
#: Counters of the frequency summary in each task.
COUNTERS = 1 << 18
#: A task joins at most two such parts at once.
BLOCK_SETS, BLOCK_ELEMENTS = 128, 4 << 20
#: Rows of one leader are spread over so many keys where they are joined.
SALTS = 8
_SEED, HIGH = 21, np.uint64(1 << 63)


#: Prefixes are longer than needed by this part of the set: links then share as many elements.
SPARE = 8


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - -(-NUMERATOR * n // DENOMINATOR) + np.maximum(1, n // SPARE)


def required(n: int, m: np.ndarray) -> np.ndarray:
    """Least intersection of sets of n and m elements at the threshold."""
    return -(-NUMERATOR * (n + m) // (NUMERATOR + DENOMINATOR))


def shingle_sets(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets by row): the distinct shingles of each row, ascending."""
    data, offsets = tb.column_bytes(part.column("text"))
    data = tb.LOWER[data]
    hasher = tb.Hasher(_SEED)
    starts, ends, first = tb.word_bounds(data, offsets)
    words = hasher.words(data, starts, ends)
    rows, at = tb.window_rows(first, SHINGLE)
    found = hasher.windows(words, SHINGLE)[at]
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        whole = np.array([hasher.windows(words[first[r] : first[r + 1]], int(counts[r]))[0] for r in short], np.uint64)
        rows, found = np.r_[rows, short], np.r_[found, whole]
    order = np.lexsort((found, rows))
    rows, found = rows[order], found[order]
    keep = np.r_[True, (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])] if len(rows) else np.zeros(0, bool)
    rows, found = rows[keep], found[keep]
    return found, np.searchsorted(rows, np.arange(part.num_rows + 1))


def fingerprints(found: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """16 bytes for each set, independent of order."""
    out = np.zeros((len(offsets) - 1, 2), np.uint64)
    for i, c in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
        sums = np.r_[np.zeros(1, np.uint64), np.cumsum(tb.mix(found * np.uint64(c | 1) + np.uint64(i + 1)))]
        out[:, i] = tb.mix(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(np.uint64))
    return out


def _binary(prints: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(prints.astype(">u8"))
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(np.arange(0, 16 * len(raw) + 1, 16, dtype=np.int32)), pa.py_buffer(raw)])


class Frequent:
    """A Misra-Gries summary: counts are low by at most the number of elements over ``counters``."""

    def __init__(self, counters: int = COUNTERS):
        self.most, self.waiting, self.n = counters, [], 0
        self.tokens, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, tokens: np.ndarray) -> None:
        self.waiting.append(tokens)
        self.n += len(tokens)
        if self.n >= 4 * self.most:
            self.merge()

    def merge(self) -> None:
        fresh, n = np.unique(np.concatenate(self.waiting), return_counts=True) if self.waiting else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        both = np.concatenate([self.tokens, fresh])
        tokens, at = np.unique(both, return_inverse=True)
        counts = np.bincount(at, np.concatenate([self.counts, n]), len(tokens)).astype(np.int64)
        if len(tokens) > self.most:
            counts -= np.partition(counts, len(counts) - self.most - 1)[len(counts) - self.most - 1]
        self.tokens, self.counts, self.waiting, self.n = tokens[counts > 0], counts[counts > 0], [], 0


_SURVEY = "doc_id long, k1 long, k2 int, print binary, n_shingles long, shingle long, weight long"
_KEYS = ("doc_id", "k1", "k2")


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document; behind them a row for each shingle that the task has seen often."""
    summary = Frequent()
    names = [x.split()[0] for x in _SURVEY.split(", ")]
    for part in tb.slices(batches):
        found, offsets = shingle_sets(part)
        summary.add(found)
        none = pa.nulls(part.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([*(part.column(k) for k in _KEYS), _binary(fingerprints(found, offsets)), pa.array(np.diff(offsets)), none, none], names=names)
    summary.merge()
    often = summary.counts >= 4
    n = int(often.sum())
    yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.array(summary.tokens[often].view(np.int64)), pa.array(summary.counts[often])], names=names)


def _coded(found: np.ndarray, offsets: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Elements in the global order, ascending within each set: hash / 2, or 2**63 plus the rank of a frequent one."""
    codes = found >> np.uint64(1)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        known = frequent[at] == found
        codes = np.where(known, HIGH | rank[at], codes)
        rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        codes = codes[np.lexsort((codes, rows))]
    return codes


def _prefixes(frequent: np.ndarray, rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, None] = {}
        for part in tb.slices(batches):
            found, offsets = shingle_sets(part)
            prints = fingerprints(found, offsets)
            codes = _coded(found, offsets, frequent, rank)
            n = np.diff(offsets)
            take = np.where(n > 0, prefix_length(n), 0)
            for i, key in enumerate(map(bytes, prints.view(np.uint8).reshape(len(n), 16))):  # a set that this task has sent is not sent again
                if key in seen:
                    take[i] = 0
                seen[key] = None
            if len(seen) > 50_000:
                seen.clear()
            rows = np.repeat(np.arange(len(n)), take)
            at = np.arange(len(rows)) - np.repeat(np.cumsum(take) - take, take) + offsets[:-1][rows]
            yield pa.RecordBatch.from_arrays([pa.array(codes[at].view(np.int64)), pa.array(prints[rows, 0].view(np.int64)), pa.array(prints[rows, 1].view(np.int64))], names=["code", "p", "q"])

    return run


def _leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (code, p, q): (leader, member, shared) for the sets of each code that several have; the leader is the first and a member too."""
    tb.release()
    last, waiting, n = None, [], 0  # last: code, leader's p and q, whether it has been counted, last p and q

    def flush():
        pairs, at = np.unique(np.concatenate([x[:, :4] for x in waiting]), axis=0, return_inverse=True)
        shared = np.bincount(at.ravel(), np.concatenate([x[:, 4] for x in waiting]), len(pairs)).astype(np.int64)
        return pa.RecordBatch.from_arrays([_binary(pairs[:, :2].view(np.uint64)), _binary(pairs[:, 2:].view(np.uint64)), pa.array(shared)], names=["leader", "member", "shared"])

    for batch in batches:
        if not batch.num_rows:
            continue
        code, p, q = (c.to_numpy() for c in batch.columns)
        new = np.r_[last is None or code[0] != last[0], code[1:] != code[:-1]]
        head = np.maximum.accumulate(np.where(new, np.arange(len(code)), -1))
        lead_p, lead_q = p[head], q[head]
        if head[0] < 0:
            lead_p[head < 0], lead_q[head < 0] = last[1], last[2]
        again = np.r_[head[0] < 0 and p[0] == last[4] and q[0] == last[5], (p[1:] == p[:-1]) & (q[1:] == q[:-1]) & ~new[1:]]
        other = ((lead_p != p) | (lead_q != q)) & ~again
        rows = np.flatnonzero(other)
        first = rows[np.r_[True, head[rows[1:]] != head[rows[:-1]]]] if len(rows) else rows
        if len(first) and head[first[0]] < 0 and last[3]:
            first = first[1:]
        counted = bool(other[head == head[-1]].any()) or bool(head[-1] < 0 and last[3])
        last = (code[-1], lead_p[-1], lead_q[-1], counted, p[-1], q[-1])
        if len(rows):
            one = np.column_stack([lead_p[rows], lead_q[rows], p[rows], q[rows]])
            two = np.column_stack([lead_p[first], lead_q[first], lead_p[first], lead_q[first]])
            pairs, shared = np.unique(np.concatenate([one, two]), axis=0, return_counts=True)
            waiting.append(np.column_stack([pairs, shared]))
            n += len(pairs)
            if n > 200_000:
                yield flush()
                waiting, n = [], 0
    if waiting:
        yield flush()


class Trie:
    """Sets in ascending order of elements, stored by common prefixes; nodes are in depth-first order."""

    def __init__(self, sets: list[np.ndarray]):
        keys = [s.astype(">u8").tobytes() for s in sets]
        self.order = np.array(sorted(range(len(sets)), key=keys.__getitem__))
        ordered = [sets[i] for i in self.order]
        self.size = np.array([len(s) for s in ordered])
        base = np.r_[0, np.cumsum(self.size)]
        self.tokens = np.concatenate(ordered)
        common = [0] * (len(ordered) + 1)
        for i in range(1, len(ordered)):
            m = min(len(ordered[i - 1]), len(ordered[i]))
            differ = ordered[i - 1][:m] != ordered[i][:m]
            k = int(differ.argmax())
            common[i] = k if differ[k] else m
        # Nodes as [depth where the edge begins, depth where it ends, first set, one past the last set].
        nodes: list[list[int]] = []
        children: dict[int, list[int]] = {-1: []}
        stack: list[tuple[int, int]] = []  # (depth, node) of the open path

        def split(depth: int, i: int) -> None:
            """Close what is deeper than ``depth``; an edge that passes it becomes two."""
            while stack and nodes[stack[-1][1]][0] >= depth:
                nodes[stack.pop()[1]][3] = i
            if stack and nodes[stack[-1][1]][1] > depth:
                k = stack[-1][1]
                nodes.append([depth, nodes[k][1], nodes[k][2], i])
                tail = len(nodes) - 1
                children[tail] = children[k]
                children[k] = [tail]
                nodes[k][1] = depth

        for i in range(len(ordered)):
            split(common[i], i)
            nodes.append([common[i], int(self.size[i]), i, i + 1])
            k = len(nodes) - 1
            children[k] = []
            children[stack[-1][1] if stack else -1].append(k)
            stack.append((common[i], k))
        while stack:
            nodes[stack.pop()[1]][3] = len(ordered)
        table = np.array(nodes)
        self.begin, self.end, self.low, self.high = table.T
        self.at = base[self.low]
        self.kids = {k: np.array(v) for k, v in children.items() if v}
        self.leaf = np.array([self.low[k] if self.size[self.low[k]] == self.end[k] else -1 for k in range(len(nodes))])
        self.least = np.minimum.reduceat(np.r_[self.size, 1 << 40], np.column_stack([self.low, self.high]).ravel())[::2]
        self.most = np.maximum.reduceat(np.r_[self.size, 0], np.column_stack([self.low, self.high]).ravel())[::2]

    def probe(self, x: np.ndarray, open_sets: np.ndarray, step: int = 96) -> np.ndarray:
        """Sets (in trie order) with ``open_sets`` true that reach the threshold with x."""
        n, linked = len(x), []
        opened = np.r_[0, np.cumsum(open_sets)]
        node = self.kids[-1]
        overlap = np.zeros(len(node), np.int64)
        depth = self.begin[node]
        while len(node):
            live = (opened[self.high[node]] > opened[self.low[node]]) & (DENOMINATOR * self.most[node] >= NUMERATOR * n) & (NUMERATOR * self.least[node] <= DENOMINATOR * n)
            node, overlap, depth = node[live], overlap[live], depth[live]
            take = np.minimum(self.end[node] - depth, step)
            some = np.flatnonzero(take > 0)
            left = np.full(len(node), n)
            if len(some):
                t = take[some]
                ends = np.cumsum(t)
                where = np.arange(ends[-1]) - np.repeat(ends - t, t) + np.repeat(self.at[node[some]] + depth[some], t)
                tokens = self.tokens[where]
                place = np.searchsorted(x, tokens)
                hit = x[np.minimum(place, n - 1)] == tokens
                overlap[some] += np.add.reduceat(hit.astype(np.int64), ends - t)
                left[some] = n - place[ends - 1] - hit[ends - 1]
            depth = depth + take
            need = required(n, self.least[node])
            able = overlap + np.minimum(left, self.most[node] - depth) >= need
            node, overlap, depth = node[able], overlap[able], depth[able]
            done = depth == self.end[node]
            ended = node[done]
            leaf = self.leaf[ended]
            full = (leaf >= 0) & (overlap[done] >= required(n, self.size[np.maximum(leaf, 0)]))
            linked.append(leaf[full])
            down = [(self.kids[k], o) for k, o in zip(ended.tolist(), overlap[done].tolist(), strict=True) if k in self.kids]
            node, overlap, depth = (
                np.concatenate([node[~done], *(k for k, _ in down)]),
                np.concatenate([overlap[~done], *(np.full(len(k), o) for k, o in down)]),
                np.concatenate([depth[~done], *(self.begin[k] for k, _ in down)]),
            )
        found = np.concatenate(linked) if linked else np.zeros(0, np.int64)
        return found[open_sets[found]]


def block_links(sets: list[np.ndarray], known: np.ndarray | None = None, probing: np.ndarray | None = None) -> np.ndarray:
    """The component of each set of a block, named by one of its members; every link of the block lies within one.

    ``known``: labels of components that are known before. ``probing``: only
    links with one of these sets are asked for, and all of them probe.
    """
    trie = Trie(sets)
    n = len(sets)
    part = np.arange(n)
    if known is not None:
        _, first, label = np.unique(known[trie.order], return_index=True, return_inverse=True)
        part = first[label]
    count = np.bincount(part, minlength=n)
    todo = np.ones(n, bool) if probing is None else probing[trie.order]
    at = 0
    while True:
        waiting = todo & (part != int(count.argmax())) if probing is None else todo
        if not waiting.any():
            break
        if not waiting[at]:
            at = int(waiting.argmax())
        todo[at] = False
        found = trie.probe(sets[trie.order[at]], part != part[at])
        for other in np.unique(part[found]).tolist():
            a, b = int(part[at]), other
            if count[a] < count[b]:
                a, b = b, a
            count[a] += count[b]
            count[b] = 0
            part[part == b] = a
    out = np.empty(n, np.int64)
    out[trie.order] = trie.order[part]
    return out


def _join_blocks(frequent: np.ndarray, rank: np.ndarray):
    """Rows (leader, i, j, root, probe, text) sorted by block to links (a, b): a set and the least one of its component in the block. Without a root all sets probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, {}

        def links():
            prints = list(members)
            if len(prints) < 2:
                return []
            sets, roots, probes = zip(*members.values(), strict=True)
            if roots[0] is None:
                component = block_links(list(sets))
            else:
                component = block_links(list(sets), np.unique(np.array(roots), return_inverse=True)[1], np.array(probes))
            least: dict[int, bytes] = {}
            for p, r in zip(prints, component.tolist(), strict=True):
                least[r] = min(p, least.get(r, p))
            return [(least[r], p) for p, r in zip(prints, component.tolist(), strict=True) if least[r] != p]

        def batch_of(pairs):
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], pa.binary()) for i in (0, 1)], names=["a", "b"])

        for part in tb.slices(batches):
            found, offsets = shingle_sets(part)
            codes = _coded(found, offsets, frequent, rank)
            prints = fingerprints(found, offsets).astype(">u8").view(np.uint8).reshape(-1, 16)
            out = []
            rows = zip(*(part.column(c).to_pylist() for c in ("leader", "i", "j", "root", "probe")), strict=True)
            for r, (*block, root, probe) in enumerate(rows):
                if block != key:
                    out += links()
                    key, members = block, {}
                p = prints[r].tobytes()
                members[p] = (codes[offsets[r] : offsets[r + 1]], root, probe or (p in members and members[p][2]))
            yield batch_of(out)
        yield batch_of(links())

    return run


def surveyed(keyed: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(a row for each document, frequent shingles ascending, their rank by count)."""
    survey, _ = write_table(keyed.mapInArrow(_survey, _SURVEY), "survey")
    each = survey.where("shingle IS NULL").select(*_KEYS, "print", "n_shingles")
    total = each.agg(F.sum("n_shingles")).first()[0] or 0
    least = max(LEAST_FREQUENT, -(-total // FREQUENT))  # so at most FREQUENT shingles are frequent
    often = survey.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("weight").alias("n")).where(F.col("n") >= least).toPandas()
    tokens = often["shingle"].to_numpy(np.int64).view(np.uint64)
    by_count = np.lexsort((tokens, often["n"].to_numpy(np.int64)))
    rank = np.empty(len(tokens), np.uint64)
    rank[by_count] = np.arange(len(tokens), dtype=np.uint64)
    ascending = np.argsort(tokens)
    return each, tokens[ascending], rank[ascending]


def memberships(shared: DataFrame, sizes: DataFrame) -> DataFrame:
    """(leader, member, n) that links may need.

    ``shared``: (leader, member, shared), the number of the member's prefix
    elements under that leader; ``sizes``: (print, n). A link shares at least
    least = max(1, t n / SPARE) prefix elements, whichever of its two sets n is
    of. So a member with fewer shared elements leaves, and a member may leave
    its least blocks while it loses at most (least - 1) / 2 elements by that.
    """
    all_of = shared.groupBy("leader", "member").agg(F.sum("shared").alias("shared"))
    known = all_of.join(sizes, all_of["member"] == sizes["print"]).withColumn("least", F.greatest(F.lit(1), F.floor(F.col("n") * NUMERATOR / (DENOMINATOR * SPARE))))
    own = Window.partitionBy("member")
    known = known.withColumn("total", F.sum("shared").over(own)).withColumn("lost", F.sum("shared").over(own.orderBy("shared", "leader").rowsBetween(Window.unboundedPreceding, 0)))
    return known.where((F.col("total") >= F.col("least")) & (2 * F.col("lost") > F.col("least") - 1)).select("leader", "member", "n")


def by_leader(rows: DataFrame, leaders: DataFrame) -> DataFrame:
    """``rows`` (leader, member, ...) joined with a row for each leader, spread by member: a leader may have a third of all rows."""
    salt = F.pmod(F.xxhash64("member"), F.lit(SALTS)).cast("int")
    each = leaders.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", salt).join(each, ["leader", "salt"]).drop("salt")


def parts_by_leader(rows: DataFrame, name: str) -> DataFrame:
    """(leader, ``name``): the number of parts that rows (leader, member, n) are dealt into; none for a single row."""
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_ELEMENTS)).cast("int")
    return rows.groupBy("leader").agg(F.count(F.lit(1)).alias("sets"), parts.alias(name)).select("leader", name, "sets")


def dealt_blocks(pairs: DataFrame) -> DataFrame:
    """(leader, member, n) to (leader, member, n, parts, part); blocks of one go."""
    sizes = parts_by_leader(pairs, "parts").where("sets > 1").drop("sets")
    return by_leader(pairs, sizes).withColumn("part", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int"))


def first_blocks(dealt: DataFrame) -> DataFrame:
    """(leader, i, j, member, root, probe): each part on its own, with the leader in it where there are several."""
    several = dealt.where("parts > 1").select("leader", "parts").distinct()
    hubs = several.select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("leader").alias("member"))
    rows = dealt.select("leader", "part", "member").unionByName(hubs)
    return rows.select("leader", F.col("part").alias("i"), F.col("part").alias("j"), "member", F.lit(None).cast("binary").alias("root"), F.lit(True).alias("probe"))


def second_blocks(big: DataFrame, roots: DataFrame) -> DataFrame:
    """The same for the sets of divided blocks that are not in their leader's component: parts of them with every part of their block."""
    own = F.coalesce("root", "member")
    named = big.join(roots, big["member"] == roots["v"], "left").select("leader", "member", "n", "parts", "part", own.alias("root"))
    hubs = big.select("leader").distinct().join(roots, F.col("leader") == F.col("v"), "left").select("leader", F.coalesce("root", "leader").alias("hub"))
    named, _ = write_table(by_leader(named, hubs).withColumn("out", F.col("root") != F.col("hub")).drop("hub"), "rooted")
    others = named.where("out")
    met = by_leader(named, parts_by_leader(others, "other_parts").drop("sets"))
    other = F.pmod(F.xxhash64("member"), F.col("other_parts")).cast("int")
    inner = met.select("leader", F.col("part").alias("i"), F.explode(F.sequence(F.lit(0), F.col("other_parts") - 1)).alias("j"), "member", "root", F.lit(False).alias("probe"))
    outer = met.where("out").select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), other.alias("j"), "member", "root", F.lit(True).alias("probe"))
    return inner.unionByName(outer)


def class_texts(keyed: DataFrame, each: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` with the text of one document of each class, a written table: the texts are read and shuffled just once."""
    classes = each.groupBy("print").agg(F.min(F.struct(*_KEYS)).alias("one"))
    placed = members.join(classes, members["member"] == classes["print"]).select(*members.columns, F.col("one.doc_id").alias("doc_id"), F.col("one.k1").alias("k1"), F.col("one.k2").alias("k2"))
    placed, _ = write_table(placed, "placed")
    # One strategy at every size: a plan that broadcasts small tables only would hide what large ones cost.
    return write_table(keyed.join(placed.hint("merge"), same_row(keyed, placed)).select(*members.columns, keyed["text"]), "block-texts")[0]


def joined_blocks(rows: DataFrame, frequent: np.ndarray, rank: np.ndarray) -> DataFrame:
    """(a, b): the links of blocks, whose sets are made anew from the texts."""
    rows = rows.select("leader", "i", "j", "root", "probe", "text")
    blocks = rows.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j")
    return write_table(blocks.mapInArrow(_join_blocks(frequent, rank), "a binary, b binary").distinct(), "links")[0]


def linked_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row for each document with its set fingerprint, (v, root) of the fingerprints in links)."""
    tune(docs.sparkSession)
    keyed = with_row_key(docs)
    each, frequent, rank = surveyed(keyed)
    rows = keyed.select("text").mapInArrow(_prefixes(frequent, rank), "code long, p long, q long")
    pairs = rows.repartition("code").sortWithinPartitions("code", "p", "q").mapInArrow(_leaders, "leader binary, member binary, shared long")
    sizes = each.groupBy("print").agg(F.max("n_shingles").alias("n"))
    pairs, _ = write_table(memberships(pairs, sizes), "leaders")
    dealt, _ = write_table(dealt_blocks(pairs), "blocks")
    texts = class_texts(keyed, each, first_blocks(dealt))
    links = joined_blocks(texts, frequent, rank)
    roots = components(links)
    big = dealt.where("parts > 1")
    if not big.isEmpty():
        text_of = texts.select("member", "text").dropDuplicates(["member"])
        more = joined_blocks(second_blocks(big, roots).join(text_of, "member"), frequent, rank)
        roots = components(links.unionByName(more))
    return each, roots


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2, n_shingles, component_id and ``first``: the row (doc_id, k1, k2) that stands for its component."""
    each, roots = linked_classes(docs)
    classes = each.where("n_shingles > 0").groupBy("print").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct(*_KEYS))).alias("one"), F.min(F.struct(*_KEYS)).alias("any"))
    named = classes.join(roots, classes["print"] == roots["v"], "left").select("print", F.coalesce("root", "print").alias("root"), F.coalesce("one", "any").alias("one"))
    first = named.groupBy("root").agg(F.coalesce(F.min(F.when(F.col("one.doc_id").isNotNull(), F.col("one"))), F.min("one")).alias("first"))
    of_class = named.join(first, "root").select(F.col("print").alias("of"), "first")
    out = each.join(of_class, (each["print"] == of_class["of"]) & (each["n_shingles"] > 0), "left")
    own = F.struct(*_KEYS)
    return out.select(*_KEYS, "n_shingles", F.coalesce(F.col("first.doc_id"), F.when(F.col("first").isNull(), F.col("doc_id"))).alias("component_id"), F.coalesce("first", own).alias("first"))


def report(docs: DataFrame) -> DataFrame:
    """One row for each document: n_shingles and component_id, the smallest doc_id reachable by links."""
    return grouped(docs).select("doc_id", "n_shingles", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component, its smallest doc_id, with all columns; documents without words all stay but for exact repetitions."""
    kept = grouped(docs).select("first.doc_id", "first.k1", "first.k2").distinct()
    return rows_in(docs, kept, "left_semi", merge=True, once=True)
