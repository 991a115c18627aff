"""Secret scans by one combined deterministic automaton.

All rules are compiled together by subset construction and minimisation into
transition arrays (:mod:`.automaton`). One pass over the bytes of a slice of
documents gives a state for each byte; where no state accepts there is no
secret. Only the stretches around accepting states are looked at again: the same
construction over the reversed rules says in one pass from their ends where a
match begins, and matches are followed from there, leftmost and non-overlapping
for each kind, so that the time grows with the text alone.

Defined results: null text counts as empty and has no spans; an empty table
gives an empty result; repeated rows and rows without a doc_id are scanned like
any other; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbytes as tb
from .workspace import tune


@dataclass(frozen=True)
class Rule:
    """``pattern`` as searched; ``prefix``: what comes before the part that ``least`` counts; ``scan``: a pattern that accepts in every match of ``least`` or more."""

    kind: str
    pattern: str
    least: int
    prefix: str = ""
    scan: str = ""


# The three base kinds and their least lengths.
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
BASE_RULES = (
    Rule("assign", _ASSIGN + r"[A-Za-z0-9+/_.=-]+", 6, prefix=_ASSIGN),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24, scan=r"[0-9a-f]{24}"),
)
#: Kinds beyond the base ones; their spans come on top.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 1),
)
RULES = BASE_RULES + MORE_RULES
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, n_more long, spans string"


class Scanner:
    """Finds the spans of ``rules`` in bytes."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.search = compile_search(rules)
        self.one = [compile_one(r.pattern) for r in rules]
        self.begins = [compile_begins(r.pattern) for r in rules]
        self.prefix = [compile_one(r.prefix) if r.prefix else None for r in rules]

    def regions(self, data: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(start, end, rule bits) of the stretches in which some rule accepts; no match reaches beyond its stretch."""
        if not len(data):
            return
        states = self.search.states(data)
        hits = np.flatnonzero(self.search.accepts[states])
        if not len(hits):
            return
        idle = np.flatnonzero(states == 0)
        after = np.searchsorted(idle, hits)
        starts = np.where(after > 0, idle[np.maximum(after - 1, 0)] + 1, 0) if len(idle) else np.zeros(len(hits), np.int64)
        ends = np.where(after < len(idle), idle[np.minimum(after, len(idle) - 1)], len(data)) if len(idle) else np.full(len(hits), len(data))
        bits = self.search.accepts[states[hits]]
        heads = np.flatnonzero(np.r_[True, starts[1:] != starts[:-1]])
        yield from zip(starts[heads].tolist(), ends[heads].tolist(), np.bitwise_or.reduceat(bits, heads).tolist(), strict=True)

    def spans(self, data: np.ndarray, raw: bytes, start: int, end: int, bits: int) -> list[tuple[int, int, int]]:
        """(start, rule, end) of the matches within a stretch: leftmost, non-overlapping, too short ones dropped."""
        out = []
        for k, rule in enumerate(self.rules):
            if not bits >> k & 1:
                continue
            at, one = start, self.one[k]
            back = self.begins[k]
            for begin in (end - 1 - np.flatnonzero(back.accepts[back.states(data[start:end][::-1])])[::-1]).tolist():
                if begin < at:
                    continue
                at = one.longest(raw, begin, end)
                body = self.prefix[k].longest(raw, begin, at) if self.prefix[k] else begin
                if at - body >= rule.least:
                    out.append((begin, k, at))
        return sorted(out)

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """Row to its spans in byte offsets of that row. Rows are kept apart by a byte that idles every rule."""
        n = len(offsets) - 1
        apart = np.full(len(data) + n, 0x0A, np.uint8)
        moved = offsets + np.arange(n + 1)
        apart[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))] = data
        raw, out = apart.tobytes(), {}
        for start, end, bits in self.regions(apart):
            row = int(np.searchsorted(moved, start, "right")) - 1
            base = int(moved[row])
            out.setdefault(row, []).extend((a - base, k, b - base) for a, k, b in self.spans(apart, raw, start, end, bits))
        return out


@lru_cache(maxsize=8)
def compile_search(rules: tuple[Rule, ...]):
    from .automaton import compile_rules

    found = compile_rules([r.scan or r.pattern for r in rules], search=True)
    if (found.table[:, found.classes[0x0A]] != 0).any():
        raise ValueError("rules must not match across a line feed")
    return found


@lru_cache(maxsize=64)
def compile_one(pattern: str):
    from .automaton import compile_rules

    return compile_rules([pattern], search=False)


@lru_cache(maxsize=64)
def compile_begins(pattern: str):
    """Over bytes from the last to the first: accepts where a match begins."""
    from .automaton import compile_rules

    return compile_rules([pattern], search=True, backwards=True)


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


def _rows(batches: Iterator[pa.RecordBatch], found: Scanner) -> Iterator[tuple[pa.RecordBatch, dict[int, list[tuple[int, int, int]]], np.ndarray, np.ndarray]]:
    for part in tb.slices(batches):
        data, offsets = tb.column_bytes(part.column("text"))
        yield part, found.documents(data, offsets), data, offsets


def _in_chars(spans: list[tuple[int, int, int]], text: bytes) -> list[tuple[int, int, int]]:
    points = sorted({x for a, _, b in spans for x in (a, b)})
    chars = dict(zip(points, tb.char_offsets(text, points), strict=True))
    return [(chars[a], k, chars[b]) for a, k, b in spans]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each secret: doc_id, kind, start, end (code points, end exclusive), value."""
    tune(docs.sparkSession)
    compiled = scanner(rules)  # once, on the driver; its size depends on the rules alone

    def run(batches):
        for part, found, data, offsets in _rows(batches, compiled):
            ids, rows = part.column("doc_id"), []
            for row, spans in found.items():
                text = data[offsets[row] : offsets[row + 1]].tobytes()
                spans = sorted(spans)
                for (a, k, b), (x, _, y) in zip(_in_chars(spans, text), spans, strict=True):
                    rows.append((ids[row].as_py(), rules[k].kind, a, b, text[x:y].decode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "kind", "start", "end", "value"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, kind string, start long, end long, value string")


def redact_secrets(docs: DataFrame, mask: str = "[secret:{kind}]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with every secret replaced; overlapping spans are replaced as one, named after the first. Other columns stay; null text stays null."""
    tune(docs.sparkSession)
    compiled = scanner(rules)  # once, on the driver; its size depends on the rules alone

    def run(batches):
        for part, found, data, offsets in _rows(batches, compiled):
            if found:
                texts = part.column("text").to_pylist()
                for row, spans in found.items():
                    raw, out, last = data[offsets[row] : offsets[row + 1]].tobytes(), [], 0
                    merged: list[list[int]] = []
                    for a, k, b in sorted(spans):
                        if merged and a < merged[-1][2]:
                            merged[-1][2] = max(merged[-1][2], b)
                        else:
                            merged.append([a, k, b])
                    for a, k, b in merged:
                        out += [raw[last:a], mask.format(kind=rules[k].kind).encode()]
                        last = b
                    texts[row] = b"".join([*out, raw[last:]]).decode("utf-8", "replace")
                i = part.schema.get_field_index("text")
                part = part.set_column(i, part.schema.field(i), pa.array(texts, part.schema.field(i).type))
            yield part

    return docs.mapInArrow(run, docs.schema)


def scan_digests(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each document: counts of the base kinds and of the further ones, the digest of the base spans, and all spans as text."""
    tune(docs.sparkSession)
    compiled = scanner(rules)
    base = {r.kind for r in BASE_RULES}
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for part, found, data, offsets in _rows(batches, compiled):
            n = part.num_rows
            counts = np.zeros((n, len(rules)), np.int64)
            digests, texts = [nothing] * n, [""] * n
            for row, spans in found.items():
                named = [(rules[k].kind, f"{rules[k].kind}:{a}:{b}") for a, k, b in _in_chars(sorted(spans), data[offsets[row] : offsets[row + 1]].tobytes())]
                for _, k, _ in spans:
                    counts[row, k] += 1
                texts[row] = ",".join(x for _, x in named)
                digests[row] = hashlib.sha256(",".join(x for kind, x in named if kind in base).encode()).hexdigest()
            of = {r.kind: counts[:, k] for k, r in enumerate(rules)}
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(of["assign"]), pa.array(of["access"]), pa.array(of["hex"]), pa.array(digests), pa.array(sum((v for k, v in of.items() if k not in base), np.zeros(n, np.int64))), pa.array(texts)],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "n_more", "spans"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)
