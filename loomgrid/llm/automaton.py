"""Regular expressions to one minimal deterministic automaton, and its simulation over bytes in numpy.

The compiler takes a byte regex dialect: literals, ``\\xHH`` and escaped
characters, classes with ranges, groups, ``(?i:...)``, ``|``, and the
quantifiers ``? * + {m} {m,} {m,n}``. Thompson construction per rule, subset
construction over all rules together, Moore's partition refinement, and byte
classes give transition arrays; each state knows the rules that end in it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class _Parser:
    def __init__(self, pattern: str):
        self.p, self.i, self.edges, self.eps, self.n = pattern, 0, [], [], 0

    def node(self) -> int:
        self.edges.append([])
        self.eps.append([])
        self.n += 1
        return self.n - 1

    def alternatives(self, fold: bool):
        parts = [self.sequence(fold)]
        while self.i < len(self.p) and self.p[self.i] == "|":
            self.i += 1
            parts.append(self.sequence(fold))
        return ("alt", parts)

    def sequence(self, fold: bool):
        parts = []
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            parts.append(self.quantified(fold))
        return ("seq", parts)

    def quantified(self, fold: bool):
        item = self.atom(fold)
        while self.i < len(self.p) and self.p[self.i] in "?*+{":
            c = self.p[self.i]
            if c == "{":
                end = self.p.index("}", self.i)
                low, comma, high = self.p[self.i + 1 : end].partition(",")
                self.i = end + 1
                item = ("rep", item, int(low), (int(high) if high else None) if comma else int(low))
            else:
                self.i += 1
                item = ("rep", item, int(c == "+"), 1 if c == "?" else None)
        return item

    def escaped(self) -> int:
        c = self.p[self.i]
        if c == "x":
            self.i += 3
            return int(self.p[self.i - 2 : self.i], 16)
        self.i += 1
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def atom(self, fold: bool):
        c = self.p[self.i]
        self.i += 1
        if c == "(":
            if self.p.startswith("?i:", self.i):
                self.i, fold = self.i + 3, True
            elif self.p.startswith("?:", self.i):
                self.i += 2
            inner = self.alternatives(fold)
            self.i += 1
            return inner
        if c == "[":
            return ("set", self._fold(self.klass(), fold))
        return ("set", self._fold({self.escaped()} if c == "\\" else set(c.encode()), fold))

    def klass(self) -> set[int]:
        negated = self.p[self.i] == "^"
        self.i += negated
        out: set[int] = set()
        while self.p[self.i] != "]":
            low = self._one()
            if self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                out |= set(range(low, self._one() + 1))
            else:
                out.add(low)
        self.i += 1
        return set(range(256)) - out if negated else out

    def _one(self) -> int:
        c = self.p[self.i]
        self.i += 1
        return self.escaped() if c == "\\" else ord(c)

    @staticmethod
    def _fold(s: set[int], fold: bool) -> set[int]:
        return s | {b ^ 0x20 for b in s if chr(b).isascii() and chr(b).isalpha()} if fold else s

    def build(self, item, start: int) -> int:
        """Add ``item`` behind node ``start``; return its end node."""
        kind = item[0]
        if kind == "set":
            end = self.node()
            self.edges[start].append((item[1], end))
            return end
        if kind == "seq":
            for part in item[1]:
                start = self.build(part, start)
            return start
        if kind == "alt":
            end = self.node()
            for part in item[1]:
                inner = self.node()
                self.eps[start].append(inner)
                self.eps[self.build(part, inner)].append(end)
            return end
        _, inner, low, high = item
        for _ in range(low):
            start = self.build(inner, start)
        if high is None:
            loop = self.node()
            self.eps[start].append(loop)
            self.eps[self.build(inner, loop)].append(loop)
            return loop
        end = self.node()
        self.eps[start].append(end)
        for _ in range(high - low):
            start = self.build(inner, start)
            self.eps[start].append(end)
        return end


@dataclass
class Automaton:
    """``table[state, byte class]``; ``accepts[state]`` has a bit for each rule; state 0 is the start; ``dead`` leads nowhere (or -1)."""

    table: np.ndarray
    classes: np.ndarray
    accepts: np.ndarray
    dead: int

    def __post_init__(self):
        self.table = self.table.astype(np.int32)
        self.rows = self.table.tolist()
        self.byte_class = self.classes.tolist()
        self.ends = self.accepts.tolist()

    def __reduce__(self):
        return Automaton, (self.table, self.classes, self.accepts, self.dead)

    def longest(self, data: bytes, at: int, end: int, bit: int = 1) -> int:
        """End of the longest match that starts at ``at``, or -1."""
        state, best = 0, -1
        rows, classes, ends, dead = self.rows, self.byte_class, self.ends, self.dead
        for i in range(at, end):
            state = rows[state][classes[data[i]]]
            if state == dead:
                break
            if ends[state] & bit:
                best = i + 1
        return best

    def states(self, data: np.ndarray, lane: int = 256) -> np.ndarray:
        """The state after each byte, from the start state, for any length.

        The bytes are cut into lanes that advance together. Each lane but the
        first guesses that it begins in the start state; lanes whose guess
        turns out wrong are run again until all agree with their predecessor;
        a few of them one after the other, each as far as its states differ.
        """
        n, k, few = len(data), self.table.shape[1], 8
        lanes = max(1, -(-n // lane))
        cls = np.zeros(lanes * lane, np.int32)
        cls[:n] = self.classes[data]
        steps = np.ascontiguousarray(cls.reshape(lanes, lane).T)
        flat = (self.table.astype(np.int32) * k).ravel()
        out = np.empty((lane, lanes), np.int32)
        begin, todo = np.zeros(lanes, np.int32), np.arange(lanes)
        while len(todo):
            if len(todo) <= few < lanes:
                self._follow(out, begin, todo.tolist(), cls.reshape(lanes, lane), k)
                break
            whole = len(todo) == lanes
            state = begin[todo]
            for t in range(lane):
                state = flat[state + (steps[t] if whole else steps[t, todo])]
                if whole:
                    out[t] = state
                else:
                    out[t, todo] = state
            right = np.zeros(lanes, np.int32)
            right[1:] = out[-1, :-1]
            todo = np.flatnonzero(right != begin)
            if len(todo) > few or lanes <= few:
                begin = right
        return (out.T.ravel()[:n]) // k

    def _follow(self, out: np.ndarray, begin: np.ndarray, todo: list[int], steps: np.ndarray, k: int) -> None:
        """Correct ``out`` from the wrong lanes on, byte by byte; ``begin`` has the states that the lanes were run from."""
        rows, lanes, done = self.rows, len(begin), -1
        for first in todo:
            if first <= done:
                continue
            at, state = first, int(out[-1, first - 1]) // k
            while True:
                begin[at] = state * k
                for t, c in enumerate(steps[at].tolist()):
                    state = rows[state][c]
                    out[t, at] = state * k
                done, at = at, at + 1
                if at == lanes or begin[at] == state * k:
                    break


def _backwards(nfa: _Parser, root: int, accept: dict[int, int]) -> tuple[int, dict[int, int]]:
    """Turn all edges round; the new root leads to the former ends, and the beginnings of the patterns accept."""
    edges, eps = [[] for _ in range(nfa.n + 1)], [[] for _ in range(nfa.n + 1)]
    for a in range(nfa.n):
        for s, b in nfa.edges[a]:
            edges[b].append((s, a))
        for b in nfa.eps[a]:
            if a != root:
                eps[b].append(a)
    eps[nfa.n] = list(accept)
    begins = {start: 1 << bit for bit, start in enumerate(nfa.eps[root])}
    nfa.edges, nfa.eps, nfa.n = edges, eps, nfa.n + 1
    return nfa.n - 1, begins


def compile_rules(patterns: list[str], search: bool, backwards: bool = False) -> Automaton:
    """One automaton for all patterns; ``search``: matches may start at any byte; ``backwards``: for bytes that come last first."""
    nfa = _Parser("")
    root = nfa.node()
    accept: dict[int, int] = {}
    for bit, pattern in enumerate(patterns):
        nfa.p, nfa.i = pattern, 0
        start = nfa.node()
        nfa.eps[root].append(start)
        end = nfa.build(nfa.alternatives(False), start)
        accept[end] = accept.get(end, 0) | 1 << bit
    if backwards:
        root, accept = _backwards(nfa, root, accept)
    if search:
        nfa.edges[root].append((set(range(256)), root))

    classes = np.zeros(256, np.int64)
    for s in {frozenset(s) for out in nfa.edges for s, _ in out}:
        member = np.zeros(256, np.int64)
        member[list(s)] = 1
        classes = np.unique(classes * 2 + member, return_inverse=True)[1].astype(np.int64)
    k = int(classes.max()) + 1
    sample = [int(np.flatnonzero(classes == c)[0]) for c in range(k)]

    def closure(nodes: set[int]) -> frozenset[int]:
        stack, seen = list(nodes), set(nodes)
        while stack:
            for x in nfa.eps[stack.pop()]:
                if x not in seen:
                    seen.add(x)
                    stack.append(x)
        return frozenset(x for x in seen if nfa.edges[x] or x in accept)

    moves = [[{to for s, to in out if b in s} for b in sample] for out in nfa.edges]
    first = closure({root})
    index, order, rows, ends = {first: 0}, [first], [], []
    for states in order:
        ends.append(sum({accept.get(x, 0) for x in states}) if len(patterns) == 1 else _union(accept.get(x, 0) for x in states))
        row = []
        for c in range(k):
            to = closure(set().union(*(moves[x][c] for x in states)))
            if to not in index:
                index[to] = len(order)
                order.append(to)
            row.append(index[to])
        rows.append(row)
    table, ends_a = np.array(rows), np.array(ends)

    part = np.unique(ends_a, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == part.max():
            break
        part = finer
    rename = np.full(part.max() + 1, -1)
    keep = []
    for s, p in enumerate(part):
        if rename[p] < 0:
            rename[p] = len(keep)
            keep.append(s)
    small = rename[part[table[keep]]]
    accepts = ends_a[keep]
    dead = next((s for s in range(len(keep)) if not accepts[s] and (small[s] == s).all()), -1)
    return Automaton(small, classes.astype(np.int32), accepts, -1 if search else dead)


def _union(bits) -> int:
    out = 0
    for b in bits:
        out |= b
    return out
