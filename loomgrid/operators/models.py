"""Metabolic models as tables: gene rules of reactions, drafts by strain, renaming and summaries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"\(|\)|[^\s()]+")
#: Reactions whose rules go to the tasks at once, as one diagram.
BLOCK_REACTIONS = 20_000


def rule_alternatives(rule: str | None) -> list[list[str]] | None:
    """A gene rule (names, ``and``, ``or``, brackets) as alternatives of gene sets; no rule is null."""
    tokens = _TOKEN.findall(rule or "")
    if not tokens:
        return None
    at = 0

    def any_of() -> set[frozenset[str]]:
        nonlocal at
        out = all_of()
        while at < len(tokens) and tokens[at].lower() == "or":
            at += 1
            out |= all_of()
        return out

    def all_of() -> set[frozenset[str]]:
        nonlocal at
        out = one()
        while at < len(tokens) and tokens[at].lower() == "and":
            at += 1
            more = one()
            out = {a | b for a in out for b in more}
        return out

    def one() -> set[frozenset[str]]:
        nonlocal at
        token = tokens[at]
        at += 1
        if token == "(":
            out = any_of()
            at += 1
            return out
        return {frozenset([token])}

    found = any_of()
    return sorted(sorted(s) for s in found if not any(o < s for o in found))


class Diagram:
    """Gene rules as one reduced ordered decision diagram with shared nodes.

    A node (gene, absent, present) is kept once; 0 and 1 are false and true.
    Genes are ordered by their first place in the rules. A rule is a root, and
    holds for a set of genes when the walk from there ends in 1: as many steps as
    the rule has genes at most, however many alternatives it stands for.
    """

    def __init__(self):
        self.order: dict[str, int] = {}
        self.nodes: list[tuple[int, int, int]] = [(1 << 60, 0, 0), (1 << 60, 1, 1)]
        self.known: dict[tuple[int, int, int], int] = {}
        self.done: dict[tuple[bool, int, int], int] = {}

    def _node(self, gene: int, absent: int, present: int) -> int:
        if absent == present:
            return absent
        key = gene, absent, present
        if key not in self.known:
            self.known[key] = len(self.nodes)
            self.nodes.append(key)
        return self.known[key]

    def _join(self, both: bool, a: int, b: int) -> int:
        """The root of a and b, or of a or b."""
        stack = [(a, b)]
        while stack:
            x, y = stack[-1]
            key = (both, min(x, y), max(x, y))
            if key in self.done:
                stack.pop()
                continue
            if x == y or min(x, y) < 2:
                low, high = key[1], key[2]
                self.done[key] = high if x == y or low == (1 if both else 0) else low
                stack.pop()
                continue
            gene = min(self.nodes[x][0], self.nodes[y][0])
            sides = [tuple(self.nodes[v][s] if self.nodes[v][0] == gene else v for v in (x, y)) for s in (1, 2)]
            keys = [(both, min(p), max(p)) for p in sides]
            todo = [p for p, k in zip(sides, keys, strict=True) if k not in self.done]
            if todo:
                stack += todo
            else:
                self.done[key] = self._node(gene, *(self.done[k] for k in keys))
                stack.pop()
        return self.done[(both, min(a, b), max(a, b))]

    def root(self, rule: str | None) -> int:
        """Add a rule (names, ``and``, ``or``, brackets); no rule always holds."""
        tokens = _TOKEN.findall(rule or "")
        if not tokens:
            return 1
        level: list[list[int | None]] = [[None, None]]  # of each open bracket: what stands before "or", and the running "and"

        def close(any_of: int | None, all_of: int | None) -> int:
            if all_of is None:
                raise ValueError(f"not a rule: {rule}")
            return all_of if any_of is None else self._join(False, any_of, all_of)

        waits = True  # for a name or a bracket
        for token in tokens:
            word = token.lower()
            if word in ("and", "or") and not waits:
                if word == "or":
                    level[-1] = [close(*level[-1]), None]
                waits = True
                continue
            if token == "(" and waits:
                level.append([None, None])
                continue
            if token == ")" and not waits and len(level) > 1:
                now = close(*level.pop())
            elif waits and token != ")":
                now = self._node(self.order.setdefault(token, len(self.order)), 0, 1)
            else:
                raise ValueError(f"not a rule: {rule}")
            level[-1][1] = now if level[-1][1] is None else self._join(True, level[-1][1], now)
            waits = False
        if waits or len(level) > 1:
            raise ValueError(f"not a rule: {rule}")
        return close(*level[0])

    def holds(self, root: int, genes: set[int]) -> bool:
        while root > 1:
            gene, absent, present = self.nodes[root]
            root = present if gene in genes else absent
        return root == 1


def drafts_by_rule(reactions: DataFrame, strain_genes: DataFrame, artificial: list[str] | None = None) -> DataFrame:
    """(strain, reaction): reactions whose gene rule (reaction, rule) a strain's genes (strain, genes array) fulfil; artificial genes always count.

    The rules of at most about ``BLOCK_REACTIONS`` reactions go to the tasks as
    one diagram; more make several passes over the strains.
    """
    strain, reaction = strain_genes.schema["strain"].dataType.simpleString(), reactions.schema["reaction"].dataType.simpleString()
    n, out = max(1, -(-reactions.count() // BLOCK_REACTIONS)), None
    for block in range(n):
        rows = reactions.where(F.pmod(F.xxhash64("reaction"), F.lit(n)) == block).select("reaction", "rule").collect()  # a block
        diagram = Diagram()
        roots = [(r.reaction, diagram.root(r.rule)) for r in rows]

        def run(frames, diagram=diagram, roots=roots):
            import pandas as pd

            always = {diagram.order[g] for g in artificial or [] if g in diagram.order}
            for frame in frames:
                found = []
                for name, genes in zip(frame["strain"], frame["genes"], strict=True):
                    own = always | {diagram.order[g] for g in (genes if genes is not None else []) if g in diagram.order}
                    found += [(name, r) for r, root in roots if diagram.holds(root, own)]
                yield pd.DataFrame(found, columns=["strain", "reaction"])

        made = strain_genes.select("strain", "genes").mapInPandas(run, f"strain {strain}, reaction {reaction}")
        out = made if out is None else out.unionByName(made)
    return out


_alternatives = F.udf(rule_alternatives, T.ArrayType(T.ArrayType(T.StringType())))


def with_alternatives(reactions: DataFrame, rule: str = "rule") -> DataFrame:
    return reactions.withColumn("alternatives", _alternatives(rule))


def rule_holds(genes: Column, alternatives: Column) -> Column:
    """True without a rule, or when all genes of some alternative are there."""
    return alternatives.isNull() | F.exists(alternatives, lambda all_: F.forall(all_, lambda g: F.array_contains(genes, g)))


def drafts(reactions: DataFrame, strain_genes: DataFrame, artificial: list[str] | None = None) -> DataFrame:
    """(strain, reaction): reactions that a strain's genes allow. ``reactions``: (reaction, alternatives); ``strain_genes``: (strain, genes array); artificial genes always count. Each strain keeps a model of its own."""
    extra = F.array(*(F.lit(g) for g in artificial or [])).cast("array<string>")
    genes = strain_genes.select("strain", F.array_union("genes", extra).alias("genes"))
    return genes.join(F.broadcast(reactions.select("reaction", "alternatives"))).where(rule_holds(F.col("genes"), F.col("alternatives"))).select("strain", "reaction")  # one model's reactions


def renamed(genes: DataFrame, names: DataFrame) -> DataFrame:
    """(strain, gene) under the strain's own names (strain, gene, name); ``None`` and null keep the model's."""
    real = names.where(F.col("name").isNotNull() & (F.col("name") != "None"))
    return genes.join(real, ["strain", "gene"], "left").select("strain", F.coalesce("name", "gene").alias("gene"))


def model_summary(strain_genes: DataFrame, strain_reactions: DataFrame) -> DataFrame:
    g = strain_genes.select("strain", F.size("genes").cast("long").alias("n_genes"))
    return g.join(strain_reactions.groupBy("strain").agg(F.count(F.lit(1)).alias("n_reactions")), "strain", "left").fillna(0)
