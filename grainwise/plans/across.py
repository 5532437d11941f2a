"""Joins whose keys come from two inputs that lie side by side in a part's tree.

The new input restricts one of them by its key, what is left meets the other by its key and
the key they share, and only then the input above: rows that match nothing are never paired.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.plans.spec import BoundJoin, Ref, quoted
from grainwise.plans.weights import BIG, LONG_MAX, W, combine, measure_names, regroup

if TYPE_CHECKING:
    from grainwise.plans.forest import Edge, Forest, Node, Part

#: Keys whose exact counts give the first bound of the most repeated pair.
FIRST_KEYS = 16


def same(a: DataFrame, b: DataFrame, columns: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of one name, NULL equal to NULL."""
    there = b.withColumnsRenamed({c: f"__b_{c}" for c in columns})
    on = reduce(lambda x, y: x & y, [quoted(c).eqNullSafe(quoted(f"__b_{c}")) for c in columns], F.lit(True))
    return a.join(there, on, how).drop(*[f"__b_{c}" for c in columns])


@dataclass
class Across:
    """A join ``b`` with keys from ``top`` and one input below it, or from two below it."""

    forest: Forest
    b: BoundJoin
    part: Part
    top: Node
    below: list[Edge]
    owners: list[tuple[Node, str]]  # per key: who holds it, in which column

    @classmethod
    def find(cls, forest: Forest, b: BoundJoin) -> Across | None:
        """None if one input holds all keys, or the tree has another shape."""
        if len(forest.parts) != 1 or forest.parts[0].mixed():
            return None
        part, owners = forest.parts[0], []
        for candidates in b.left:
            live = [r for r in candidates if forest.chain.pos[r.alias.lower()] in part.alive()]
            if not live:
                return None
            pos = forest.chain.pos[live[0].alias.lower()]
            owners.append((next(n for n in part.nodes() if pos in n.inputs), forest.chain.physical(live[0])))
        nodes = list({id(n): n for n, _ in owners}.values())
        for top in part.nodes():
            below = [e for e in top.edges if any(e.child is n for n in nodes)]
            if len(nodes) == 2 and len(below) + any(top is n for n in nodes) == 2:
                return cls(forest, b, part, top, below, owners)
        return None

    # -- frames ------------------------------------------------------------------
    def keys(self, node: Node) -> list[str]:
        return [f"k{n}" for n, (owner, _) in enumerate(self.owners) if owner is node]

    @staticmethod
    def links(edges: Sequence[Edge]) -> list[str]:
        return list(dict.fromkeys(a for e in edges for a, _ in e.pairs))

    def with_keys(self, df: DataFrame, node: Node, keep: Sequence[str], edge: Edge | None = None, measures: int = 0) -> DataFrame:
        """Tuples of the node's keys, ``keep``, and the columns that link it to ``top``."""
        cast = self.forest._plain(self.b, [quoted(c) for _, c in self.owners])
        own = [cast[n].alias(f"k{n}") for n, (owner, _) in enumerate(self.owners) if owner is node]
        links = [quoted(c).alias(a) for a, c in edge.pairs] if edge else [quoted(a) for a in self.links(self.below)]
        names = [*(a for a, _ in edge.pairs)] if edge else self.links(self.below)
        keep = [c for c in keep if c not in names]
        df = df.select(*own, *links, *map(quoted, keep), W, *measure_names(measures))
        return regroup(df, [*self.keys(node), *names, *keep], measures, BIG)

    def below_rows(self, e: Edge) -> DataFrame:
        return self.with_keys(self.forest._fold(e.child), e.child, [], e)

    def top_rows(self) -> DataFrame:
        return self.with_keys(self.forest._folded(self.part, self.top, self.below), self.top, [])

    def meet(self, df: DataFrame, other: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Join on all keys and links the two share; hot ones of the side that has measures,
        else of ``df``, are spread."""
        measures = sum(c.startswith("__s") for c in (*df.columns, *other.columns))
        left, right = (other, df) if any(c.startswith("__s") for c in other.columns) else (df, other)
        on = [c for c in df.columns if c in other.columns and c != W]
        kept = [c for c in dict.fromkeys([*df.columns, *other.columns]) if c in keep]
        hot = self.forest._find_repeated(self.forest.rows)(left, on)
        right = right.withColumnsRenamed({c: f"__o_{c}" for c in on})
        return combine(left, right, [(c, f"__o_{c}") for c in on], "inner", kept, measures, BIG, hot_left=hot)

    def restricted(self, x: DataFrame, firsts: list[DataFrame], top: DataFrame, keep: Sequence[str]) -> DataFrame:
        """``x`` (its keys as ``k<n>``) with the tuples it matches in all inputs."""
        links = [set(self.links([e])) for e in self.below]
        every = {*keep, *self.links(self.below), *[f"k{n}" for n in range(len(self.owners))]}
        # two inputs meet by the key they share before the one above joins, if they share it
        together = len(firsts) == 1 or links[0] == links[1]
        order = [*firsts, top] if together else [firsts[0], top, firsts[1]]
        for n, other in enumerate(order):
            x = self.meet(x, other, every if n < len(order) - 1 else keep)
        return x

    # -- counting ----------------------------------------------------------------
    def left_keys(self, right: DataFrame) -> DataFrame:
        """``lw`` rows and ``lt`` tuples of the state per key that the new input holds."""
        names = [f"k{n}" for n in range(len(self.owners))]
        x = right.where(F.col("r") > 0).select(*[F.col(f"q{n}").alias(k) for n, k in enumerate(names)], F.lit(1).cast("bigint").alias(W))
        met = self.restricted(x, [self.below_rows(e) for e in self.below], self.top_rows(), names)
        counted = met.groupBy(*names).agg(F.sum(W).cast(BIG).alias("lw"), F.count(F.lit(1)).alias("lt"))
        return counted.select("*", *self.forest._null_measures())

    def most_repeated(self) -> tuple[int, int]:
        """Rows of the most repeated key tuple of the state, and of the one without NULLs."""
        top, last = self.top_rows(), self.below[-1]
        links = self.links([last])
        a_keys, b_keys = self.keys(self.top), self.keys(last.child)
        a = top
        if len(self.below) == 2:
            e = self.below[0]
            a_keys = self.keys(e.child)
            there = self.below_rows(e).withColumnsRenamed({x: f"__o_{x}" for x in self.links([e])})
            a = combine(top, there, [(x, f"__o_{x}") for x in self.links([e])], e.how, [*a_keys, *links], 0, BIG)
        a, b = regroup(a, [*a_keys, *links], 0, BIG), self.below_rows(last)
        if last.how == "left":  # an input without a row still stands beside the others, as NULLs
            there = b.withColumnsRenamed({x: f"__o_{x}" for x in links})
            ones = top.select(*map(quoted, links)).distinct().withColumn(W, F.lit(1).cast("bigint"))
            b = combine(ones, there, [(x, f"__o_{x}") for x in links], "left", [*b_keys, *links], 0, BIG)
        a, b = self.forest.shelf.hold(a), self.forest.shelf.hold(b)
        full = self.worst_pair(a.dropna(subset=a_keys), b.dropna(subset=b_keys), a_keys, b_keys, links, 0)
        return self.worst_pair(a, b, a_keys, b_keys, links, full), full

    def worst_pair(self, a: DataFrame, b: DataFrame, a_keys: list[str], b_keys: list[str], links: list[str], known: int) -> int:
        """Largest sum over links of the product of both weights, for a pair of keys.

        A key's weight times the other side's largest, summed, bounds all its pairs: pairs
        are only formed of keys whose bound exceeds what a few pairs have shown."""
        b = b.withColumnRenamed(W, "__bw")

        def product(x: DataFrame, y: DataFrame) -> int:
            pairs = same(x, y, links).groupBy(*a_keys, *b_keys).agg(F.sum(F.col(W) * F.col("__bw")).alias("n"))
            return int(pairs.agg(F.max("n")).first()[0] or 0)

        def bounds(x: DataFrame, y: DataFrame, keys: list[str], weight: str, other: str) -> DataFrame:
            most = y.groupBy(*map(quoted, links)).agg(F.max(other).alias("most"))
            return same(x, most, links).groupBy(*keys).agg(F.sum(F.col(weight) * F.col("most")).alias("bound"))

        upto = bounds(a, b, a_keys, W, "__bw")
        first = upto.orderBy(F.col("bound").desc()).limit(FIRST_KEYS)
        best = max(known, product(same(a, F.broadcast(first.select(*a_keys)), a_keys, "left_semi"), b))
        open_a = upto.where(F.col("bound") > best)
        if open_a.isEmpty():
            return best
        open_b = bounds(b, a, b_keys, "__bw", W).where(F.col("bound") > best)
        return max(best, product(same(a, open_a, a_keys, "left_semi"), same(b, open_b, b_keys, "left_semi")))

    # -- the state after ---------------------------------------------------------
    def part_with(self, x: DataFrame, cols: list[str], pos: set[int]) -> Part:
        """The part's rows that ``x`` matches, with its columns ``cols`` and weights."""
        from grainwise.plans.forest import Edge, Node, Part

        forest, path = self.forest, self.part.path(self.top)
        needed = forest._needed(self.b.index, self.part, pos)
        measures = forest._m(self.part, self.top)
        others = [e for node in (self.top, *[e.child for e in self.below]) for e in node.edges if not any(e is x for x in self.below)]
        linked = {a for e in others for a, _ in e.pairs} | {c for e in path[-1:] for _, c in e.pairs}

        def kept(node: Node) -> list[str]:
            return [c for c in node.df.columns if c in needed | linked]

        firsts = [self.with_keys(e.child.df, e.child, kept(e.child), e) for e in self.below]
        top = self.with_keys(self.top.df, self.top, kept(self.top), measures=measures)
        keep = [*dict.fromkeys([*kept(self.top), *[c for e in self.below for c in kept(e.child)], *cols])]
        df = self.restricted(x, firsts, top, keep)

        def copied(node: Node, on_path: Sequence[Edge] = ()) -> Node:
            if node is self.top:
                inputs = node.inputs.union(*[e.child.inputs for e in self.below], pos)
                return Node(inputs, df, LONG_MAX + 1, scan=False, edges=[
                    Edge(copied(e.child), e.pairs, e.how, e.hot_parent, e.hot_child) for e in others])
            return Node(set(node.inputs), node.df, node.bound, node.mixed, node.scan, [
                Edge(copied(e.child, on_path), e.pairs, "inner" if any(e is p for p in on_path) else e.how, e.hot_parent, e.hot_child)
                for e in node.edges])

        return Part(copied(self.part.root, path))

    def parts_after(self) -> list[Part]:
        forest, b, row = self.forest, self.b, self.forest._row
        names = [f"k{n}" for n in range(len(self.owners))]
        wanted = forest._needed(b.index, self.part, {b.pos})
        cols = sorted(c for c in b.join.df.columns if forest.chain.physical(Ref(b.join.alias, c)) in wanted)
        cols = [forest.chain.physical(Ref(b.join.alias, c)) for c in cols]

        def keys_with(weight: str) -> DataFrame:
            met = forest._right.where(F.col("r") > 0).select(*[F.col(f"q{n}").alias(k) for n, k in enumerate(names)],
                                                             F.expr(weight).cast("bigint").alias(W))
            return met.where(F.col(W) != 0)

        def rows() -> DataFrame:
            return forest._right_rows(b, cols).withColumnsRenamed(dict(zip(forest._r_keys(b), names)))

        matched = b.how in ("inner", "right", "semi")
        parts = [] if matched else [self.part]
        if b.how == "semi":
            parts.append(self.part_with(keys_with("1"), [], set()))
        elif b.how == "anti":
            # rows that match are taken off the whole, which keeps its inputs apart
            parts.append(self.part_with(keys_with("-1"), [], set()))
        elif cols:
            parts.append(self.part_with(rows(), cols, {b.pos}))
            if not matched:
                parts.append(self.part_with(keys_with("-1"), [], set()))
        elif matched:
            parts.append(self.part_with(keys_with("r"), [], {b.pos}))
        elif row["r_max"] > 1:
            parts.append(self.part_with(keys_with("r - 1"), [], set()))
        if b.how in ("right", "full") and row["r_rest"] > 0:
            parts.append(forest._unmatched_right(b))
        return parts
