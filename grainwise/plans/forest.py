"""The state of a join chain as weighted frames.

After each join the result is held as a few *parts* whose rows add up to it.  RIGHT
and FULL joins add a part for the unmatched right rows.  Inside a part, inputs that
later joins still read sit in a tree of weighted frames; an input is folded into its
neighbour as soon as that neighbour has one row per key, so joined rows (and pairs of
rows that share a key) are never built.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from decimal import Context, Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainwise.plans.across import Across
from grainwise.plans.alternatives import alternatives, met_rows, with_hits
from grainwise.plans.intervals import interval
from grainwise.plans.pairs import without_pairs
from grainwise.plans.ranges import common_type, comparison, range_matches
from grainwise.plans.spec import BoundChain, BoundJoin, Ref, quoted
from grainwise.plans.storage import Shelf
from grainwise.plans.weights import (
    BIG, LONG_MAX, W, Hot, combine, compared_type, equal, measure_names, regroup, weight_type)

#: Arithmetic on sums that the driver adds up.
EXACT = Context(prec=60)


def exact_measure(value: Column, type_: T.DataType) -> tuple[str, int | None, Column]:
    """How a measured value is carried: integers and decimals as whole numbers of their
    smallest unit with that scale, so that no product or sum rounds; others as doubles."""
    if isinstance(type_, T.DecimalType):
        # beyond 38 digits in the smallest unit the cast fails instead of rounding
        units = value.cast(f"decimal(38,{type_.scale})") * F.lit(Decimal(10) ** type_.scale).cast(f"decimal({type_.scale + 1},0)")
        return BIG, type_.scale, units.cast(BIG)
    if isinstance(type_, T.IntegralType):
        return BIG, 0, value.cast(BIG)
    return "double", None, value.cast("double")


@dataclass
class Edge:
    child: Node
    pairs: list[tuple[str, str]]  # (column of the parent, column of the child)
    how: str  # inner, or left when the child may be missing
    hot_parent: Hot | None = None
    hot_child: Hot | None = None


@dataclass
class Node:
    inputs: set[int]
    df: DataFrame
    bound: int  # no weight, nor the sum of all weights, exceeds this
    mixed: bool = False
    scan: bool = True  # read from an input or from storage, so cheap to read again
    edges: list[Edge] = field(default_factory=list)


@dataclass
class Part:
    root: Node

    def nodes(self) -> Iterator[Node]:
        stack = [self.root]
        while stack:
            node = stack.pop()
            yield node
            stack += [e.child for e in node.edges]

    def alive(self) -> set[int]:
        return set().union(*(n.inputs for n in self.nodes()))

    def mixed(self) -> bool:
        return any(n.mixed for n in self.nodes())

    def path(self, node: Node) -> list[Edge]:
        """Edges from the root down to ``node``."""
        def walk(at: Node) -> list[Edge] | None:
            if at is node:
                return []
            for e in at.edges:
                below = walk(e.child)
                if below is not None:
                    return [e, *below]
            return None

        return walk(self.root)


@dataclass
class Counts:
    """What one join step measures; counts are exact integers."""

    rows_before: int
    rows_after: int
    left_max_dup: int | None = None
    left_max_dup_non_null: int | None = None
    n_rows: int | None = None
    n_keys: int | None = None
    max_dup: int | None = None
    max_dup_non_null: int | None = None
    dup_keys: int | None = None
    null_rows: int | None = None
    one_per_key: int | None = None  # rows after, had the right side one row per key
    matched: int | None = None  # left rows with a match
    measures: list[tuple] | None = None  # (base sum, base count, joined sum, joined count)


class Forest:
    """Walks a chain join by join: :meth:`measure` counts a join, :meth:`advance` applies it."""

    def __init__(self, chain: BoundChain, shelf: Shelf, measures: list[Column] = (),
                 hot_floor: int = 10_000):
        self.chain, self.shelf, self.spark = chain, shelf, shelf.spark
        self.n_measures = len(measures)
        self.hot_floor = hot_floor
        self.partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.rows: int | None = None
        self.base: list[tuple] | None = None
        self._left: DataFrame | None = None
        self._right: DataFrame | None = None
        self._hot: tuple[Hot | None, Hot | None] = (None, None)
        self._next: Callable[[], list[Part]] | None = None
        self._beyond: dict[str, int] = {}  # counts of left keys that the measured ones leave out
        self._owners: list[tuple[Part, Node | None, list[str]]] = []
        self._types: dict[tuple[int, int], str | None] = {}

        needed = sorted({r.column for r in chain.needed_after(-1, {0})})
        alias, df = chain.inputs[0]
        driving = df.alias(alias)
        cols = [quoted(c).alias(chain.physical(Ref(alias, c))) for c in needed]
        cols.append(F.lit(1).cast("bigint").alias(W))
        self.measure_types: list[str] = []
        self._scales: list[int | None] = []  # None: floating point
        for m, value in enumerate(measures):
            type_, scale, value = exact_measure(value, driving.select(value).schema[0].dataType)
            self.measure_types += [type_, BIG]
            self._scales.append(scale)
            cols.append(value.alias(f"__s{m}"))
            cols.append(F.when(value.isNotNull(), 1).otherwise(0).cast(BIG).alias(f"__c{m}"))
        self.parts = [Part(Node({0}, driving.select(*cols), LONG_MAX))]

    # -- keys of a join ----------------------------------------------------------
    def _owner(self, part: Part, b: BoundJoin) -> tuple[Node | None, list[Column]]:
        """The node of ``part`` that holds the left keys of ``b``; None if they are NULL
        everywhere in this part."""
        if not b.left:
            return part.root, []
        alive = part.alive()
        owners: list[Node] = []
        exprs: list[Column] = []
        for n, candidates in enumerate(b.left):
            live = [r for r in candidates if self.chain.pos[r.alias.lower()] in alive]
            if not live:
                exprs.append(F.lit(None).cast(self._left_type(b, n)))
                continue
            node = next(x for x in part.nodes() if self.chain.pos[live[0].alias.lower()] in x.inputs)
            owners.append(node)
            here = [r for r in live if self.chain.physical(r) in node.df.columns] if node.mixed else live[:1]
            names = [quoted(self.chain.physical(r)) for r in here]
            exprs.append(names[0] if len(names) == 1 else F.coalesce(*names))
        if not owners:
            return None, []
        if any(n is not owners[0] for n in owners):
            self._flatten(part, b.index)
            return self._owner(part, b)
        return owners[0], exprs

    def _left_type(self, b: BoundJoin, n: int) -> T.DataType:
        first = b.left[n][0]
        return self.chain.inputs[self.chain.pos[first.alias.lower()]][1].schema[first.column].dataType

    def _key_type(self, b: BoundJoin, n: int) -> str | None:
        """The type in which the join compares key ``n``, if the sides' types differ: both
        sides are grouped and joined in it, so that equal keys are one row on each side."""
        at = (b.index, n)
        if at not in self._types:
            self._types[at] = compared_type(self.spark, self._left_type(b, n), b.join.df.schema[b.right[n]].dataType)
        return self._types[at]

    def _merging(self, b: BoundJoin) -> bool:
        """Whether several values of a side may be one key; integers of any width stay apart."""
        def whole(n: int) -> bool:
            return all(isinstance(t, T.IntegralType) for t in (self._left_type(b, n), b.join.df.schema[b.right[n]].dataType))

        return any(self._key_type(b, n) and not whole(n) for n in range(len(b.right)))

    def _cast(self, b: BoundJoin, exprs: list[Column], name: str) -> list[Column]:
        return [e.alias(f"{name}{n}") for n, e in enumerate(self._plain(b, exprs))]

    def _needed(self, i: int, part: Part, extra: set[int] = frozenset()) -> set[str]:
        refs = self.chain.needed_after(i, part.alive() | extra, part.mixed())
        return {self.chain.physical(r) for r in refs}

    # -- counting ----------------------------------------------------------------
    def left_keys(self, b: BoundJoin) -> DataFrame:
        """One row per left key: rows ``lw``, tuples ``lt``, and measures."""
        frames = []
        self._owners = []
        keys = [f"k{n}" for n in range(len(b.left))]
        for part in self.parts:
            owner, exprs = self._owner(part, b)
            self._owners.append((part, owner, exprs))
            if owner is None:
                continue
            df = self._folded(part, owner)
            df = df.select(*self._cast(b, exprs, "k"), W,
                           *(measure_names(self.n_measures) if owner is part.root else
                             self._null_measures()))
            frames.append(df)
        if not frames:
            right = b.join.df.select(*self._cast(b, [quoted(c) for c in b.right], "k"))
            frames = [right.where(F.lit(False)).withColumns(
                {W: F.lit(0).cast("bigint"),
                 **dict(zip(measure_names(self.n_measures), self._null_measures()))})]
        df = reduce(DataFrame.unionByName, frames)
        type_ = weight_type(sum(LONG_MAX + 1 if p.root.edges else p.root.bound for p in self.parts))
        return df.groupBy(*keys).agg(
            F.sum(W).cast(type_).alias("lw"), F.count(F.lit(1)).alias("lt"),
            *[F.sum(m).alias(m) for m in measure_names(self.n_measures)])

    def right_keys(self, b: BoundJoin, df: DataFrame | None = None) -> DataFrame:
        """One row per right key: all rows ``n`` and rows that meet the condition ``r``."""
        df = (b.join.df if df is None else df).alias(b.join.alias)
        ok = self._right_condition(b)
        keys = [f"q{n}" for n in range(len(b.right))]
        counts = F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("r")
        if not self._merging(b):
            df = df.select(*self._cast(b, [quoted(c) for c in b.right], "q"), ok.alias("ok"))
            return df.groupBy(*keys).agg(*counts)
        # the profile is that of the stored values, so these are counted first
        raw = [F.col(f"raw{n}") for n in range(len(keys))]
        df = df.select(*[quoted(c).alias(f"raw{n}") for n, c in enumerate(b.right)], ok.alias("ok"))
        return (df.groupBy(*raw).agg(*counts).select(*self._cast(b, raw, "q"), "n", "r").groupBy(*keys)
                .agg(F.sum("n").alias("n"), F.sum("r").alias("r"), F.count(F.lit(1)).alias("kn"),
                     F.max("n").alias("kmax"), F.count_if(F.col("n") > 1).alias("kdup"), F.count_if(F.col("r") > 0).alias("kr")))

    def _null_measures(self) -> list[Column]:
        return [F.lit(None).cast(t).alias(m) for m, t in zip(measure_names(self.n_measures), self.measure_types)]

    def _scaled(self, sums: list[tuple]) -> list[tuple]:
        """(sum, count) pairs with the sums in their own units."""
        return [(s if s is None or scale is None else Decimal(s).scaleb(-scale, EXACT), c) for (s, c), scale in zip(sums, self._scales)]

    def _right_condition(self, b: BoundJoin) -> Column:
        """The part of the condition that reads the right side alone, as true or false."""
        if b.join.residual is None or b.reads_left:
            return F.lit(True)
        return F.coalesce(F.expr(b.join.residual).cast("boolean"), F.lit(False))

    def matched_keys(self, b: BoundJoin, left: DataFrame, right: DataFrame) -> DataFrame:
        if not b.left:
            return left.crossJoin(right)  # one row each
        pairs = [(f"k{n}", f"q{n}") for n in range(len(b.left))]
        return left.join(right, equal(pairs), "full")

    def measure(self, i: int) -> Counts:
        """Counts join ``i`` with one aggregate over the key counts of both sides."""
        b = self.chain.joins[i]
        self._next, self._beyond = None, {}
        if b.reads_left:
            return self._measure_range(i) or self._measure_any(i) or self._measure_real(i)
        if (across := Across.find(self, b)) is not None:
            return self._measure_across(across)
        last = i == len(self.chain.joins) - 1
        self._hot = (None, None)
        left, right = self.left_keys(b), self.right_keys(b)
        if not last:
            right = self.shelf.hold(right)
            if b.how in ("right", "full"):
                left = self.shelf.hold(left)
        self._left, self._right = left, right
        row = self._stats(b, left, right)
        counts = self._counts(b, row)
        if not last:
            self._hot = self._find_hot(b, row)
        return counts

    def _measure_across(self, across: Across) -> Counts:
        """Counts a join whose keys come from two inputs: only keys that the new input holds
        are counted on the left; what the others hold follows from the rows so far."""
        b = across.b
        self._right = self.shelf.hold(self.right_keys(b))
        self._left = self.shelf.hold(across.left_keys(self._right))
        self._owners, self._hot = [(across.part, None, [])], (None, None)
        worst, full = across.most_repeated()
        self._beyond = {"l_rows": self.rows, "l_max": worst, "l_max_nn": full}
        self._next = across.parts_after
        return self._counts(b, self._stats(b, self._left, self._right))

    def _stats(self, b: BoundJoin, left: DataFrame, right: DataFrame):
        """Everything the step reports, as one row over the key counts of both sides.

        Sums of one side's rows fit the type of its counts; only the product of both
        sides needs decimal(38,0).
        """
        nk = range(len(b.left))

        def each(template: str, word: str, empty: str) -> str:
            return f" {word} ".join(template.format(n) for n in nk) or empty

        # stored values per key of the right side; one each unless the sides' types differ
        kn, kmax, kdup, kr = ("kn", "kmax", "kdup", "kr") if "kn" in right.columns else ("if(n IS NULL, 0, 1)", "n", "if(n > 1, 1, 0)", "1")
        both = self.matched_keys(b, left, right).selectExpr(
            "*", "coalesce(lw, 0) AS l", "coalesce(n, 0) AS n0", "coalesce(r, 0) AS r0",
            "coalesce(lw > 0 AND r > 0, false) AS hit",
            each("k{} IS NOT NULL", "AND", "true") + " AS l_full",
            f"lt IS NOT NULL AND {each('k{} IS NULL', 'AND', 'false')} AS l_null",
            each("q{} IS NOT NULL", "AND", "true") + " AS r_full")
        aggs = {
            "l_rows": "sum(l)", "l_max": "max(l)", "l_max_nn": "max(l) FILTER (WHERE l_full)",
            "l_null": "sum(l) FILTER (WHERE l_null)", "l_tuples": "sum(lt)",
            "l_hot": "max(lt) FILTER (WHERE l_full)", "r_hot": "max(n) FILTER (WHERE r_full)", "n_rows": "sum(n)",
            "n_keys": f"sum({kn})", "max_dup": f"max({kmax})", "max_dup_nn": f"max({kmax}) FILTER (WHERE r_full)",
            "dup_keys": f"sum({kdup})", "one": f"sum(l * {kr}) FILTER (WHERE hit)",
            "null_rows": "sum(n) FILTER (WHERE NOT r_full)",
            "matched": "sum(l) FILTER (WHERE hit)", "r_max": "max(r) FILTER (WHERE hit)",
            "inner": f"sum(CAST(l AS {BIG}) * CAST(r0 AS {BIG})) FILTER (WHERE hit)",
            "r_rest": "sum(if(l > 0, n0 - r0, n0))", "r_rest_keys": f"sum({kn}) FILTER (WHERE l = 0)",
        }
        times = {"semi": "if(hit, 1, 0)", "anti": "if(hit, 0, 1)", "left": "if(hit, r0, 1)",
                 "full": "if(hit, r0, 1)"}.get(b.how, "r0")
        kept = {"left": "true", "full": "true", "anti": "NOT hit"}.get(b.how, "hit")
        for m in range(self.n_measures):
            aggs |= {f"bs{m}": f"sum(__s{m})", f"bc{m}": f"sum(__c{m})",
                     f"js{m}": f"sum(__s{m} * {times}) FILTER (WHERE {kept})",
                     f"jc{m}": f"sum(__c{m} * {times}) FILTER (WHERE {kept})"}
        return both.agg(*[F.expr(v).alias(k) for k, v in aggs.items()]).first()

    def _counts(self, b: BoundJoin, row) -> Counts:
        v = {k: (0 if x is None else int(x)) for k, x in row.asDict().items() if k[:2] not in
             ("bs", "bc", "js", "jc")} | self._beyond
        if self.rows is None:
            self.rows = v["l_rows"]
            self.parts[0].root.bound = v["l_rows"]
        # rows of the result so far whose left key is NULL because its input is missing
        missing = self.rows - v["l_rows"]
        unmatched = v["l_rows"] - v["matched"] + missing

        def after(hits: int, right_rest: int) -> int:
            return {
                "inner": hits, "cross": hits, "semi": v["matched"], "anti": unmatched,
                "left": hits + unmatched, "right": hits + right_rest,
                "full": hits + unmatched + right_rest,
            }[b.how]

        counts = Counts(
            rows_before=self.rows, rows_after=after(v["inner"], v["r_rest"]),
            left_max_dup=max(v["l_max"], v["l_null"] + missing if missing else 0),
            left_max_dup_non_null=v["l_max_nn"],
            n_rows=v["n_rows"], n_keys=v["n_keys"] if b.left else None, max_dup=v["max_dup"],
            max_dup_non_null=v["max_dup_nn"], dup_keys=v["dup_keys"], null_rows=v["null_rows"],
            one_per_key=after(v["one"], v["r_rest_keys"]), matched=v["matched"])
        simple = len(self._owners) == 1 and self._owners[0][1] is self._owners[0][0].root
        if self.n_measures and simple:
            got = [(row[f"bs{m}"], row[f"bc{m}"], row[f"js{m}"], row[f"jc{m}"])
                   for m in range(self.n_measures)]
            if self.base is None and b.index == 0:
                self.base = self._scaled([(s, c) for s, c, _, _ in got])
            counts.measures = self._scaled([(s, c) for _, _, s, c in got])
        self._row = v
        self._identity = {
            "semi": unmatched == 0, "anti": v["matched"] == 0, "left": v["r_max"] <= 1,
        }.get(b.how, unmatched == 0 and v["r_max"] <= 1)  # the join changes no weight
        return counts

    def recount(self, b: BoundJoin, right: DataFrame) -> int:
        """Rows after join ``b`` had its right input the rows of ``right`` instead.

        Valid between :meth:`measure` and :meth:`advance` of that join."""
        saved = self._row, self._identity
        rows = self._counts(b, self._stats(b, self._left, self.right_keys(b, right))).rows_after
        self._row, self._identity = saved
        return rows

    def _find_hot(self, b: BoundJoin, row) -> tuple[Hot | None, Hot | None]:
        """Keys that exceed a partition's fair share, on either side."""
        if not b.left:
            return None, None
        names = range(len(b.left))
        return (self._hot_keys(self._left, [f"k{n}" for n in names], "lt", row["l_hot"], row["l_tuples"]),
                self._hot_keys(self._right, [f"q{n}" for n in names], "n", row["r_hot"], row["n_rows"]))

    def _hot_keys(self, df: DataFrame, keys: list[str], size: str, worst, total) -> Hot | None:
        limit = max(1, self.hot_floor, int(total or 0) // self.partitions)
        if int(worst or 0) <= limit:
            return None
        found = df.where(F.col(size) > limit).select(
            *[F.col(k).alias(f"h{n}") for n, k in enumerate(keys)]).dropna()
        # fewer rows than partitions, by the choice of `limit`
        hot = self.spark.createDataFrame(found.collect(), found.schema)
        return Hot(hot, min(self.partitions, -(-int(worst) // limit) + 1), limit)

    # -- applying a join ---------------------------------------------------------
    def advance(self, i: int, counts: Counts) -> None:
        """Replaces the state by the state after join ``i``."""
        b = self.chain.joins[i]
        if self._next is not None:
            self.parts = self._next()
        else:
            parts = [p for p, owner, exprs in self._owners if self._apply(p, owner, exprs, b)]
            if b.how in ("right", "full") and self._row["r_rest"] > 0:
                parts.append(self._unmatched_right(b))
            self.parts = parts
        self.rows = counts.rows_after
        single = len(self.parts) == 1 and not self.parts[0].root.edges
        again = i + 2 < len(self.chain.joins)  # read by the next count and the next join
        for part in self.parts:
            self._simplify(part, i)
            if single:
                part.root.bound = counts.rows_after
            for node in part.nodes():
                if again and not node.scan:
                    node.df = self.shelf.keep(node.df)

    def _apply(self, part: Part, owner: Node | None, exprs: list[Column], b: BoundJoin) -> bool:
        """Applies a join to one part; False if nothing of the part is left."""
        if owner is None:
            return b.how in ("left", "full", "anti")
        i, pos, row = b.index, b.pos, self._row
        hot_left, hot_right = self._hot
        if b.how in ("inner", "cross", "right", "semi"):
            for e in part.path(owner):
                e.how = "inner"
        how = {"right": "inner", "full": "left", "cross": "inner"}.get(b.how, b.how)
        # left keys as columns of the owner, under names of their own
        keys = [f"__k{n}" for n in range(len(exprs))]
        owned = owner.df.select("*", *[e.alias(k) for e, k in zip(self._plain(b, exprs), keys)])
        factor = self._right.where(F.col("r") > 0)
        pairs = [(k, f"q{n}") for n, k in enumerate(keys)]
        if b.how in ("semi", "anti"):
            keep = self._keep(part, owner, i)
            if self._identity:
                owner.df = owner.df.select(*map(quoted, keep), W, *measure_names(self._m(part, owner)))
                return True
            flag = factor.withColumn(W, F.lit(1 if b.how == "semi" else 0).cast("bigint")).drop("n", "r")
            owner.df = combine(owned, flag, pairs, "inner" if b.how == "semi" else "left", keep,
                               self._m(part, owner), weight_type(owner.bound), hot_left=hot_left)
            if b.how == "anti" and owner is part.root:
                owner.df = owner.df.where(F.col(W) != 0)
            owner.scan = False
            return True

        wanted = self._needed(i, part, {pos})
        physical = {self.chain.physical(Ref(b.join.alias, c)): c for c in b.join.df.columns}
        right_cols = sorted(c for c in wanted if c in physical)
        key_names = [self.chain.physical(Ref(b.join.alias, c)) for c in b.right]
        keep = self._keep(part, owner, i, {pos})
        if not right_cols and self._identity:
            owner.df = owner.df.select(*map(quoted, keep), W, *measure_names(self._m(part, owner)))
            return True
        type_ = weight_type(owner.bound * max(1, row["r_max"]))
        if set(right_cols) <= set(key_names) and not (right_cols and self._merging(b)):
            few = factor.select(*[f"q{n}" for n in range(len(keys))], F.col("r").alias(W),
                                *[F.col(f"q{key_names.index(c)}").alias(c) for c in right_cols])
            if not keys:
                few = few.select(W)
            owner.df = combine(owned, few, pairs, how, keep + right_cols, self._m(part, owner), type_,
                               hot_left=hot_left)
            return self._joined(owner, b)

        rows = self._right_rows(b, right_cols)
        r_keys = self._r_keys(b)
        if owner is part.root and not owner.edges and self._fixed_by_key(owner, keep, b, exprs):
            few = regroup(owned, keep + keys, self._m(part, owner), type_)
            owner.df = combine(few, rows, list(zip(keys, r_keys)), how, keep + right_cols,
                               self._m(part, owner), type_, hot_right=hot_right)
            return self._joined(owner, b)

        # both sides keep other columns per key: leave them unjoined, linked by the key
        owner.df = owned.select(*map(quoted, keep), *keys, W, *measure_names(self._m(part, owner)))
        names = [f"__e{pos}_{n}" for n in range(len(keys))]
        for k, name in zip(keys, names):
            owner.df = owner.df.withColumnRenamed(k, name)
        child = Node({pos}, rows, max(1, row["n_rows"]))
        owner.edges.append(Edge(child, list(zip(names, r_keys)), how, hot_left, hot_right))
        return True

    def _joined(self, owner: Node, b: BoundJoin) -> bool:
        owner.inputs = owner.inputs | {b.pos}
        owner.bound *= max(1, self._row["r_max"])
        owner.scan = False
        return True

    def _r_keys(self, b: BoundJoin) -> list[str]:
        return [f"__r{b.pos}_{n}" for n in range(len(b.right))]

    def _plain(self, b: BoundJoin, exprs: list[Column]) -> list[Column]:
        types = [self._key_type(b, n) for n in range(len(exprs))]
        return [e.cast(t) if t else e for e, t in zip(exprs, types)]

    def _m(self, part: Part, node: Node) -> int:
        return self.n_measures if node is part.root else 0

    def _right_rows(self, b: BoundJoin, cols: list[str], ok: bool = True) -> DataFrame:
        """Rows of the right input that meet (or fail) the condition, keys as ``_r_keys``."""
        df = b.join.df.alias(b.join.alias)
        cond = self._right_condition(b)
        df = df.where(cond if ok else ~cond)
        physical = {self.chain.physical(Ref(b.join.alias, c)): c for c in b.join.df.columns}
        keys = [c.alias(k) for c, k in zip(self._plain(b, [quoted(c) for c in b.right]), self._r_keys(b))]
        return df.select(*keys, *[quoted(physical[c]).alias(c) for c in cols],
                         F.lit(1).cast("bigint").alias(W))

    def _keep(self, part: Part, node: Node, i: int, extra: set[int] = frozenset()) -> list[str]:
        """Columns of ``node`` that later joins or its tree neighbours read."""
        linked = {c for c, _ in (p for e in node.edges for p in e.pairs)}
        for e in part.path(node)[-1:]:
            linked |= {c for _, c in e.pairs}
        wanted = self._needed(i, part, extra) | linked
        return [c for c in node.df.columns if c in wanted]

    def _fixed_by_key(self, owner: Node, keep: list[str], b: BoundJoin, exprs: list[Column]) -> bool:
        """Whether everything the owner keeps is a left key of ``b``, hence one tuple per key."""
        if owner.mixed or self._merging(b):
            return not keep
        keys = {self.chain.physical(r) for c in b.left for r in c[:1]
                if self.chain.pos[r.alias.lower()] in owner.inputs}
        return set(keep) <= keys

    def _unmatched_right(self, b: BoundJoin) -> Part:
        """The part of a RIGHT or FULL join in which only the right input is present."""
        cols = sorted(self.chain.physical(r) for r in self.chain.needed_after(b.index, {b.pos}))
        keys = self._r_keys(b)
        met = self._left.where(F.col("lw") > 0).withColumn(W, F.lit(0).cast("bigint"))
        met = met.select(*[f"k{n}" for n in range(len(keys))], W)
        rows = self._right_rows(b, cols)
        if keys:
            # weight 0 where a left row matches, 1 elsewhere
            rows = combine(rows, met, list(zip(keys, met.columns)), "left", cols, 0, "bigint",
                           hot_left=self._hot[1])
        elif self._row["l_rows"] > 0:
            rows = rows.where(F.lit(False))
        rows = rows.select(*cols, W)
        if b.join.residual is not None:
            rows = rows.unionByName(self._right_rows(b, cols, ok=False).select(*cols, W))
        rows = regroup(rows, cols, 0, "bigint").where(F.col(W) > 0)
        return Part(Node({b.pos}, self._no_measures(rows), max(1, self._row["n_rows"]), scan=False))

    def _no_measures(self, df: DataFrame) -> DataFrame:
        for name, type_ in zip(measure_names(self.n_measures), self.measure_types):
            df = df.withColumn(name, F.lit(None if name.startswith("__s") else 0).cast(type_))
        return df

    # -- trees -------------------------------------------------------------------
    def _up(self, e: Edge) -> DataFrame:
        """Rows below an edge, per key of the edge."""
        keys = [c for _, c in e.pairs]
        return regroup(self._fold(e.child), keys, 0, weight_type(e.child.bound))

    def _fold(self, node: Node, skip: Sequence[Edge] = ()) -> DataFrame:
        """The node's tuples with the weight of everything below them, except ``skip``."""
        df = node.df
        for e in node.edges:
            if not any(e is s for s in skip):
                cols = [c for c in df.columns if c != W and not c.startswith(("__s", "__c"))]
                measures = sum(c.startswith("__s") for c in df.columns)
                df = combine(df, self._up(e), e.pairs, e.how, cols, measures, BIG, hot_left=e.hot_parent)
        return df

    def _folded(self, part: Part, node: Node, skip: Sequence[Edge] = ()) -> DataFrame:
        """The node's tuples weighted by the whole part, except ``skip`` below the node, where
        the node is present."""
        path = part.path(node)
        df = self._fold(part.root, path[:1] or skip)
        for n, e in enumerate(path):
            here = self._fold(e.child, path[n + 1:n + 2] or skip)
            above = regroup(df, [a for a, _ in e.pairs], 0, BIG)
            cols = [c for c in here.columns if c != W]
            df = combine(here, above, [(c, a) for a, c in e.pairs], "inner", cols, 0, BIG,
                         hot_left=e.hot_child)
        return df

    def _simplify(self, part: Part, i: int) -> None:
        """Folds nodes into neighbours as soon as that needs no pairs of rows."""
        changed = True
        while changed:
            changed = False
            needed = self._needed(i, part)
            for node in list(part.nodes()):
                for e in list(node.edges):
                    own = {c for _, c in e.pairs}
                    if not e.child.edges and not (set(e.child.df.columns) & needed):
                        node.edges.remove(e)
                        child_bound = e.child.bound
                        node.bound *= max(1, child_bound)
                        node.df = combine(node.df, self._up(e), e.pairs, e.how, self._keep(part, node, i),
                                          self._m(part, node), weight_type(node.bound),
                                          hot_left=e.hot_parent)
                        node.scan = False
                        changed = True
            root = part.root
            if len(root.edges) == 1 and not (set(root.df.columns) & needed):
                e = root.edges[0]
                child, m = e.child, self.n_measures
                keys = [a for a, _ in e.pairs]
                type_ = weight_type(root.bound * max(1, child.bound))
                few = regroup(root.df, keys, m, type_)
                linked = {a for x in child.edges for a, _ in x.pairs}
                keep = [c for c in child.df.columns if c in needed | linked]
                child.df = combine(few, child.df, e.pairs, e.how, keep, m, type_, hot_right=e.hot_child)
                child.bound = root.bound * max(1, child.bound)
                child.inputs, child.mixed, child.scan = child.inputs | root.inputs, root.mixed, False
                part.root = child
                changed = True

    def _flat(self, node: Node, keep: set[str], root: bool) -> DataFrame:
        """The node and everything below it as one frame that keeps ``keep``."""
        df, m = node.df, self.n_measures if root else 0
        for e in node.edges:
            sub = self._flat(e.child, keep, False)
            keys = [c for _, c in e.pairs]
            cols = [c for c in sub.columns if c in keep]
            sub = regroup(sub, list(dict.fromkeys(keys + cols)), 0, BIG)
            have = [c for c in df.columns if c != W and c not in measure_names(m)]
            df = combine(df, sub, e.pairs, e.how, have + [c for c in cols if c not in have], m, BIG)
        return df

    def _flatten(self, part: Part, i: int) -> None:
        """Joins the tree of a part to one frame, for a join whose keys come from several nodes."""
        needed = self._needed(i - 1, part)
        df = self._flat(part.root, needed, True)
        cols = [c for c in df.columns if c in needed]
        part.root = Node(part.alive(), regroup(df, cols, self.n_measures, BIG), LONG_MAX + 1,
                         mixed=part.mixed(), scan=False)

    # -- conditions that read both sides -----------------------------------------
    def _joint(self, i: int) -> Node:
        """The whole state as one frame with the columns joins from ``i`` on read."""
        if len(self.parts) == 1 and not self.parts[0].root.edges:
            return self.parts[0].root
        alive = set().union(*(p.alive() for p in self.parts)) if self.parts else set()
        cols = sorted(self.chain.physical(r) for r in self.chain.needed_after(i - 1, alive, True))
        types = {c: t for p in self.parts for n in p.nodes() for c, t in
                 ((f.name, f.dataType) for f in n.df.schema)}
        frames = []
        for part in self.parts:
            if part.root.edges:
                self._flatten(part, i)
            df = part.root.df
            missing = {c: F.lit(None).cast(types[c]) for c in cols if c not in df.columns and c in types}
            frames.append(df.withColumns(missing) if missing else df)
        df = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)
        return Node(alive, regroup(df, [c for c in cols if c in df.columns], self.n_measures, BIG),
                    LONG_MAX + 1, mixed=True, scan=False)

    def _profile_joint(self, i: int) -> tuple[Node, list[Column] | None, Counts]:
        """The state as one frame of distinct tuples, its left keys, and the key profile."""
        b = self.chain.joins[i]
        if not self.parts:
            self.parts = [Part(Node({0}, self._empty_state(), 1))]
        state = self._joint(i)
        self.parts = [Part(state)]
        tuples = [c for c in state.df.columns if c != W and c not in measure_names(self.n_measures)]
        df = regroup(state.df, tuples, self.n_measures, weight_type(state.bound))
        state.df = self.shelf.keep(df.where(F.col(W) > 0))  # an anti join leaves weights of 0
        self._left, self._right = self.left_keys(b), self.right_keys(b)
        owner, exprs = self._owner(self.parts[0], b)
        row = self._stats(b, self._left, self._right)
        counts = self._counts(b, row)
        self._hot = self._find_hot(b, row)
        return state, exprs if owner is not None else None, counts

    def _measure_range(self, i: int) -> Counts | None:
        """Counts a join whose further condition is one comparison, or holds a value within an
        interval, by running sums; None if it is neither, or if later joins read columns of
        its right side, unless it is a comparison and they read nothing else."""
        b = self.chain.joins[i]
        one, span, later = comparison(self.chain, b), interval(self.chain, b), self._left_only(i)
        of_right = self._right_only(i) if one is not None and later is None else None
        if (one is None and span is None) or (later is None and of_right is None):
            return None
        left_at, right_at = (span.left, span.right) if span else ({"v": one[0]}, {"v": one[2]})
        state, exprs, counts = self._profile_joint(i)
        refs = {name: self.chain.physical(r) for name, r in left_at.items()}
        if exprs is None or not set(refs.values()) <= set(state.df.columns):
            return None
        keys, at = [f"k{n}" for n in range(len(exprs))], list(refs)
        type_ = span.type_ if span else common_type(state.df.schema[refs["v"]].dataType, b.join.df.schema[one[2]].dataType)
        measures = measure_names(self.n_measures)
        owned = state.df.select("*", *self._cast(b, exprs, "k"), *[quoted(c).cast(type_).alias(n) for n, c in refs.items()])
        left = owned.groupBy(*keys, *at).agg(F.sum(W).alias("lw"), F.count(F.lit(1)).alias("lt"),
                                             *[F.sum(m).alias(m) for m in measures])
        right = b.join.df.select(*self._cast(b, [quoted(c) for c in b.right], "k"),
                                 *[quoted(c).cast(type_).alias(n) for n, c in right_at.items()])
        right = right.groupBy(*keys, *right_at).agg(F.count(F.lit(1)).alias("rw"))
        if span:
            both, right = span.matches(left, right, keys, measures, self.partitions, self._find_repeated(max(counts.rows_before, counts.n_rows)))
        else:
            both = right = range_matches(left, right, keys, one[1], measures, self.partitions, of_right is not None)
        last = i == len(self.chain.joins) - 1
        if not last:
            both = self.shelf.hold(both)
        hit, met = "hits > 0 AND lw > 0", "sum(rw) FILTER (WHERE found > 0)"
        sums = [*self._hit_sums(b, "lw"), *([met] if not span else []), "sum(lt)", "max(lt)"]
        got = both.agg(*[F.expr(e).alias(f"a{n}") for n, e in enumerate(sums)]).first()
        right_rest = 0
        if b.how in ("right", "full"):
            right_rest = counts.n_rows - int((right.agg(F.expr(met)).first()[0] if span else got[-3]) or 0)
        self._count_hits(b, counts, got, right_rest)
        most = int(got[2] or 0)

        def state_after() -> DataFrame:
            needed = {self.chain.physical(r) for r in later}
            cols = [c for c in state.df.columns if c in needed]
            factor = both.where(F.expr(hit)).select(*keys, *at, F.col("hits").alias(W))
            how = {"right": "inner", "full": "left", "semi": "inner", "anti": "left"}.get(b.how, b.how)
            if b.how in ("semi", "anti"):
                factor = factor.withColumn(W, F.lit(1 if b.how == "semi" else 0))
            names = {c: f"__{c}" for c in [*keys, *at]}
            hot = self._hot_keys(both, [*keys, *at], "lt", got[-1], got[-2])
            df = combine(owned.withColumnsRenamed(names), factor, [(n, c) for c, n in names.items()], how,
                         cols, self.n_measures, weight_type(state.bound * max(1, most)), hot_left=hot)
            return df.where(F.col(W) > 0) if b.how == "anti" else df

        if of_right is not None:
            self._next = lambda: self._right_parts(b, state, both, keys, one[2], type_, of_right, counts)
        else:
            self._next = lambda: self._state_parts(b, state, state_after(), most, right_rest)
        return counts

    def _right_parts(self, b: BoundJoin, state: Node, both: DataFrame, keys: list[str], value: str, type_: str,
                     later: set[Ref], counts: Counts) -> list[Part]:
        """The state after a join on one comparison of which only the right side is read later:
        its tuples, each with the left rows that it matches, so that no pairs are formed."""
        measures, weight = measure_names(self.n_measures), weight_type(counts.rows_after)
        cols = sorted(self.chain.physical(r) for r in later)
        rows = b.join.df.select(*self._cast(b, [quoted(c) for c in b.right], "q"), quoted(value).cast(type_).alias("w"),
                                *[quoted(r.column).alias(self.chain.physical(r)) for r in sorted(later, key=str)],
                                F.lit(1).cast("bigint").alias(W))
        at = [*[f"q{n}" for n in range(len(keys))], "w"]
        rows = regroup(rows, at + cols, 0, "bigint")
        few = both.where("found > 0 AND rw > 0").select(*keys, "v", F.col("found").alias(W), *[F.col(f"{m}_found").alias(m) for m in measures])
        df = combine(few, rows, list(zip([*keys, "v"], at)), "right" if b.how in ("right", "full") else "inner", cols,
                     self.n_measures, weight, hot_right=self._find_repeated(counts.n_rows)(rows, at))
        if b.how in ("left", "full"):  # left rows without a match
            rest = regroup(both.where("lw > 0 AND hits = 0").withColumnRenamed("lw", W), [], self.n_measures, weight)
            df = regroup(df.unionByName(rest, allowMissingColumns=True), cols, self.n_measures, weight)
        return [Part(Node(state.inputs | {b.pos}, df, max(1, counts.rows_after), mixed=state.mixed or b.how in ("right", "full"), scan=False))]

    def _find_repeated(self, rows: int) -> Callable[[DataFrame, list[str]], Hot | None]:
        """Finds the values that too many tuples of a frame hold; none are looked for in a
        frame of few rows."""
        def find(df: DataFrame, cols: list[str]) -> Hot | None:
            if rows <= self.hot_floor:
                return None
            sizes = df.groupBy(*map(quoted, cols)).agg(F.count(F.lit(1)).alias("size")).dropna(subset=cols)
            worst, total = sizes.agg(F.max("size"), F.sum("size")).first()
            return self._hot_keys(sizes, cols, "size", worst, total)

        return find

    def _hit_sums(self, b: BoundJoin, w: str) -> list[str]:
        """SQL sums over tuples with weight ``w`` and ``hits``: joined rows, rows with a match,
        most hits, then the measures after the join."""
        hit = f"hits > 0 AND {w} > 0"
        times = {"left": "greatest(hits, 1)", "full": "greatest(hits, 1)", "semi": "1", "anti": "1"}.get(b.how, "hits")
        kept = {"left": "true", "full": "true", "anti": f"NOT ({hit})"}.get(b.how, hit)
        return [f"sum(CAST({w} AS {BIG}) * CAST(hits AS {BIG}))", f"sum({w}) FILTER (WHERE {hit})",
                f"max(hits) FILTER (WHERE {hit})",
                *[f"sum({m} * {times}) FILTER (WHERE {kept})" for m in measure_names(self.n_measures)]]

    def _count_hits(self, b: BoundJoin, counts: Counts, got, right_rest: int) -> int:
        """Fills in what the sums of :meth:`_hit_sums` say."""
        inner, matched = int(got[0] or 0), int(got[1] or 0)
        unmatched = counts.rows_before - matched
        counts.rows_after = {
            "inner": inner, "left": inner + unmatched, "right": inner + right_rest,
            "full": inner + unmatched + right_rest, "semi": matched, "anti": unmatched}[b.how]
        counts.matched, counts.one_per_key = matched, None
        counts.measures = self._scaled([tuple(got[3 + 2 * m:5 + 2 * m]) for m in range(self.n_measures)])
        if not b.right:
            counts.left_max_dup = counts.left_max_dup_non_null = None
        return right_rest

    def _state_parts(self, b: BoundJoin, state: Node, df: DataFrame, most: int, right_rest: int) -> list[Part]:
        parts = [Part(Node(state.inputs, df, state.bound * max(1, most), mixed=state.mixed, scan=False))]
        if b.how in ("right", "full") and right_rest > 0:
            rest = self.spark.range(1).select(F.lit(right_rest).cast("bigint").alias(W))
            parts.append(Part(Node({b.pos}, self._no_measures(rest), right_rest)))
        return parts

    def _left_only(self, i: int) -> set[Ref] | None:
        """What later joins read, unless that includes the right side of join ``i``."""
        b = self.chain.joins[i]
        alive = set().union(*(p.alive() for p in self.parts)) if self.parts else set()
        later = self.chain.needed_after(i, alive | {b.pos}, mixed=True)
        return None if any(r.alias == b.join.alias for r in later) else later

    def _right_only(self, i: int) -> set[Ref] | None:
        """What later joins read, if all of it is of the right side of join ``i``."""
        b = self.chain.joins[i]
        alive = set().union(*(p.alive() for p in self.parts)) if self.parts else set()
        later = self.chain.needed_after(i, alive | {b.pos}, mixed=True)
        return later if all(r.alias == b.join.alias for r in later) else None

    def _measure_any(self, i: int) -> Counts | None:
        """Counts a join whose further condition is equalities joined by OR; None if it is
        not, or if later joins read columns of its right side."""
        b = self.chain.joins[i]
        found, later = alternatives(self.chain, b), self._left_only(i)
        if found is None or later is None:
            return None
        state, exprs, counts = self._profile_joint(i)
        lefts = [self.chain.physical(r) for r, _ in found]
        if exprs is None or not set(lefts) <= set(state.df.columns):
            return None
        keys, n = [f"k{m}" for m in range(len(exprs))], len(found)
        types = [compared_type(self.spark, state.df.schema[c].dataType, b.join.df.schema[r].dataType)
                 for c, (_, r) in zip(lefts, found)]

        def as_compared(columns: list[str], name: str) -> list[Column]:
            return [(quoted(c).cast(t) if t else quoted(c)).alias(f"{name}{j}") for j, (c, t) in enumerate(zip(columns, types))]

        owned = state.df.select("*", *self._cast(b, exprs, "k"), *as_compared(lefts, "x"))
        right = b.join.df.select(*self._cast(b, [quoted(c) for c in b.right], "k"), *as_compared([c for _, c in found], "y"))

        hits = with_hits(owned, right, keys, n, self._find_repeated(counts.rows_before))
        last = i == len(self.chain.joins) - 1
        if not last:
            hits = self.shelf.keep(hits)
        got = hits.agg(*[F.expr(e).alias(f"a{m}") for m, e in enumerate(self._hit_sums(b, W))]).first()
        rest = 0
        if b.how in ("right", "full"):
            met = met_rows(owned, right, keys, n, self._find_repeated(counts.n_rows))
            rest = counts.n_rows - int(met.first()[0])
        self._count_hits(b, counts, got, rest)
        most = int(got[2] or 0)

        def state_after() -> DataFrame:
            type_ = weight_type(state.bound * max(1, most))
            times = {"left": "greatest(hits, 1)", "full": "greatest(hits, 1)", "semi": "if(hits > 0, 1, 0)",
                     "anti": "if(hits > 0, 0, 1)"}.get(b.how, "hits")
            df = hits.withColumns({c: F.expr(f"{c} * {times}").cast(t) for c, t in zip(measure_names(self.n_measures), self.measure_types)}
                                  | {W: F.expr(f"CAST({W} AS {type_}) * CAST({times} AS {type_})").cast(type_)})
            needed = {self.chain.physical(r) for r in later}
            return regroup(df.where(F.col(W) > 0), [c for c in state.df.columns if c in needed],
                           self.n_measures, type_)

        self._next = lambda: self._state_parts(b, state, state_after(), most, rest)
        return counts

    def _measure_real(self, i: int) -> Counts:
        """Counts a join whose condition compares both sides beyond key equality: the
        distinct tuples the condition reads are joined, with their weights."""
        b = self.chain.joins[i]
        last = i == len(self.chain.joins) - 1
        state, exprs, counts = self._profile_joint(i)
        keys = bool(b.right)

        alive = state.inputs | {b.pos}
        mixed = state.mixed or b.how in ("right", "full")
        needed = {self.chain.physical(r) for r in self.chain.needed_after(i, alive, mixed)}
        physical = {self.chain.physical(Ref(b.join.alias, c)): c for c in b.join.df.columns}
        read = sorted({*b.right, *b.residual_right, *(physical[c] for c in needed if c in physical)})
        right = self.chain.frame(b.pos, read).withColumn(W, F.lit(1).cast("bigint"))
        right = regroup(right, [c for c in right.columns if c != W], 0, "bigint")
        right = self.chain.as_structs(right, [Ref(b.join.alias, c) for c in read])
        left = state.df
        for r in b.residual_left:
            if self.chain.physical(r) not in left.columns:  # that input is missing throughout
                type_ = self.chain.inputs[self.chain.pos[r.alias.lower()]][1].schema[r.column].dataType
                left = left.withColumn(self.chain.physical(r), F.lit(None).cast(type_))
        left = self.chain.as_structs(left, list(b.residual_left))
        cond = F.expr(b.join.residual)
        pairs = []
        if keys and exprs is not None:
            left = left.withColumns({f"__k{n}": e for n, e in enumerate(exprs)})
            pairs = [(f"__k{n}", self.chain.physical(Ref(b.join.alias, c))) for n, c in enumerate(b.right)]
        elif keys:
            cond = F.lit(False)
        cols = sorted(c for c in needed if c in left.columns or c in right.columns)
        if b.how in ("semi", "anti"):
            cols = [c for c in cols if c in left.columns]
        total = max(1, counts.rows_before) * max(1, counts.n_rows)
        # at least one side's weight per pair, hence no more than all pairs plus both sides
        bound = total + counts.rows_before + counts.n_rows
        # one side's hot keys are spread and the other side copied, where that adds no rows
        hot = {"hot_left": self._hot[0]} if b.how in ("inner", "left", "semi", "anti") else {"hot_right": self._hot[1]} if b.how == "right" else {}
        df = combine(left, right, pairs, b.how, cols, self.n_measures, weight_type(bound), condition=cond,
                     join=None if keys else without_pairs(self.chain, b, self.partitions), **(hot if pairs else {}))
        if not last:
            df = self.shelf.keep(df)
        got = df.agg(F.sum(F.col(W).cast(BIG)), *[F.sum(m) for m in measure_names(self.n_measures)]).first()
        rows = int(got[0] or 0)
        self._next = lambda: [Part(Node(alive, df, max(1, rows), mixed=mixed))]
        return Counts(
            rows_before=counts.rows_before, rows_after=rows,
            left_max_dup=counts.left_max_dup if keys else None,
            left_max_dup_non_null=counts.left_max_dup_non_null if keys else None,
            n_rows=counts.n_rows, n_keys=counts.n_keys, max_dup=counts.max_dup,
            max_dup_non_null=counts.max_dup_non_null, dup_keys=counts.dup_keys,
            null_rows=counts.null_rows,
            measures=self._scaled([(got[1 + 2 * m], got[2 + 2 * m]) for m in range(self.n_measures)]))

    def _empty_state(self) -> DataFrame:
        cols = sorted(self.chain.needed_after(-1, set(self.chain.pos.values())), key=str)
        df = self.chain.inputs[0][1].select(
            *[F.lit(None).cast(self.chain.inputs[self.chain.pos[r.alias.lower()]][1]
                               .schema[r.column].dataType).alias(self.chain.physical(r)) for r in cols],
            F.lit(0).cast("bigint").alias(W)).where(F.lit(False))
        return self._no_measures(df)

    def totals(self) -> tuple[int, list[tuple]]:
        """Rows and measures of the whole state."""
        rows, sums = 0, [(None, 0)] * self.n_measures
        for part in self.parts:
            df = self._fold(part.root)
            got = df.agg(F.sum(F.col(W).cast(BIG)), *[F.sum(m) for m in measure_names(self.n_measures)]).first()
            rows += int(got[0] or 0)
            own = self._scaled([(got[1 + 2 * m], got[2 + 2 * m]) for m in range(self.n_measures)])
            sums = [(s if old is None else old if s is None else EXACT.add(old, s) if isinstance(s, Decimal) else old + s, n + (c or 0))
                    for (old, n), (s, c) in zip(sums, own)]
        return rows, sums
