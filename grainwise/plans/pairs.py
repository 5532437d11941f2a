"""Joins of distinct tuples on conditions that compare both sides, by equality joins.

Equalities joined by OR become one join per alternative.  A value of the left side held
against bounds of the right side becomes a join on ranges of the value: a left row lies in
one range, a right row is copied to those that its bounds reach.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.plans.alternatives import alternatives
from grainwise.plans.ranges import MIRRORED, bucket_of, common_type, cut_points
from grainwise.plans.spec import BoundChain, BoundJoin, Ref

Join = Callable[[DataFrame, DataFrame, Column, str], DataFrame]

SIDES = re.compile(r"\(?\s*([^\W\d]\w*)\.(\w+)\s*(<=|>=|<|>)\s*([^\W\d]\w*)\.(\w+)\s*\)?")
BETWEEN = re.compile(r"([^\W\d]\w*\.\w+)\s+BETWEEN\s+([^\W\d]\w*\.\w+)\s+AND\s+([^\W\d]\w*\.\w+)", re.IGNORECASE)


@dataclass
class Bounds:
    """A left column and the right columns that bound it; ``type_`` orders them all."""

    left: Ref
    lower: list[str] = field(default_factory=list)
    upper: list[str] = field(default_factory=list)
    type_: str = ""


def bounds(chain: BoundChain, b: BoundJoin) -> Bounds | None:
    """The left column that the further condition of ``b`` bounds most often, if all of its
    parts must hold."""
    text = BETWEEN.sub(r"\1 >= \2 AND \1 <= \3", b.join.residual or "")
    if re.search(r"\b(OR|NOT|CASE)\b", text, re.IGNORECASE):
        return None
    found: dict[Ref, Bounds] = {}
    own = b.join.alias.lower()
    for part in re.split(r"\s+AND\s+", text.strip(), flags=re.IGNORECASE):
        m = SIDES.fullmatch(part.strip())
        if not m or (m[1].lower() == own) == (m[4].lower() == own):
            continue
        left, op, right = ((m[4], m[5]), MIRRORED[m[3]], m[2]) if m[1].lower() == own else ((m[1], m[2]), m[3], m[5])
        ref, column = chain.ref(".".join(left)), chain.has(b.pos, right)
        if column is None:
            continue
        kinds = chain.inputs[chain.pos[ref.alias.lower()]][1].schema[ref.column].dataType, b.join.df.schema[column].dataType
        type_ = common_type(*kinds)
        at = found.setdefault(ref, Bounds(ref, type_=type_ or ""))
        if type_ and type_ == at.type_:
            (at.lower if op in (">", ">=") else at.upper).append(column)
    some = [x for x in found.values() if x.lower or x.upper]
    return max(some, key=lambda x: (bool(x.lower) + bool(x.upper), len(x.lower) + len(x.upper)), default=None)


def without_pairs(chain: BoundChain, b: BoundJoin, partitions: int) -> Join | None:
    """How to join ``b`` without keys by equality joins; None if its condition allows none."""
    by_or = alternatives(chain, b, most=None)
    if by_or is not None:
        return lambda left, right, condition, how: join_any(
            left, right, [F.expr(f"{ref.alias}.`{ref.column}`") == F.expr(f"{b.join.alias}.`{c}`") for ref, c in by_or], how)
    found = bounds(chain, b)
    if found is None:
        return None
    return lambda left, right, condition, how: join_ranges(left, right, found, b.join.alias, condition, how, partitions)


def _and_left_over(joined: list[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), joined)


def join_any(left: DataFrame, right: DataFrame, equalities: list[Column], how: str) -> DataFrame:
    """``left`` joined to ``right`` where any equality holds: a pair belongs to the first one."""
    def unmatched(these: DataFrame, those: DataFrame) -> DataFrame:
        return reduce(lambda rest, e: rest.join(those, e, "left_anti"), equalities, these)

    if how == "left_anti":
        return unmatched(left, right)
    out, rest = [], left
    for n, e in enumerate(equalities):
        if how == "left_semi":
            out.append(rest.join(right, e, how))
            rest = rest.join(right, e, "left_anti")
        else:
            earlier = [~F.coalesce(x, F.lit(False)) for x in equalities[:n]]
            out.append(left.join(right, reduce(lambda x, y: x & y, earlier, e), "inner"))
    if how in ("left", "full"):
        out.append(unmatched(left, right))
    if how in ("right", "full"):
        out.append(unmatched(right, left))
    return _and_left_over(out)


def join_ranges(left: DataFrame, right: DataFrame, found: Bounds, alias: str, condition: Column, how: str,
                partitions: int) -> DataFrame:
    """``left`` joined to ``right`` on a condition that keeps a left value within bounds."""
    value = F.expr(f"{found.left.alias}.`{found.left.column}`").cast(found.type_)
    lower, upper = ([F.expr(f"{alias}.`{c}`").cast(found.type_) for c in cs] for cs in (found.lower, found.upper))
    values = left.select(value.alias("v"))
    for bound in lower + upper:
        values = values.union(right.select(bound))
    cuts = cut_points(values, partitions)
    first = F.greatest(*[bucket_of(x, cuts) for x in lower], F.lit(0), F.lit(0)) if lower else F.lit(0)
    last = F.least(*[bucket_of(x, cuts) for x in upper], F.lit(len(cuts)), F.lit(len(cuts))) if upper else F.lit(len(cuts))
    complete = reduce(lambda x, y: x & y, [x.isNotNull() for x in lower + upper])
    reach = F.when(complete & (first <= last), F.sequence(first, last))
    # Spark takes the copies for as few as the rows, and would send them to the driver
    copies = right.withColumn("__at", F.explode(reach)).hint("merge")
    placed = left.withColumn("__in", bucket_of(value, cuts))
    on = (F.col("__in") == F.col("__at")) & condition
    if how in ("left_semi", "left_anti"):
        return placed.join(copies, on, how).drop("__in")
    out = placed.join(copies, on, "left" if how in ("left", "full") else "inner").drop("__in", "__at")
    if how not in ("right", "full"):
        return out
    met = copies.join(placed, on, "left_semi").drop("__at").distinct().alias("m")
    mine = right.alias("r")
    same = reduce(lambda x, y: x & y, [F.col(f"r.`{c}`").eqNullSafe(F.col(f"m.`{c}`")) for c in right.columns])
    return _and_left_over([out, mine.join(met, same, "left_anti").select(*[F.col(f"r.`{c}`") for c in right.columns])])
