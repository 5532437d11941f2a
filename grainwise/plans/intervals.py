"""Counting matches of a value within an interval without joining.

Of the intervals that hold no contradiction, those around a value are the ones that have
started up to it less the ones that have ended; the values within an interval are those up to
its end less those up to its start.  Both are differences of running sums.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainwise.plans.alternatives import FindHot, lookup
from grainwise.plans.pairs import BETWEEN, SIDES
from grainwise.plans.ranges import MIRRORED, common_type, cut_points, running
from grainwise.plans.spec import BoundChain, BoundJoin, Ref, quoted


@dataclass(frozen=True)
class Interval:
    """A condition ``low <= value < high`` whose value stands on one side and whose bounds
    stand on the other; ``closed`` says which bounds belong to the interval."""

    left: dict[str, Ref]  # "v", or "lo" and "hi"
    right: dict[str, str]
    closed: tuple[bool, bool]
    type_: str

    def matches(self, left: DataFrame, right: DataFrame, keys: Sequence[str], extra: Sequence[str], partitions: int,
                find_hot: FindHot) -> tuple[DataFrame, DataFrame]:
        """``left`` with ``hits``, the right rows (``rw``) that each of its rows matches, and
        ``right`` with ``found``, the left rows (``lw``)."""
        if "v" in self.left:
            return around(left, right, "lw", "rw", "hits", "found", keys, self.closed, extra, partitions, find_hot)
        found, hits = around(right, left, "rw", "lw", "found", "hits", keys, self.closed, [], partitions, find_hot)
        return hits, found


def interval(chain: BoundChain, b: BoundJoin) -> Interval | None:
    """The interval that the further condition of ``b`` is, if it is nothing else."""
    parts = re.split(r"\s+AND\s+", BETWEEN.sub(r"\1 >= \2 AND \1 <= \3", (b.join.residual or "").strip()), flags=re.IGNORECASE)
    sides = [SIDES.fullmatch(p.strip()) for p in parts]
    if len(parts) != 2 or not all(sides):
        return None
    own, seen = b.join.alias.lower(), []
    for m in sides:
        if (m[1].lower() == own) == (m[4].lower() == own):
            return None
        left, op, right = ((m[4], m[5]), MIRRORED[m[3]], m[2]) if m[1].lower() == own else ((m[1], m[2]), m[3], m[5])
        column = chain.has(b.pos, right)
        if column is None:
            return None
        seen.append((chain.ref(".".join(left)), op, column))
    seen.sort(key=lambda x: x[1][0], reverse=True)  # the comparison with > first
    (above, more, one), (below, less, other) = seen
    if more[0] != ">" or less[0] != "<":
        return None
    if above == below:  # left value > right bound, left value < right bound
        at, closed = ({"v": above}, {"lo": one, "hi": other}), ("=" in more, "=" in less)
    elif one == other:  # left bound > right value, left bound < right value
        at, closed = ({"lo": below, "hi": above}, {"v": one}), ("=" in less, "=" in more)
    else:
        return None

    def kind(ref: Ref) -> T.DataType:
        return chain.inputs[chain.pos[ref.alias.lower()]][1].schema[ref.column].dataType

    types = {common_type(kind(ref), b.join.df.schema[c].dataType) for ref, _, c in seen}
    return Interval(*at, closed, types.pop()) if len(types) == 1 and None not in types else None


def around(points: DataFrame, spans: DataFrame, pw: str, sw: str, p_hits: str, s_hits: str, keys: Sequence[str],
           closed: tuple[bool, bool], extra: Sequence[str], partitions: int, find_hot: FindHot) -> tuple[DataFrame, DataFrame]:
    """``points`` (``keys, v``, weight ``pw``, ``extra``) with the weight ``p_hits`` of the spans
    around each, and ``spans`` (``keys, lo, hi``, weight ``sw``) with the weight ``s_hits`` of the
    points within each.  Rows are distinct tuples.  Spans that end before they start, and NULLs,
    match nothing."""
    from_low, to_high = closed
    own = [quoted(k) for k in keys]
    sums = [pw, *[c for c in points.columns if c in ("lt", *extra)]]

    def whole(cols: Sequence[Column]) -> Column:
        return reduce(lambda x, y: x & y, [c.isNotNull() for c in cols])

    fits = F.col("lo") <= F.col("hi") if from_low and to_high else F.col("lo") < F.col("hi")
    valid = whole([*own, F.col("v")])
    sound = F.coalesce(whole([*own, F.col("lo"), F.col("hi")]) & fits, F.lit(False))
    some, other = points.where(valid), spans.where(sound)
    starts = other.select(*own, F.col("lo").alias("v"), F.col(sw).alias("s"))
    ends = other.select(*own, F.col("hi").alias("v"), F.col(sw).alias("e"))
    events = some.unionByName(starts, allowMissingColumns=True).unionByName(ends, allowMissingColumns=True)
    cuts = cut_points(events.select("v"), partitions)
    weights = [pw, "s", "e"]
    events = events.groupBy(*own, "v").agg(*[F.sum(c).alias(c) for c in [*sums, "s", "e"]]).fillna(0, weights)
    events = running(events, keys, weights, cuts)

    started = F.col("s_upto") if from_low else F.col("s_upto") - F.col("s")
    ended = F.col("e_upto") - F.col("e") if to_high else F.col("e_upto")
    rest = points.where(~valid).withColumn(p_hits, F.lit(0))
    around_each = events.where(F.col(pw) > 0).select(*own, "v", *sums, (started - ended).alias(p_hits))
    around_each = around_each.unionByName(rest.select(*around_each.columns))

    # points up to a place, without those at it where the bound lets them in (low) or not (high)
    below = F.col(f"{pw}_upto") - F.col(pw)
    low, high = (below if from_low else F.col(f"{pw}_upto")), (F.col(f"{pw}_upto") if to_high else below)
    for name, value in (("lo", low), ("hi", high)):
        there = [f"__{name}_{k}" for k in [*keys, "v"]]
        sums_here = events.select(*[quoted(k).alias(t) for k, t in zip([*keys, "v"], there)], value.alias(f"__{name}"))
        other = lookup(other, sums_here, list(zip([*keys, name], there)), find_hot(other, [*keys, name]))
    other = other.withColumn(s_hits, F.col("__hi") - F.col("__lo")).drop("__hi", "__lo")
    return around_each, other.unionByName(spans.where(~sound).withColumn(s_hits, F.lit(0)))
