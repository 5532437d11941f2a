"""Counting matches of equalities joined by OR, one equality join per combination.

A right row meets at least one of the alternatives; adding the rows that meet each one,
taking off those that meet two, and so on counts every right row once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.plans.spec import BoundChain, BoundJoin, Ref, quoted
from grainwise.plans.weights import Hot, equal, salted

#: Beyond, combinations are too many, and joining per alternative is cheaper (pairs.py).
MAX_ALTERNATIVES = 4
_EQUALITY = re.compile(r"\(?\s*([^\W\d]\w*)\.(\w+)\s*=\s*([^\W\d]\w*)\.(\w+)\s*\)?")

FindHot = Callable[[DataFrame, Sequence[str]], Hot | None]


def alternatives(chain: BoundChain, b: BoundJoin, most: int | None = MAX_ALTERNATIVES) -> list[tuple[Ref, str]] | None:
    """``(left column, right column)`` per alternative, if the further condition of ``b`` is
    nothing but up to ``most`` equalities between the sides joined by OR."""
    out = []
    own = b.join.alias.lower()
    for text in re.split(r"\s+OR\s+", (b.join.residual or "").strip(), flags=re.IGNORECASE):
        m = _EQUALITY.fullmatch(text.strip())
        if not m or (m[1].lower() == own) == (m[3].lower() == own):
            return None
        left, right = ((m[3], m[4]), (m[1], m[2])) if m[1].lower() == own else ((m[1], m[2]), (m[3], m[4]))
        ref, column = chain.ref(".".join(left)), chain.has(b.pos, right[1])
        if column is None:
            return None
        out.append((ref, column))
    return out if most is None or len(out) <= most else None


def subsets(n: int) -> Iterator[tuple[int, ...]]:
    for size in range(1, n + 1):
        yield from combinations(range(n), size)


def lookup(many: DataFrame, few: DataFrame, pairs: Sequence[tuple[str, str]], hot: Hot | None) -> DataFrame:
    """``many`` with the columns of its row in ``few`` (one per key) or NULLs; hot keys are spread."""
    on = equal(pairs)
    if hot is not None:
        many, few = salted(many, few, [a for a, _ in pairs], [b for _, b in pairs], hot)
        on = on & (F.col("__m") == F.col("__f"))
    return many.join(few, on, "left").drop("__m", "__f", *[b for _, b in pairs])


def with_hits(state: DataFrame, right: DataFrame, keys: Sequence[str], n: int, find_hot: FindHot) -> DataFrame:
    """Adds ``hits``, the matching right rows of each tuple.

    ``state`` has columns ``k<i>`` and ``x<j>``, ``right`` has ``k<i>`` and ``y<j>``.
    """
    hits, tuples = F.lit(0).cast("bigint"), state
    for s in subsets(n):
        tag = "".join(map(str, s))
        own = [f"__q{tag}_{m}" for m in range(len(keys))] + [f"__y{tag}_{j}" for j in s]
        cols = [*keys, *[f"y{j}" for j in s]]
        counted = right.select(*[quoted(c).alias(o) for c, o in zip(cols, own)]).dropna()
        counted = counted.groupBy(*own).agg(F.count(F.lit(1)).alias(f"__n{tag}"))
        on = [*keys, *[f"x{j}" for j in s]]
        state = lookup(state, counted, list(zip(on, own)), find_hot(tuples, on))
        found = F.coalesce(F.col(f"__n{tag}"), F.lit(0))
        hits = hits + found if len(s) % 2 else hits - found
    return state.withColumn("hits", hits).drop(*[f"__n{''.join(map(str, s))}" for s in subsets(n)])


def met_rows(state: DataFrame, right: DataFrame, keys: Sequence[str], n: int, find_hot: FindHot) -> DataFrame:
    """One row ``rows``: right rows that meet some tuple of the state."""
    cols = [*keys, *[f"y{j}" for j in range(n)]]
    right = tuples = right.groupBy(*cols).agg(F.count(F.lit(1)).alias("rw"))
    for j in range(n):
        own = [f"__q{j}_{m}" for m in range(len(keys))] + [f"__x{j}"]
        there = state.select(*[quoted(c).alias(o) for c, o in zip([*keys, f"x{j}"], own)]).dropna().distinct()
        on = [*keys, f"y{j}"]
        right = lookup(right, there.withColumn(f"__on{j}", F.lit(True)), list(zip(on, own)),
                       find_hot(tuples, on))
    met = F.coalesce(*[F.col(f"__on{j}") for j in range(n)]).isNotNull()
    return right.agg(F.coalesce(F.sum(F.when(met, F.col("rw"))), F.lit(0)).alias("rows"))
