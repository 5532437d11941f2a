"""Aggregates whose value changes because rows are repeated."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from grainwise.plans.spec import Agg, BoundChain

# Aggregates that repetition cannot change.
SAFE = ("min", "max", "any_value")
QUANTIFIED = ("sum", "count", "avg")


@dataclass
class Risk:
    expression: str
    kind: str
    columns: list[str]
    affected_joins: list[int]
    base_value: float | None
    joined_value: float | None
    inflation_pct: float | None
    note: str
    base_exact: str | None = None
    joined_exact: str | None = None


def aliases_of(chain: BoundChain, agg: Agg) -> tuple[set[int], bool]:
    """Inputs an aggregate reads, and whether some column names no input."""
    inputs, unqualified = set(), False
    for c in chain.agg_columns(agg):
        alias, dot, _ = c.partition(".")
        if dot and alias.lower() in chain.pos:
            inputs.add(chain.pos[alias.lower()])
        else:
            unqualified = True
    return inputs, unqualified


def quantified(chain: BoundChain, agg: Agg) -> bool:
    """SUM, COUNT and AVG over the driving table alone (or over rows) get values."""
    inputs, unqualified = aliases_of(chain, agg)
    return agg.kind in QUANTIFIED and not agg.distinct and not unqualified and inputs <= {0}


def measure_columns(chain: BoundChain) -> tuple[list[Agg], list[Column]]:
    """The expressions whose weighted sums the measurement carries along."""
    aggs = [a for a in chain.chain.aggs if a.expr is not None and quantified(chain, a)]
    distinct = list({a.expr: a for a in aggs}.values())
    # COUNT only needs to know which values are NULL
    counted = {a.expr for a in aggs if a.kind != "count"}
    return distinct, [F.expr(a.expr) if a.expr in counted else F.when(F.expr(a.expr).isNotNull(), 0)
                      for a in distinct]


# What is said of an affected aggregate.
NOTES = {"sum": "Values of repeated rows are added more than once.", "avg": "Repeated rows weigh more than others.",
         "rows": "Copies are counted as rows.", "other": "Repeated rows change the value."}


def repeated_inputs(chain: BoundChain, steps: list) -> dict[int, set[int]]:
    """Per input position, the numbers of the joins that repeat its rows.

    A join that multiplies rows repeats what was joined before or after it, and its own
    right side only if both sides repeat the key."""
    found: dict[int, set[int]] = {p: set() for p in range(len(chain.inputs))}
    for s in (s for s in steps if s.fanout):
        own = s.index + 1
        for p in found.keys() - (set() if s.cardinality == "many-to-many" else {own}):
            found[p].add(own)
    return found


def measured(agg: Agg, steps: list, pairs: dict[str, tuple]) -> tuple:
    """The aggregate before and after the joins; ``pairs`` holds, per expression, (sum,
    non-NULL count) at either end."""
    if agg.expr is None:
        return steps[0].rows_before, steps[-1].rows_after
    return tuple(_value(agg.kind, pair) for pair in pairs[agg.expr])


def risks_of(chain: BoundChain, steps: list, base: list[tuple], joined: list[tuple],
             carried: list[Agg]) -> list[Risk]:
    """The aggregates that repeated rows change; ``base`` and ``joined`` hold (sum, non-NULL
    count) per carried expression."""
    repeats = repeated_inputs(chain, steps)
    if not any(repeats.values()):
        return []
    pairs = {a.expr: (base[n], joined[n]) for n, a in enumerate(carried)}
    return [_risk(chain, agg, sorted(joins), *(measured(agg, steps, pairs) if quantified(chain, agg) else (None, None)))
            for agg in chain.chain.aggs if agg.kind not in SAFE and not agg.distinct
            for joins in [_joins_of(chain, agg, repeats)] if joins]


def _joins_of(chain: BoundChain, agg: Agg, repeats: dict[int, set[int]]) -> set[int]:
    """Joins that repeat what the aggregate reads: rows of any input if it names none."""
    inputs, unqualified = aliases_of(chain, agg)
    return set().union(*(repeats[p] for p in (inputs if inputs and not unqualified else repeats)))


def _risk(chain: BoundChain, agg: Agg, joins: list[int], before, after) -> Risk:
    pct = float((after / before - 1) * 100) if before and after is not None else None
    rows = agg.kind == "count" and agg.expr is None
    return Risk(agg.text, agg.kind, chain.agg_columns(agg), joins, _number(before), _number(after), pct,
                NOTES["rows"] if rows else NOTES.get(agg.kind, NOTES["other"]), _exact(before), _exact(after))


def _number(value) -> float | None:
    return None if value is None else float(value)


def _exact(value) -> str | None:
    """Sums of integers and decimals, and counts, digit by digit; None for floating point."""
    return None if value is None or isinstance(value, float) else format(value, "f") if isinstance(value, Decimal) else str(value)


def _value(kind: str, pair: tuple):
    total, count = pair
    if kind == "count":
        return int(count or 0)
    if not count:
        return None
    return total if kind == "sum" else float(total) / float(count)
