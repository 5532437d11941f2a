"""The joined rows themselves: used for sample rows, rewrites and conditions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.plans.spec import BoundChain, BoundJoin, JoinChain, Ref, quoted

_SPARK_HOW = {"inner": "inner", "left": "left", "right": "right", "full": "full",
              "semi": "left_semi", "anti": "left_anti"}


def unique_names(names: Sequence[str]) -> list[str]:
    """``a, a`` becomes ``a, a_1``; a suffix that is taken already is skipped."""
    taken, out = set(names), []
    seen: dict[str, int] = {}
    for name in names:
        n = seen.get(name, 0)
        seen[name] = n + 1
        new = name
        while n and (new := f"{name}_{n}") in taken:
            n += 1
        taken.add(new)
        out.append(new)
    return out


def join_physical(chain: BoundChain, left: DataFrame, right: DataFrame, b: BoundJoin,
                  salt: tuple[str, str] | None = None) -> DataFrame:
    """Joins frames whose columns carry physical names; ``salt`` names a further column of the
    left and the right side that must be equal and that the result leaves out."""
    terms = [] if salt is None else [quoted(salt[0]) == quoted(salt[1])]
    for candidates, c in zip(b.left, b.right):
        names = [quoted(chain.physical(r)) for r in candidates]
        key = names[0] if len(names) == 1 else F.coalesce(*names)
        terms.append(key == quoted(chain.physical(Ref(b.join.alias, c))))
    drop: list[str] = list(salt or [])
    if b.join.residual is not None:
        l_cols, r_cols = left.columns, right.columns
        left = chain.as_structs(left, list(b.residual_left))
        # the right side's columns also resolve bare, as in a plain SQL condition
        right = chain.as_structs(right, [Ref(b.join.alias, c) for c in chain.columns[b.pos]])
        drop += [c for c in left.columns if c not in l_cols] + [c for c in right.columns if c not in r_cols]
        terms.append(F.expr(b.join.residual))
    if not terms:
        return left.crossJoin(right)
    out = left.join(right, reduce(lambda x, y: x & y, terms), _SPARK_HOW[b.how])
    return out.drop(*drop) if drop else out


def prefix_physical(chain: BoundChain, upto: int) -> DataFrame:
    """The first ``upto`` joins with physical column names."""
    out = chain.frame(0, chain.columns[0])
    for b in chain.joins[:upto]:
        out = join_physical(chain, out, chain.frame(b.pos, chain.columns[b.pos]), b)
    return out


def displayed(chain: BoundChain, df: DataFrame, upto: int) -> DataFrame:
    """Plain column names; a merged USING or NATURAL column appears once."""
    exprs: dict[str, object] = {}
    names: dict[str, str] = {}
    for pos, (alias, _) in enumerate(chain.inputs[:upto + 1]):
        if pos and chain.joins[pos - 1].how in ("semi", "anti"):
            continue
        merged = {}
        if pos and (chain.joins[pos - 1].using or chain.joins[pos - 1].natural):
            b = chain.joins[pos - 1]
            merged = {c: candidates[0] for c, candidates in zip(b.right, b.left)}
        for c in chain.columns[pos]:
            physical = chain.physical(Ref(alias, c))
            if c in merged:
                first = chain.physical(merged[c])
                exprs[first] = F.coalesce(exprs[first], quoted(physical))
            else:
                exprs[physical], names[physical] = quoted(physical), c
    final = unique_names(list(names.values()))
    return df.select(*[e.alias(n) for e, n in zip(exprs.values(), final)])


def joined_rows(chain: JoinChain, upto: int | None = None) -> DataFrame:
    bound = chain.bind()
    upto = len(bound.joins) if upto is None else upto
    return displayed(bound, prefix_physical(bound, upto), upto)
