"""Right sides and joins that no longer multiply rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainwise.errors import AuditError
from grainwise.operators.profile import distinct_rows, hashable, holds
from grainwise.plans.spec import JoinChain, quoted

# Name parts that hint at a column telling rows apart by age, in order
# of preference.
ORDER_HINTS = ("updated", "modified", "created", "date", "time", "_ts", "version", "seq")
ROW_COUNT = "_row_count"


def pick_order_col(columns: Sequence[str], keys: Sequence[str]) -> str | None:
    """The non-key column that decides which row is the latest."""
    key_set = {k.lower() for k in keys}
    rest = [c for c in columns if c.lower() not in key_set]
    hinted = (c for hint in ORDER_HINTS for c in rest if hint in c.lower())
    return next(hinted, rest[0] if rest else None)


def measure_fn(dtype: T.DataType) -> str:
    """SUM for numbers, MAX for the rest, ANY_VALUE where no order exists."""
    if isinstance(dtype, T.NumericType):
        return "SUM"
    return "ANY_VALUE" if holds(dtype, T.MapType, T.VariantType) else "MAX"


def pre_aggregate(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """One row per key: measures summed (or their maximum), and the row count."""
    fns = {"SUM": F.sum, "MAX": F.max, "ANY_VALUE": F.any_value}
    return df.groupBy(*map(quoted, keys)).agg(
        *[fns[measure_fn(df.schema[m].dataType)](quoted(m)).alias(m) for m in measures],
        F.count(F.lit(1)).alias(ROW_COUNT))


def keep_latest(df: DataFrame, keys: Sequence[str], order_col: str | None = None, read: Sequence[str] | None = None) -> DataFrame:
    """One row per key, the one with the greatest ``order_col``; the remaining columns
    break ties in column order.

    ``read`` names the columns that are read of it (default: all).  Columns that break ties
    after the last of these are left out before the shuffle: rows that tie up to there agree in all
    that is read.

    An aggregate instead of a window: every task keeps one row per key (by sorting its
    own rows, since the winner is a whole row), so a key with very many rows is reduced
    before the shuffle.
    """
    key_set = {k.lower() for k in keys}
    rest = [c for c in df.columns if c.lower() not in key_set]
    first = order_col or pick_order_col(df.columns, keys)
    if not rest:
        return df.select(*map(quoted, keys)).distinct()
    order = [c for c in dict.fromkeys([first, *rest])
             if not holds(df.schema[c].dataType, T.MapType, T.VariantType)]
    wanted = None if read is None else {c.lower() for c in read} - key_set
    if wanted is not None and wanted <= {c.lower() for c in order}:
        last = max((n for n, c in enumerate(order) if c.lower() in wanted), default=0)
        if hashable(df.select(*map(quoted, order[:last + 1]))):
            order = order[:last + 1]
            rest = [c for c in rest if c in order] or rest[:1]
    row, ranked = F.struct(*map(quoted, rest)), F.struct(*map(quoted, order))
    # the row itself is the order, unless some column has none
    best = F.max(ranked) if set(order) == set(rest) else F.max_by(row, ranked) if order else F.any_value(row)
    kept = df.groupBy(*map(quoted, keys)).agg(best.alias("__row"))
    by_name = {c: F.col("__row").getField(c) for c in rest}
    return kept.select(*[by_name[c].alias(c) if c in by_name else quoted(c) for c in df.columns if c in by_name or c.lower() in key_set])


def measures_used(chain: JoinChain, i: int) -> list[str]:
    """Non-key columns of joined input ``i`` that the query reads."""
    bound = chain.bind()
    used, star = bound.used_columns(i)
    keys = {k.lower() for k in bound.joins[i].right}
    if star:
        used = sorted(bound.columns[i + 1])
    return [c for c in used if c.lower() not in keys]


def rewrite_chain(chain: JoinChain, i: int, kind: str, column: str | None = None) -> JoinChain:
    """The chain with join ``i`` (from 0) rewritten.

    Kinds: ``distinct``, ``grain`` (with the added ``column``), ``drop``, ``exists``,
    ``preaggregate``, ``keep_latest``.
    """
    bound = chain.bind()
    b = bound.joins[i]
    j = b.join
    keys = list(b.right)
    if kind == "drop":
        return chain.with_joins([*chain.joins[:i], *chain.joins[i + 1:]])
    if kind == "exists":
        return chain.replace_join(i, how="semi")
    if kind == "distinct":
        return chain.replace_join(i, df=distinct_rows(j.df))
    if not keys:
        raise AuditError(f"Join {j.alias!r} has no key to rewrite on.")
    if kind == "grain":
        if column is None:
            raise AuditError("The grain rewrite needs the column to add.")
        owner = grain_alias(chain, i, column)
        return chain.replace_join(i, on=[*j.on, (f"{owner}.{column}", bound.has(b.pos, column))])
    if kind == "preaggregate":
        if b.reads_left or (j.residual is not None and b.how in ("right", "full")):
            raise AuditError(f"Join {j.alias!r}: the further condition reads rows that aggregation removes.")
        df = j.df
        if j.residual is not None:
            df = df.alias(j.alias).where(F.expr(j.residual))
        return chain.replace_join(i, df=pre_aggregate(df, keys, measures_used(chain, i)), residual=None)
    if kind == "keep_latest":
        return chain.replace_join(i, df=keep_latest(j.df, keys, j.order_col))
    raise AuditError(f"Unknown rewrite {kind!r}.")


def grain_alias(chain: JoinChain, i: int, column: str) -> str | None:
    """The input joined before ``i`` that supplies ``column``: one that already supplies a
    left key if possible, else the first in join order."""
    bound = chain.bind()
    key_inputs = [bound.pos[r.alias.lower()] for c in bound.joins[i].left for r in c[:1]]
    hidden = {b.pos for b in bound.joins[:i] if b.how in ("semi", "anti")}
    for pos in [*key_inputs, *range(i + 1)]:
        if pos not in hidden and bound.has(pos, column):
            return bound.inputs[pos][0]
    return None
