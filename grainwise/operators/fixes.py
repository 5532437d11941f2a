"""Proposed rewrites of a join that multiplies rows, each with its counted result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainwise.errors import AuditError
from grainwise.operators.profile import holds, top_keys
from grainwise.operators.rewrites import (
    ROW_COUNT, grain_alias, keep_latest, measure_fn, measures_used, pick_order_col, rewrite_chain)
from grainwise.plans.forest import Counts, Forest
from grainwise.plans.spec import BoundJoin, JoinChain, quoted
from grainwise.plans.storage import Shelf

TOLERANCE = 1 + 1e-9
#: Rows of the most repeated keys that candidates for the grain are tested on first.
REFUTING_ROWS = 2_000


@dataclass
class Fix:
    kind: str
    title: str
    why: str
    sql: str
    verified_rows: int | None
    column: str | None = None

    def factor(self, rows_before: int) -> float | None:
        if self.verified_rows is None or not rows_before:
            return None
        return self.verified_rows / rows_before

    def restores(self, rows_before: int) -> bool | None:
        f = self.factor(rows_before)
        return None if f is None else f <= TOLERANCE


def count_chain(chain: JoinChain) -> int:
    """Rows after the last join, by weighted key counts."""
    bound = chain.bind()
    shelf = Shelf(chain.driving.sparkSession)
    try:
        forest = Forest(bound, shelf)
        for b in bound.joins:
            counts = forest.measure(b.index)
            if b.index + 1 < len(bound.joins):
                forest.advance(b.index, counts)
        return counts.rows_after
    finally:
        shelf.close()


def grain_columns(chain: JoinChain, i: int, n_rows: int) -> list[str]:
    """Columns that an input joined earlier also has and that make the key unique.

    Two rows that agree in key and column refute a column.  They are looked for among some rows
    of the most repeated keys first, for all columns at once; what is left is settled column by
    column over the whole table, reading the key and that column alone.  Maps and variants
    cannot be compared, so they are no candidates.
    """
    bound = chain.bind()
    b = bound.joins[i]
    df, keys = b.join.df, list(b.right)
    taken = {k.lower() for k in keys}
    shared = [c for c in bound.columns[b.pos] if c.lower() not in taken and grain_alias(chain, i, c)
              and not holds(df.schema[c].dataType, T.MapType, T.VariantType)]
    if not shared or not n_rows:
        return []
    refuted = _refuted(df, keys, shared)
    return [c for c in shared if c not in refuted and _unique(df, [*keys, c])]


def _refuted(df: DataFrame, keys: list[str], columns: list[str]) -> set[str]:
    """Those of ``columns`` of which some value occurs twice beside one key, as seen in
    ``REFUTING_ROWS`` rows of the most repeated keys."""
    worst = top_keys(df, keys).select(*[quoted(k).alias(f"__k{n}") for n, k in enumerate(keys)])
    same = reduce(lambda x, y: x & y, [quoted(k).eqNullSafe(F.col(f"__k{n}")) for n, k in enumerate(keys)])
    some = df.select(*map(quoted, keys), *map(quoted, columns)).join(F.broadcast(worst), same, "left_semi").limit(REFUTING_ROWS)
    fewer = [(F.size(F.collect_set(F.struct(quoted(c)))) < F.count(F.lit(1))).alias(f"c{n}") for n, c in enumerate(columns)]
    found = some.groupBy(*map(quoted, keys)).agg(*fewer).agg(*[F.bool_or(f"c{n}").alias(f"c{n}") for n in range(len(columns))]).first()
    return {c for n, c in enumerate(columns) if found[n]}


def _unique(df: DataFrame, columns: list[str]) -> bool:
    return df.groupBy(*map(quoted, columns)).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").isEmpty()


def build_fixes(chain: JoinChain, i: int, counts: Counts, forest: Forest, exact_dup_rows: int | None,
                warnings: list[str]) -> list[Fix]:
    """The rewrites that apply to join ``i``, in a fixed order.

    Called right after the join was measured: most results follow from the key counts
    at hand and need no further pass.
    """
    bound = chain.bind()
    b = bound.joins[i]
    j, keys = b.join, list(b.right)
    table = j.name or j.alias
    words = {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "full": "FULL JOIN"}
    word = words.get(b.how, b.how.upper() + " JOIN")
    tail = b.on_sql if b.using else f"ON {b.on_sql}"
    key_list = ", ".join(map(_name, keys))
    fixes: list[Fix] = []

    def verified(known: int | None, kind: str, column: str | None = None) -> int | None:
        if known is not None:
            return known
        try:
            return count_chain(rewrite_chain(chain, i, kind, column).prefix(i + 1))
        except (AuditError, AnalysisException) as e:
            warnings.append(f"The rewrite {kind!r} could not be counted: {first_line(e)}")
            return None

    def if_simple(count: Callable[[], int | None]) -> int | None:
        return None if b.reads_left else count()

    used, star = bound.used_columns(i)
    no_residual = j.residual is None

    if exact_dup_rows:
        rewritten = rewrite_chain(chain, i, "distinct").joins[i].df
        rows = verified(if_simple(lambda: forest.recount(b, rewritten)), "distinct")
        fixes.append(Fix(
            "distinct", "Drop complete copies",
            f"{exact_dup_rows:,} rows of `{table}` equal another row in every column.",
            f"{word} (SELECT DISTINCT * FROM {_name(table)}) {j.alias} {tail}", rows))

    if not b.using:
        for column in grain_columns(chain, i, counts.n_rows):
            owner = grain_alias(chain, i, column)
            fixes.append(Fix(
                "grain", f"Match {column} as well",
                f"({', '.join([*keys, column])}) identifies a row of `{table}`, and {owner} has {column} "
                "too: the condition leaves out a part of the key.",
                f"{word} {_aliased(table, j.alias)} ON {b.on_sql} AND {owner}.{column} = {j.alias}.{column}",
                verified(None, "grain", column), column))

    if not used and not star and b.how == "left":
        fixes.append(Fix(
            "drop", "Leave the join out",
            f"The query reads nothing of `{j.alias}`, and a left join keeps every row: it can only add copies.",
            f"-- remove: {word} {_aliased(table, j.alias)} {tail}", counts.rows_before))
    if not used and not star and b.how == "inner":
        rows = verified(if_simple(lambda: counts.matched), "exists")
        fixes.append(Fix(
            "exists", "Test for a match instead of joining",
            f"The query reads nothing of `{j.alias}`; the join only filters. A semi join keeps each row once.",
            f"LEFT SEMI JOIN {_aliased(table, j.alias)} {tail}", rows))

    measures = measures_used(chain, i)
    fns = [f"{measure_fn(j.df.schema[m].dataType)}({_name(m)}) AS {_name(m)}" for m in measures]
    where = "" if no_residual or b.reads_left else f" WHERE {j.residual}"
    pairs = " AND ".join(f"{l} = {j.alias}.{r}" for l, r in zip(b.left_names, keys))
    inner = no_residual or b.how in ("inner", "left")
    rows = verified(if_simple(lambda: counts.one_per_key if inner else None), "preaggregate")
    fixes.append(Fix(
        "preaggregate", "Aggregate to one row per key first",
        "Reduces the repeating table to the join key. Numbers are summed and other columns take their "
        "maximum; check that this is what the query means.",
        f"{word} (SELECT {', '.join([key_list, *fns, f'COUNT(*) AS {ROW_COUNT}'])} FROM "
        f"{_aliased(table, j.alias)}{where} GROUP BY {key_list}) {j.alias} "
        f"{tail if b.using else f'ON {pairs}'}", rows))

    order = j.order_col or pick_order_col(bound.columns[b.pos], keys)
    rows = verified(if_simple(lambda: counts.one_per_key if no_residual else forest.recount(b, _latest(b))), "keep_latest")
    fixes.append(Fix(
        "keep_latest", "Keep the latest row per key",
        f"Keeps the row with the greatest {order}; check that this is the row the query wants."
        if order else "The table has no further column, so any of the equal rows is kept.",
        f"{word} ({keep_latest_sql(j.df.schema, table, keys, order)}) {j.alias} {tail}", rows))
    return fixes


def _latest(b: BoundJoin) -> DataFrame:
    """The latest row per key of a right input, with the columns that the further condition
    names; with all of them if it has a star."""
    text = b.join.residual.lower()
    named = None if "*" in text else [*b.residual_right, *(c for c in b.join.df.columns if c.lower() in text)]
    return keep_latest(b.join.df, b.right, b.join.order_col, named)


def keep_latest_sql(schema: T.StructType, table: str, keys: list[str], order: str | None) -> str:
    """Spark SQL that keeps one row per key, as :func:`keep_latest` does."""
    key_list = ", ".join(map(_name, keys))
    rest = [f for f in schema.fields if f.name.lower() not in {k.lower() for k in keys}]
    if not rest:
        return f"SELECT DISTINCT {key_list} FROM {_name(table)}"
    row = ", ".join(_name(f.name) for f in rest)
    by = [order, *(f.name for f in rest if not holds(f.dataType, T.MapType, T.VariantType))]
    by = ", ".join(_name(c) for c in dict.fromkeys(by) if c)
    return (f"SELECT {key_list}, latest.* FROM (SELECT {key_list}, MAX_BY(STRUCT({row}), STRUCT({by})) "
            f"AS latest FROM {_name(table)} GROUP BY {key_list})")


def first_line(e: Exception) -> str:
    return str(e).split("\n")[0]


def _name(text: str) -> str:
    """Identifier as Spark SQL writes it; dots separate the parts of a table name."""
    return ".".join(p if p.replace("_", "a").isalnum() and not p[0].isdigit() else f"`{p}`"
                    for p in text.split(".") if p)


def _aliased(table: str, alias: str) -> str:
    return alias if table == alias else f"{_name(table)} {alias}"
