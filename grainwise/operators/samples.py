"""Example rows: what a join makes of its most repeated key."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainwise.operators.profile import holds, key_counts
from grainwise.plans.prefix import displayed, join_physical, prefix_physical
from grainwise.plans.spec import BoundChain, BoundJoin, JoinChain, Ref, quoted

SAMPLE_ROWS = 8
#: Cells per shuffle partition over which the joined rows of one key are spread.
CELLS = 8


def worst_key(df: DataFrame, keys: list[str]) -> tuple[dict, int] | None:
    """The most repeated key without NULLs, ties in key order, and its rows; None if no key repeats."""
    counts = key_counts(df, keys).dropna(subset=keys).where(F.col("rows_per_key") > 1)
    row = counts.orderBy(F.desc("rows_per_key"), *map(quoted, keys)).first()
    return None if row is None else ({k: row[k] for k in keys}, row["rows_per_key"])


def worst_key_rows(chain: JoinChain, i: int, limit: int | None = SAMPLE_ROWS) -> DataFrame | None:
    """Joined rows up to join ``i`` whose left key is the right side's most repeated key.

    With plain key equality any left row of the key matches any right row, so both
    sides are cut to ``limit`` rows before they meet: a key holding a large share of
    the table is never joined in full for a few example rows.  Without a limit the key's rows
    are spread (:func:`spread_one_key`), as all of them meet under one key.
    """
    bound = chain.bind()
    b = bound.joins[i]
    if not b.profiled:
        return None
    found = worst_key(b.join.df, list(b.right))
    if found is None:
        return None
    key = found[0]
    left = prefix_physical(bound, i)
    for candidates, c in zip(b.left, b.right):
        names = [quoted(bound.physical(r)) for r in candidates]
        left = left.where((names[0] if len(names) == 1 else F.coalesce(*names)) == F.lit(key[c]))
    right = b.join.df.alias(b.join.alias)
    for c in b.right:
        right = right.where(quoted(c) == F.lit(key[c]))
    if b.join.residual is not None and not b.reads_left:
        right = right.where(F.expr(b.join.residual))
    right = right.select(*[quoted(c).alias(bound.physical(Ref(b.join.alias, c)))
                           for c in bound.columns[b.pos]])
    if limit is not None and not b.reads_left:
        left, right = left.limit(limit), right.limit(limit)
    if limit is None:
        return displayed(bound, spread_one_key(bound, left, right, b, found[1]), i + 1)
    return displayed(bound, join_physical(bound, left, right, b), i + 1).limit(limit)


def spread_one_key(bound: BoundChain, left: DataFrame, right: DataFrame, b: BoundJoin, n_right: int) -> DataFrame:
    """Joins rows of one key, ``n_right`` of them on the right, in ``CELLS`` cells per shuffle partition.

    A left row is dealt to a row of a grid of cells by its hash and copied along it, a right row
    to a column, so every pair meets in one cell; equal rows stay together.  A side with few
    rows has few strips, and the other is copied as few times.  Without a condition every row
    matches if the left side has any, so all outer joins are inner ones here.  Joins that may
    keep unmatched rows because of a condition, SEMI and ANTI are not spread.
    """
    if b.how in ("semi", "anti") or (b.how != "inner" and b.join.residual is not None):
        return join_physical(bound, left, right, b)
    cells = CELLS * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    root = math.isqrt(cells) + 1
    n_left = left.limit(root).count()
    if not n_left:
        return join_physical(bound, left, right, b)
    across = min(-(-cells // n_left), n_right)
    down = n_left if n_left < root else -(-cells // across)

    def dealt(df: DataFrame, n: int) -> Column:
        columns = [quoted(f.name) for f in df.schema.fields if not holds(f.dataType, T.MapType, T.VariantType)]
        return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = left.withColumn("__row", dealt(left, down)).withColumn("__left_cell", every(across))
    right = right.withColumn("__column", dealt(right, across)).withColumn("__right_cell", every(down))
    left = left.withColumn("__left_cell", F.col("__row") * across + F.col("__left_cell")).drop("__row")
    right = right.withColumn("__right_cell", F.col("__right_cell") * across + F.col("__column")).drop("__column")
    return join_physical(bound, left, right, replace(b, how="inner"), ("__left_cell", "__right_cell"))
