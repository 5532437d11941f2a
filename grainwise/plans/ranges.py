"""Counting matches of one comparison without joining: running sums over sorted values."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainwise.plans.spec import BoundChain, BoundJoin, Ref, quoted

_COMPARISON = re.compile(r"\s*\(?\s*([^\W\d]\w*)\.(\w+)\s*(<=|>=|<|>)\s*([^\W\d]\w*)\.(\w+)\s*\)?\s*")
MIRRORED = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}


def comparison(chain: BoundChain, b: BoundJoin) -> tuple[Ref, str, str] | None:
    """``(left column, operator, right column)`` if the further condition of ``b`` is one
    comparison between the sides, of values with a common order."""
    found = _COMPARISON.fullmatch(b.join.residual or "")
    if not found or len(b.residual_left) != 1 or len(b.residual_right) != 1:
        return None
    left, right = b.residual_left[0], b.residual_right[0]
    op = found[3] if found[1].lower() == left.alias.lower() else MIRRORED[found[3]]
    lt = chain.inputs[chain.pos[left.alias.lower()]][1].schema[left.column].dataType
    rt = b.join.df.schema[right].dataType
    return (left, op, right) if common_type(lt, rt) else None


def common_type(a: T.DataType, b: T.DataType) -> str | None:
    """A type that holds the values of both exactly and has quantiles."""
    def of(*kinds):
        return isinstance(a, kinds) and isinstance(b, kinds)

    if of(T.IntegralType):
        return "bigint"
    small = (T.ByteType, T.ShortType, T.IntegerType, T.FractionalType)
    if of(small) and not any(isinstance(t, T.DecimalType) for t in (a, b)):
        return "double"
    if a == b and isinstance(a, (T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)):
        return a.simpleString()
    return None


def cut_points(values: DataFrame, partitions: int) -> list:
    """Quantiles of the one column of ``values`` that cut it into a bucket per partition.  Any
    cut points give the right result; these give even buckets."""
    buckets = max(2, partitions)
    probs = [n / buckets for n in range(1, buckets)]
    name = values.columns[0]
    cuts = values.agg(F.percentile_approx(name, probs, max(1_000, 10 * buckets))).first()[0] or []
    return list(dict.fromkeys(cuts))


def bucket_of(value: Column, cuts: list) -> Column:
    """How many cut points lie below the value (NULL: none is known), found in two steps:
    among every so-manieth point, then among those that follow."""
    if not cuts:
        return F.when(value.isNotNull(), F.lit(0))
    stride = max(1, math.isqrt(len(cuts)))
    heads, points = (F.array(*map(F.lit, x)) for x in (cuts[::stride], cuts))
    start = F.greatest(F.size(F.filter(heads, lambda c: c < value)) - 1, F.lit(0)) * stride
    below = F.size(F.filter(F.slice(points, start + 1, F.lit(stride)), lambda c: c < value))
    return F.when(value.isNotNull(), (start + below).cast("int"))


def running(points: DataFrame, keys: Sequence[str], sums: Sequence[str], cuts: list) -> DataFrame:
    """``points`` (one row per ``keys`` and value ``v``) with, for each of ``sums``, ``<c>_upto``,
    its sum over the key's values up to this one, and ``<c>_all``, over all of them.

    Values are cut into buckets of about equal size, so the running sums of one key, or of no
    key at all, spread over many tasks."""
    own = list(map(quoted, keys))
    points = points.withColumn("bucket", bucket_of(F.col("v"), cuts))
    here = Window.partitionBy(*own, "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    points = points.withColumns({f"{c}_upto": F.sum(c).over(here) for c in sums})
    # at most one row per bucket and key
    totals = points.groupBy(*own, "bucket").agg(*[F.sum(c).alias(f"{c}_here") for c in sums])
    per_key = Window.partitionBy(*(own or [F.lit(0)]))
    before = per_key.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({
        **{f"{c}_before": F.coalesce(F.sum(f"{c}_here").over(before), F.lit(0)) for c in sums},
        **{f"{c}_all": F.sum(f"{c}_here").over(per_key) for c in sums}}).drop(*[f"{c}_here" for c in sums])
    points = points.join(totals, [*keys, "bucket"]).drop("bucket")
    return points.withColumns({f"{c}_upto": F.col(f"{c}_before") + F.col(f"{c}_upto") for c in sums}).drop(*[f"{c}_before" for c in sums])


def found_sums(points: DataFrame, keys: Sequence[str], sums: Sequence[str], op: str, cuts: list) -> DataFrame:
    """``points`` (one row per ``keys`` and value ``v``) with, for each of ``sums``, ``<c>_found``,
    its sum over the key's values that stand in relation ``op`` to this one, NULL if none has any.

    Summed from the end where these values begin: nothing is subtracted, so that floating-point
    numbers keep their digits."""
    own = list(map(quoted, keys))

    def until(partition: Sequence[Column], column: str, last: int) -> WindowSpec:
        order = F.col(column).asc() if op[0] == "<" else F.col(column).desc()
        return Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, last)

    points = points.withColumn("bucket", bucket_of(F.col("v"), cuts))
    totals = points.groupBy(*own, "bucket").agg(*[F.sum(c).alias(f"{c}_here") for c in sums])
    before = until(own or [F.lit(0)], "bucket", -1)
    totals = totals.withColumns({f"{c}_before": F.sum(f"{c}_here").over(before) for c in sums}).drop(*[f"{c}_here" for c in sums])
    here = until([*own, F.col("bucket")], "v", Window.currentRow if "=" in op else -1)
    points = points.withColumns({f"{c}_found": F.sum(c).over(here) for c in sums}).join(totals, [*keys, "bucket"])
    both = {f"{c}_found": F.coalesce(F.col(f"{c}_before") + F.col(f"{c}_found"), f"{c}_before", f"{c}_found") for c in sums}
    return points.withColumns(both).drop("bucket", *[f"{c}_before" for c in sums])


def range_matches(left: DataFrame, right: DataFrame, keys: Sequence[str], op: str, extra: Sequence[str],
                  partitions: int, found_extra: bool = False) -> DataFrame:
    """Per key and value ``v``: ``lw`` left and ``rw`` right rows, ``hits`` right rows that a
    left row here matches, ``found`` left rows that a right row here matches, and with
    ``found_extra`` the sums ``<c>_found`` of ``extra`` over these.

    ``left`` has columns ``keys, v, lw, lt`` and ``extra``, ``right`` has ``keys, v, rw``,
    one row per key and value.
    """
    cuts = cut_points(left.select("v").union(right.select("v")), partitions)
    cols = [*map(quoted, keys), F.col("v")]
    valid = reduce(lambda x, y: x & y, [c.isNotNull() for c in cols])
    sums = ["lw", "lt", "rw", *extra]
    both = left.where(valid).unionByName(right.where(valid), allowMissingColumns=True)
    both = both.groupBy(*cols).agg(*[F.sum(c).alias(c) for c in sums]).fillna(0, ["lw", "lt", "rw"])
    both = running(both, keys, ["lw", "rw"], cuts)
    met = list(extra) if found_extra else []
    if met:
        both = found_sums(both, keys, met, op, cuts)

    def matching(own: str, op: str):
        """Rows of the side weighted by ``own`` whose value stands in relation ``op`` to this row's."""
        up_to = F.col(f"{own}_upto")  # values <= v
        return {"<=": up_to, "<": up_to - F.col(own), ">": F.col(f"{own}_all") - up_to,
                ">=": F.col(f"{own}_all") - up_to + F.col(own)}[op]

    # left v `op` right value, hence the right value stands in the mirrored relation to v
    out = both.select(*cols, *sums, matching("rw", MIRRORED[op]).alias("hits"), matching("lw", op).alias("found"), *[f"{c}_found" for c in met])
    rest = left.where(~valid).withColumns({"rw": F.lit(0), "hits": F.lit(0), "found": F.lit(0), **{f"{c}_found": F.lit(None) for c in met}})
    return out.unionByName(rest.select(*out.columns))
