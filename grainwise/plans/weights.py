"""Joins of weighted frames.

A weighted frame has one row per tuple of the columns still needed, and in ``W``
the number of joined rows that tuple stands for.  Measures ride along as pairs
``__s<m>`` (weighted sum) and ``__c<m>`` (weighted count of non-NULL values).
Joining multiplies weights, so no joined row is ever built.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainwise.plans.spec import quoted

W = "__w"
LONG_MAX = 2**63 - 1
BIG = "decimal(38,0)"


@dataclass(frozen=True)
class Hot:
    """Keys that hold more than ``limit`` tuples, too many for one task.

    ``keys`` has columns ``h0..`` and at most one row per shuffle partition, because
    ``limit`` is no less than the mean partition size.
    """

    keys: DataFrame
    ways: int
    limit: int

    def mark(self, df: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
        """Joins the list, whose size is bounded, to ``df``; cold rows get NULLs."""
        return df.join(F.broadcast(self.keys), equal(list(zip(keys, self.keys.columns))), how)

    def salt(self, df: DataFrame) -> Column:
        """A salt that depends on nothing but the row's values, so a retry repeats it."""
        return F.pmod(F.xxhash64(*map(quoted, df.columns)), F.lit(self.ways)).cast("int")

    def spreads(self, df: DataFrame, keys: Sequence[str]) -> bool:
        """Whether the salts cut every hot key into small groups; copies of one tuple
        share a salt.  Counts hot rows per key and salt, after combining in each task."""
        hot = self.mark(df.withColumn("__m", self.salt(df)), keys, "inner")
        sizes = hot.groupBy(*self.keys.columns, "__m").agg(F.count(F.lit(1)).alias("n"))
        return (sizes.agg(F.max("n")).first()[0] or 0) <= 2 * self.limit


def weight_type(bound: int) -> str:
    """bigint while the weights provably fit, decimal(38,0) beyond."""
    return "bigint" if bound <= LONG_MAX else BIG


def measure_names(n: int) -> list[str]:
    return [f"__{kind}{m}" for m in range(n) for kind in ("s", "c")]


def regroup(df: DataFrame, keep: Sequence[str], measures: int, type_: str) -> DataFrame:
    """One row per ``keep`` tuple."""
    aggs = [F.sum(W).cast(type_).alias(W)]
    aggs += [F.sum(m).alias(m) for m in measure_names(measures)]
    if keep:
        return df.groupBy(*map(quoted, keep)).agg(*aggs)
    total = df.agg(*aggs)  # a global aggregate has one row even over no input
    return total.where(F.col(W).isNotNull())


def compared_type(spark: SparkSession, a: T.DataType, b: T.DataType) -> str | None:
    """The type in which Spark compares values of two types; None if they are the same."""
    if a == b:
        return None
    both = spark.createDataFrame([], T.StructType([T.StructField("a", a), T.StructField("b", b)]))
    return both.where(F.col("a") == F.col("b"))._jdf.queryExecution().analyzed().condition().left().dataType().sql()


def equal(pairs: Sequence[tuple[str, str]]) -> Column | None:
    terms = [quoted(a) == quoted(b) for a, b in pairs]
    return reduce(lambda x, y: x & y, terms) if terms else None


def salted(many: DataFrame, few: DataFrame, many_keys: Sequence[str], few_keys: Sequence[str],
           hot: Hot) -> tuple[DataFrame, DataFrame]:
    """Spread the tuples of hot keys over ``hot.ways`` salts ``__m``, and copy the rows of
    ``few`` (one per key) for those keys to every salt ``__f``."""
    is_hot = F.col(hot.keys.columns[0]).isNotNull()
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(hot.ways - 1))).otherwise(F.array(F.lit(0)))
    salt = F.when(is_hot, F.col("__m")).otherwise(F.lit(0))
    many = hot.mark(many.withColumn("__m", hot.salt(many)), many_keys, "left").withColumn("__m", salt)
    few = hot.mark(few, few_keys, "left").withColumn("__f", F.explode(copies))
    return many.drop(*hot.keys.columns), few.drop(*hot.keys.columns)


def combine(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], how: str,
            keep: Sequence[str], measures: int, type_: str, *, condition: Column | None = None,
            hot_left: Hot | None = None, hot_right: Hot | None = None, join: Callable | None = None) -> DataFrame:
    """Join two weighted frames and regroup by ``keep``; ``join`` takes the place of Spark's.

    ``hot_left`` says that hot keys repeat on the left while the right has one row per
    key; ``hot_right`` is the mirror case.
    """
    l_keys, r_keys = [a for a, _ in pairs], [b for _, b in pairs]
    if hot_right is not None and how == "left":
        # salting copies the left rows, so the unmatched ones are taken separately
        matched = combine(left, right, pairs, "inner", keep, measures, type_, hot_right=hot_right)
        rest = left.join(right.select(*map(quoted, r_keys)).distinct(), equal(pairs), "left_anti")
        for c in keep:
            if c not in rest.columns:
                rest = rest.withColumn(c, F.lit(None).cast(right.schema[c].dataType))
        rest = rest.select(*map(quoted, keep), *map(F.col, [W, *measure_names(measures)]))
        return regroup(matched.unionByName(rest), keep, measures, type_)

    on = equal(pairs)
    if condition is not None:
        on = condition if on is None else on & condition
    right = right.withColumnRenamed(W, "__rw")
    if hot_left is not None:
        tuples = [c for c in left.columns if c not in (W, *measure_names(measures))]
        if not hot_left.spreads(left, l_keys):
            left = regroup(left, tuples, measures, type_)
        left, right = salted(left, right, l_keys, r_keys, hot_left)
        on = on & (F.col("__m") == F.col("__f"))
    elif hot_right is not None:
        tuples = [c for c in right.columns if c != "__rw"]
        if not hot_right.spreads(right, r_keys):
            right = right.groupBy(*map(quoted, tuples)).agg(F.sum("__rw").alias("__rw"))
        right, left = salted(right, left, r_keys, l_keys, hot_right)
        on = on & (F.col("__m") == F.col("__f"))

    if on is None:  # no key: one side is a single row
        on = F.lit(True)
    kinds = {m: (left if m in left.columns else right).schema[m].dataType.simpleString() for m in measure_names(measures)}
    joined = (join or DataFrame.join)(left, right, on, _SPARK_HOW[how])
    if how in ("semi", "anti"):
        return regroup(joined, keep, measures, type_)
    one = F.lit(1)
    lw, rw = F.col(W).cast(type_), F.col("__rw").cast(type_)
    if how in ("right", "full"):
        lw = F.coalesce(lw, one)
    by = F.coalesce(rw, one) if how in ("left", "full") else rw
    joined = joined.withColumns({
        W: (lw * by).cast(type_),
        **{m: _times(F.col(m), kinds[m], by) for m in measure_names(measures)},
    })
    return regroup(joined, keep, measures, type_)


def _times(value: Column, kind: str, by: Column) -> Column:
    """A measure times a weight, in the measure's own type."""
    return (value * by.cast(kind)).cast(kind)


_SPARK_HOW = {"inner": "inner", "left": "left", "right": "right", "full": "full",
              "semi": "left_semi", "anti": "left_anti"}
