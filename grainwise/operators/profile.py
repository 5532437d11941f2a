"""Key profiles of one table: counts per key, exact copies, most repeated keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainwise.plans.spec import quoted

TOP_KEYS = 10


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key tuple with its row count; NULLs form a group."""
    return df.groupBy(*map(quoted, keys)).agg(F.count(F.lit(1)).alias("rows_per_key"))


def key_stats(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, distinct keys, worst repetition, repeated keys, rows with a NULL key.

    One shuffle, on partial counts; ``max_dup`` counts the NULL group like any other,
    ``max_dup_non_null`` leaves it out because NULL never matches.
    """
    c = F.col("rows_per_key")
    has_null = reduce(lambda x, y: x | y, [quoted(k).isNull() for k in keys])
    zero = F.lit(0).cast("bigint")
    return key_counts(df, keys).agg(
        F.coalesce(F.sum(c), zero).alias("n_rows"),
        F.count(c).alias("n_keys"),
        F.coalesce(F.max(c), zero).alias("max_dup"),
        F.coalesce(F.max(F.when(~has_null, c)), zero).alias("max_dup_non_null"),
        F.count_if(c > 1).alias("dup_keys"),
        F.coalesce(F.sum(F.when(has_null, c)), zero).alias("null_rows"),
    )


def top_keys(df: DataFrame, keys: Sequence[str], n: int = TOP_KEYS) -> DataFrame:
    """The most repeated keys, ties in key order."""
    return (key_counts(df, keys).where(F.col("rows_per_key") > 1)
            .orderBy(F.desc("rows_per_key"), *[quoted(k).asc_nulls_last() for k in keys]).limit(n))


def holds(dtype: T.DataType, *kinds: type) -> bool:
    """Whether a type is, or contains, one of ``kinds``."""
    if isinstance(dtype, kinds):
        return True
    if isinstance(dtype, T.ArrayType):
        return holds(dtype.elementType, *kinds)
    if isinstance(dtype, T.MapType):
        return holds(dtype.keyType, *kinds) or holds(dtype.valueType, *kinds)
    if isinstance(dtype, T.StructType):
        return any(holds(f.dataType, *kinds) for f in dtype.fields)
    return False


def groupable(df: DataFrame) -> DataFrame:
    """The same rows in a form GROUP BY accepts: a variant column as its JSON text."""
    variants = {f.name: F.to_json(quoted(f.name)) for f in df.schema.fields
                if isinstance(f.dataType, T.VariantType)}
    return df.withColumns(variants) if variants else df


def distinct_rows(df: DataFrame) -> DataFrame:
    """``SELECT DISTINCT *`` that also takes map columns."""
    if not any(holds(f.dataType, T.MapType) for f in df.schema.fields):
        return df.distinct()
    return df.groupBy(*map(quoted, df.columns)).agg(F.count(F.lit(1)).alias("__n")).drop("__n")


def hashable(df: DataFrame) -> bool:
    """Whether equal values are the same values: no collated strings, and none that cannot be compared."""
    plain = all(t.simpleString() == "string" for f in df.schema.fields
                for t in [f.dataType] if isinstance(t, T.StringType))
    return plain and not any(holds(f.dataType, T.MapType, T.VariantType) for f in df.schema.fields)


def exact_duplicates(df: DataFrame) -> DataFrame:
    """One row ``exact_dup_rows``: rows that are copies of another row.

    Equal rows have equal hashes, so a first pass shuffles two hashes per row and settles
    a table without copies; whole rows are grouped only where both hashes repeat.
    """
    df = groupable(df)
    spark = df.sparkSession
    if df.columns and hashable(df):
        columns = [quoted(c) for c in df.columns]
        hashes = F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))
        groups = df.groupBy(hashes.alias("h")).agg(F.count(F.lit(1)).alias("c"))
        repeated = groups.where("c > 1").select(F.col("h.a").alias("__a"), F.col("h.b").alias("__b"))
        if repeated.isEmpty():
            return spark.range(1).select(F.lit(0).cast("bigint").alias("exact_dup_rows"))
        df = (df.withColumns({"__a": F.xxhash64(*columns), "__b": F.xxhash64(F.lit(1), *columns)})
              .join(repeated, ["__a", "__b"], "left_semi").drop("__a", "__b"))
    groups = df.groupBy(*map(quoted, df.columns)).agg(F.count(F.lit(1)).alias("__n"))
    return groups.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0).cast("bigint")).alias("exact_dup_rows"))
