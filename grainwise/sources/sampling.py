"""Samples, how much of a table they cover, and what they do to an audit."""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.errors import AuditError
from grainwise.operators.fixes import count_chain
from grainwise.plans.spec import JoinChain, quoted

SAMPLE_ROWS = 50_000
#: Key hashes are numbers below two to this power.
HASH_BITS = 60


def sample_rows(df: DataFrame, n: int = SAMPLE_ROWS) -> DataFrame:
    """The first ``n`` rows.  Join partners may be cut off; see :func:`sample_by_key`."""
    return df.limit(n)


def sample_by_key(df: DataFrame, key: str, fraction: float) -> DataFrame:
    """The rows whose key's hash lies below ``fraction`` of all hashes.

    Tables sampled by the same key keep the same key values, so no join partner is
    lost; keys are hashed by their text, so integers of any width agree.  Rows with a
    NULL key have no partner: each is kept or left by a hash of its whole row.
    """
    if not 0 < fraction <= 1:
        raise AuditError(f"A sample takes a fraction above 0 and up to 1, not {fraction}.")
    own = F.xxhash64(*map(quoted, df.columns)).cast("string")
    text = F.coalesce(quoted(key).cast("string"), own)
    value = F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("bigint")
    return df.where(value < F.lit(math.ceil(fraction * (1 << HASH_BITS))).cast("bigint"))


def sample_chain(chain: JoinChain, keys: Mapping[str, str], fraction: float) -> JoinChain:
    """The chain over key-consistent samples; ``keys`` names the sampling column per
    alias, and inputs without one stay whole."""
    def cut(df: DataFrame, alias: str) -> DataFrame:
        return sample_by_key(df, keys[alias], fraction) if alias in keys else df

    out = chain
    for i, j in enumerate(chain.joins):
        out = out.replace_join(i, df=cut(j.df, j.alias))
    return JoinChain(cut(chain.driving, chain.alias), chain.alias, out.joins, chain.select, chain.aggs,
                     chain.uses, chain.name)


def sample_coverage(tables: Mapping[str, DataFrame], n: int = SAMPLE_ROWS) -> DataFrame:
    """Per table: rows that the first-``n`` sample has, and rows in full, both counted."""
    def counted(name: str, df: DataFrame, column: str) -> DataFrame:
        return df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias(column))

    frames = [counted(name, sample_rows(df, n), "sample_rows").join(counted(name, df, "full_rows"), "table_name")
              for name, df in tables.items()]
    return reduce(DataFrame.unionByName, frames)


def validate_sample(full: JoinChain, sampled: JoinChain) -> DataFrame:
    """Rows after all joins of the same chain on the full tables and on the sample."""
    spark = full.driving.sparkSession
    return spark.createDataFrame([(count_chain(full), count_chain(sampled))],
                                 "full_rows bigint, sample_rows bigint")
