"""Sharding by jump consistent hashing.

A stable key alone decides the shard, without a table of ring positions.  When a shard is
appended, a row either stays or moves to the new shard.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grainwise.llm.common import attach, keep

#: Multiplier of the generator that draws the jumps (fixed value of the published method).
MULTIPLIER = np.uint64(2862933555777941757)
#: Rows that one task numbers.
SLOT_ROWS = 10_000


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every 64-bit key: follow the jumps until one leads past the last shard."""
    state = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(state), np.int64)
    ahead = np.zeros(len(state), np.int64)
    open_ = np.arange(len(state))
    while len(open_):
        shard[open_] = ahead[open_]
        state[open_] = state[open_] * MULTIPLIER + np.uint64(1)
        draw = ((state[open_] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        ahead[open_] = ((shard[open_] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        open_ = open_[ahead[open_] < shards]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """Shard (int, from 0) of an integer key; other types are hashed first, NULL is key 0."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64), shards).astype(np.int32))

    return jump(F.coalesce(key, F.lit(0)).cast("bigint"))


def shard_rows(df: DataFrame, key: str = "doc_id", shards: int = 16, tie: list[str] | None = None) -> DataFrame:
    """``df`` with ``shard``, ``slot`` (gapless from 0 in its shard) and ``grown_shard`` (the
    shard among one more).  Columns of these names are replaced.

    Rows are numbered in buckets: a hash of the key and the ``tie`` columns (default: all
    others) picks the bucket, bucket counts give each bucket its first slot, and only the
    rows of one bucket are sorted together.  Rows equal in all of these columns may swap
    slots.  NULL keys are key 0; text keys are hashed.  An empty table stays empty.
    """
    df = df.drop("shard", "slot", "grown_shard")
    kind = df.schema[key].dataType.simpleString()
    by = F.col(key) if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(key)
    tie = [c for c in df.columns if c != key] if tie is None else tie
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(key).alias("key"), by.alias("by"), F.xxhash64(key, *tie).alias("tie"))
    buckets = max(1, math.ceil(df.count() / shards / SLOT_ROWS))
    placed = rows.select("row", "key", "tie", shard_of(F.col("by"), shards).alias("shard"), shard_of(F.col("by"), shards + 1).alias("grown_shard"),
                         F.pmod(F.col("tie"), F.lit(buckets)).cast("int").alias("bucket"))
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = keep(counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    order = Window.partitionBy("shard", "bucket").orderBy(F.col("key").asc_nulls_last(), "tie")
    slot = (F.col("start") + F.row_number().over(order) - 1).cast("bigint").alias("slot")
    return attach(placed, starts, ["shard", "bucket"]).select("row.*", "shard", slot, "grown_shard")
