"""Nearest neighbours by cosine with a vantage-point tree per shard.

Vectors of length one are compared by their chord, a metric that falls as the cosine grows.
Every shard of rows builds a tree; blocks of queries walk it together.  A side of a node is
skipped if the triangle inequality says that all its points are farther than the k-th nearest
found so far, ``relax`` times over: one gives the exact answer, more skips more.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grainwise.llm.common import keep

#: Rows of a shard, queries of a block, points of a leaf.
SHARD_ROWS, BLOCK_QUERIES, LEAF_POINTS = 4_096, 16_384, 512
#: Products of whole blocks are this close to the exact similarity, which decides among those near the k-th.
NEAR = 1e-12


def build(points: np.ndarray, own: np.ndarray, rng: np.random.Generator) -> tuple:
    """(vantage, radius, inside, outside); a leaf is an array of row numbers.  Points at the
    radius are inside; points that no radius parts stay in one leaf."""
    if len(own) <= LEAF_POINTS:
        return own
    vantage = points[rng.choice(own)]
    d = np.sqrt(np.maximum(2 - 2 * points[own] @ vantage, 0))
    radius = float(np.median(d))
    inside = d <= radius
    if inside.all():
        return own
    return vantage, radius, build(points, own[inside], rng), build(points, own[~inside], rng)


class Search:
    """The k best rows for each query of a block by ``exact``, the similarity of query and row
    numbers one by one; equal ones by smaller id."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, relax: float):
        self.ids, self.points, self.query_ids, self.queries, self.k, self.relax = ids, points, query_ids, queries, k, relax
        self.best = np.full((len(queries), k), -np.inf)
        self.row = np.full((len(queries), k), -1)
        self.compared = 0

    def exact(self, who: np.ndarray, row: np.ndarray) -> np.ndarray:
        return (self.queries[who] * self.points[row]).sum(axis=1)

    def leaf(self, rows: np.ndarray, active: np.ndarray) -> None:
        for i in range(0, len(rows), LEAF_POINTS):
            own = rows[i:i + LEAF_POINTS]
            near = self.queries[active] @ self.points[own].T
            near[self.query_ids[active][:, None] == self.ids[own][None, :]] = -np.inf
            self.compared += near.size
            better = np.nonzero((near >= self.best[active, -1:] - NEAR).any(axis=1))[0]
            if not len(better):
                continue
            who = active[better]
            values = np.concatenate([self.best[who], near[better]], axis=1)
            place = np.concatenate([self.row[who], np.broadcast_to(own, (len(who), len(own)))], axis=1)
            kth = np.partition(values, -self.k, axis=1)[:, [-self.k]]
            line, column = np.nonzero((values >= kth - NEAR) & np.isfinite(values))
            sure = np.full_like(values, -np.inf)
            sure[line, column] = self.exact(who[line], place[line, column])
            order = np.lexsort((self.ids[place], -sure), axis=1)[:, :self.k]
            self.best[who] = np.take_along_axis(sure, order, axis=1)
            self.row[who] = np.take_along_axis(place, order, axis=1)

    def walk(self, node: tuple | np.ndarray, active: np.ndarray) -> None:
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            self.leaf(node, active)
            return
        vantage, radius, inside, outside = node
        gap = np.sqrt(np.maximum(2 - 2 * self.queries[active] @ vantage, 0)) - radius
        first = gap <= 0
        self.walk(inside, active[first])
        self.walk(outside, active[~first])

        def open_(side: np.ndarray) -> np.ndarray:
            kth = self.best[active[side], -1]
            reach = np.where(np.isfinite(kth), np.sqrt(np.maximum(2 - 2 * kth, 0)), np.inf) + 1e-9
            return active[side][np.abs(gap[side]) * self.relax <= reach]

        self.walk(outside, open_(first))
        self.walk(inside, open_(~first))


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, and not zero."""
    sound = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & F.coalesce(sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one, scaled by their largest component first, and the lengths so scaled."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled, np.sqrt((scaled * scaled).sum(axis=1))


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5,
            relax: float = 1.0) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` (cosine) of the ``k`` nearest
    rows found for every query row, ties to the smaller id.

    A query's candidates are all rows of another id and its number of components.  Unusable
    vectors and rows without an id take no part.  Rows equal in id and vector count once; an
    id with several vectors is a candidate with each, and asks with the smallest.  A query without candidates has no row; fewer than ``k`` are all
    returned.  Every row is indexed; rows are dealt to shards by a hash of the whole row, so
    equal vectors do not meet in one shard.
    """
    rows = keep(vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"),
                               F.coalesce(is_query, F.lit(False)).alias("asks"))
                .where(F.col("id").isNotNull()).where(usable(F.col("v"))).groupBy("id", "v").agg(F.max("asks").alias("asks")))
    number = F.row_number().over(Window.partitionBy("id").orderBy("v"))
    queries = rows.where("asks").select("id", "v", number.alias("copy"))
    n, asked = rows.count(), rows.where("asks").count()
    shards, blocks = max(1, math.ceil(n / SHARD_ROWS)), max(1, math.ceil(asked / BLOCK_QUERIES))

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    left = rows.select("id", "v", F.size("v").alias("width"), F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int").alias("shard"),
                       every(blocks).alias("block"))
    right = queries.select(F.col("id"), F.col("v"), "copy", F.size("v").alias("width"),
                           F.pmod(F.xxhash64("v", "id"), F.lit(blocks)).cast("int").alias("block"), every(shards).alias("shard"))

    def search(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asking):
            return pd.DataFrame({"query_id": [], "copy": [], "vec_id": [], "score": []})
        own, asking = own.sort_values("id", kind="stable"), asking.sort_values(["id", "copy"])
        ids, asking_ids = own.id.to_numpy(np.int64), asking.id.to_numpy(np.int64)
        points, lengths = unit(np.stack(own.v.to_numpy()).astype(float))
        queries, query_lengths = unit(np.stack(asking.v.to_numpy()).astype(float))
        found = Search(ids, points / lengths[:, None], asking_ids, queries / query_lengths[:, None], k, relax)
        found.exact = lambda who, row: (queries[who] * points[row]).sum(axis=1) / (query_lengths[who] * lengths[row])
        tree = build(found.points, np.arange(len(ids)), np.random.default_rng(len(ids)))
        found.walk(tree, np.arange(len(queries)))
        who, place = np.nonzero((found.row >= 0) & np.isfinite(found.best))
        row = found.row[who, place]
        return pd.DataFrame({"query_id": asking_ids[who], "copy": asking["copy"].to_numpy(np.int64)[who], "vec_id": ids[row], "score": found.best[who, place]})

    by = ["width", "shard", "block"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(search, "query_id bigint, copy bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id", "copy").orderBy(F.col("score").desc(), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.where("copy = 1").select("query_id", "rank", "vec_id", "score")
