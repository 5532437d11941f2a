"""Exact histogram of encoded lengths, and the totals it answers.

Documents are counted by their number of tokens.  Sums from the long end say, for every
context limit, how many documents and tokens lie at or above it, hence what a corpus cut at
that limit holds.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grainwise.llm.common import keep

#: Public vocabulary of byte-pair ranks, and the pattern that cuts texts for it (fixed value).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Lengths of one range of the sums.
RANGE = 1024


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Ranks of a vocabulary file, read where the job is built and sent with its tasks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


def with_length(docs: DataFrame, ranks: dict[bytes, int], text_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    """``docs`` with ``n_tokens`` (bigint), the tokens of the whole text; NULL has none.  A
    column of that name is replaced.  What looks like a special token is ordinary text."""
    @F.pandas_udf("bigint")
    def length(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        encoding = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for texts in parts:
            yield pd.Series([len(encoding.encode_ordinary(t)) for t in texts], dtype="int64")

    return docs.drop("n_tokens").withColumn("n_tokens", length(F.coalesce(F.col(text_col), F.lit(""))))


def histogram(counted: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """One row per length that occurs: ``length``, ``docs``, ``tokens``, and for a context of
    that length ``docs_from`` and ``tokens_from`` (documents at least as long, their tokens),
    ``docs_upto`` (documents that fit) and ``truncated_tokens`` (tokens left when every
    document is cut at it).  NULL lengths are left out; an empty table has no rows.

    Lengths are summed within ranges, and only the ranges' totals in one task."""
    by = keep(counted.where(F.col(length_col).isNotNull()).groupBy(F.col(length_col).cast("bigint").alias("length"))
              .agg(F.count(F.lit(1)).alias("docs")).withColumn("tokens", F.col("length") * F.col("docs"))
              .withColumn("_range", F.floor(F.col("length") / RANGE)))
    later = Window.orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    totals = by.groupBy("_range").agg(F.sum("docs").alias("_d"), F.sum("tokens").alias("_t"))
    totals = totals.select("_range", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_after") for c in ("_d", "_t")],
                           F.sum("_d").over(every).alias("_docs"), F.sum("_t").over(every).alias("_tokens"))
    own = Window.partitionBy("_range").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = (by.join(totals, "_range").withColumn("docs_from", F.sum("docs").over(own) + F.col("_d_after"))
           .withColumn("tokens_from", F.sum("tokens").over(own) + F.col("_t_after")))
    return out.select("length", "docs", "tokens", "docs_from", "tokens_from",
                      (F.col("_docs") - F.col("docs_from") + F.col("docs")).alias("docs_upto"),
                      (F.col("_tokens") - F.col("tokens_from") + F.col("length") * F.col("docs_from")).alias("truncated_tokens"))


def quantile(hist: DataFrame, share: float) -> int | None:
    """Smallest length that at least ``share`` of the documents do not exceed."""
    total = hist.agg(F.sum("docs")).first()[0]
    if not total:
        return None
    return hist.where(F.col("docs_upto") >= F.lit(share) * total).agg(F.min("length")).first()[0]


def truncated_total(hist: DataFrame, limit: int) -> int:
    """Tokens left when every document is cut at ``limit``, which need not occur as a length."""
    return hist.agg(F.sum(F.least("length", F.lit(limit)) * F.col("docs"))).first()[0] or 0
