"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Each source gets a target of words.  A document's expected copies grow with its merit (the
bits of its word count) and stop at ``MOST_COPIES``.  The whole part is certain; the rest p
is an inclusion probability.  Documents are ranked by Pareto's order, the odds u/(1-u) of a
fixed random number over the odds p/(1-p), and taken in that order until the source's words
are nearest to its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grainwise.llm.common import attach, keep

MOST_COPIES = 3
#: Ranges of rank in which words are summed before a source's boundary is searched.
RANGES = 4096


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def random_number(*keys: Column) -> Column:
    """A number in (0, 1) that only the keys decide, from an md5 of their texts."""
    text = F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """``target`` for each row of ``sizes`` (``source``, ``source_size``; one row per source).

    Sources in order (NULL last) weigh 1, 2, 3, repeating, and share the sum of all sizes.
    In order of size over weight, a source is held at ``most`` times its size if its share
    of what is left exceeds that; the others share the rest by weight."""
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", (F.row_number().over(place) - 1) % 3 + 1)
    fill = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weight_held = F.coalesce(F.sum("weight").over(before), F.lit(0))
    share = ((F.sum("source_size").over(every) - most * held)
             / (F.sum("weight").over(every) - weight_held))
    rated = weighed.withColumn("share", share).withColumn("over", F.col("share") * F.col("weight") > most * F.col("source_size"))
    free = F.min(F.when(~F.col("over"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("share")))).over(Window.partitionBy())
    return rated.select("source", "source_size", F.when(F.col("over"), F.col("source_size") * float(most))
                        .otherwise(free["share"] * F.col("weight")).alias("target"))


def expected_copies(classes: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """``expected`` copies for each row of ``classes`` (source, merit, words, target): in
    proportion to merit, none above ``most``, and words times copies meet the target."""
    down = Window.partitionBy("source").orderBy(F.col("merit").desc())
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source")
    mass = F.col("merit") * F.col("words")
    held = F.coalesce(F.sum("words").over(above), F.lit(0))
    left = F.sum(mass).over(whole) - F.coalesce(F.sum(mass).over(above), F.lit(0))
    rated = classes.withColumn("rate", F.try_divide(F.col("target") - most * held, left))
    rated = rated.withColumn("over", F.col("rate") * F.col("merit") >= most)
    free = F.max(F.when(~F.col("over"), F.struct("merit", "rate"))).over(whole)
    return rated.withColumn("expected", F.when(F.col("over"), F.lit(float(most)))
                            .otherwise(F.coalesce(free["rate"] * F.col("merit"), F.lit(0.0)))).drop("rate", "over")


def mix_sources(df: DataFrame, source: str, size: Column, draw: Column, most: int = MOST_COPIES) -> DataFrame:
    """``df`` with a struct ``mix`` (size, source_size, target, copies, taken); it replaces a
    column of that name.

    ``size`` counts a row's words (NULL: none) and ``draw`` is its random number; rows equal
    in source, merit and draw are taken or left together.  Rows without words are never
    taken.  NULL is a source of its own, the last.  Reruns give equal results.
    """
    others = [c for c in df.columns if c.lower() != "mix"]
    rows = df.select(F.struct(*others).alias("row"), F.col(source).alias("source"),
                     F.coalesce(size.cast("bigint"), F.lit(0)).alias("size"), draw.alias("draw"))
    # NULL as a key of joins: a text of its own
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")))
    rows = rows.withColumn("merit", F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0))
    narrow = keep(rows.select("key", "source", "merit", "size", "draw"))

    classes = keep(narrow.groupBy("key", "source", "merit").agg(F.sum("size").alias("words")))
    sizes = classes.groupBy("source", "key").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, most).withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")))
    planned = keep(expected_copies(classes.drop("source").join(targets.select("key", "source_size", "target"), "key")
                                   .withColumnRenamed("key", "source"), most).withColumnRenamed("source", "key"))

    chance = F.col("expected") - F.floor("expected")
    odds = F.col("draw") / (1 - F.col("draw")) * F.try_divide(1 - chance, chance)
    wanted = planned.groupBy("key").agg((F.max("target") - F.sum(F.floor("expected") * F.col("words"))).alias("wanted"))

    # a rank in (0, 1); the boundary lies near one half, where few ranks of a source share a range
    ranked = attach(narrow, planned, ["key", "merit"]).where(chance > 0).withColumn("rank", odds / (1 + odds))
    ranked = ranked.withColumn("range", F.floor(F.col("rank") * RANGES))
    up = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (ranked.groupBy("key", "range").agg(F.sum("size").alias("words"))
              .withColumn("before", F.coalesce(F.sum("words").over(up), F.lit(0))))
    edge = keep(ranges.join(wanted, "key").where(F.col("before") < F.col("wanted"))
                .groupBy("key").agg(F.max(F.struct("range", "before", "wanted")).alias("e"))
                .select("key", "e.range", "e.before", "e.wanted"))
    step = Window.partitionBy("key").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    last = (attach(ranked, edge, ["key", "range"]).groupBy("key", "rank", "before", "wanted").agg(F.sum("size").alias("words"))
            .withColumn("reached", F.col("before") + F.coalesce(F.sum("words").over(step), F.lit(0)))
            .where(2 * F.col("reached") + F.col("words") <= 2 * F.col("wanted"))
            .groupBy("key").agg(F.max("rank").alias("top")))
    limits = edge.select("key", F.col("range").alias("cut")).join(last, "key", "left")
    decided = keep(planned.join(limits, "key", "left")
                   .select("key", "merit", "source_size", "target", "expected", "cut", "top"))

    rank = odds / (1 + odds)
    below = (F.floor(rank * RANGES) < F.col("cut")) | F.coalesce(rank <= F.col("top"), F.lit(False))
    extra = F.when((chance > 0) & below, 1).otherwise(0)
    copies = F.when(F.col("size") > 0, F.floor("expected") + extra).otherwise(0).cast("int")
    out = attach(rows.drop("source"), decided, ["key", "merit"])
    mixed = F.struct("size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))
    return out.select("row.*", mixed.alias("mix"))
