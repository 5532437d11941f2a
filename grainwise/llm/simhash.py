"""SimHash near-dedup with vantage-point trees.

A text becomes a 64-bit fingerprint; texts within a few bits are linked and linked texts
form a group.  Links are searched among distinct fingerprints.  A vantage-point tree built
on a sample cuts them into shards: a point within the radius goes inside, one beyond it
outside, and one beyond it by at most the link distance goes to both sides.  By the triangle
inequality any two points that may link meet in a shard.  Each shard cuts further by the
same rule and returns a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.llm.common import BLOCK_BYTES, keep, word_blocks

SEED = 42
#: Fingerprints that a shard should hold, and of the sample per shard (it bounds what is collected).
SHARD_POINTS, SAMPLE_PER_SHARD, MOST_SAMPLED = 16_384, 128, 1_000_000
#: Points that are compared pair by pair in one block.
LEAF_POINTS = 2_048


# -- fingerprints --------------------------------------------------------------------
def shingle_hashes(text: bytes, words: int, block: int = BLOCK_BYTES) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of the text, block by block."""
    tail: list[bytes] = []
    seen = 0
    for part in word_blocks(text, block):
        part = tail + part
        if len(part) >= words:
            joined = b" ".join(part)
            lengths = np.fromiter(map(len, part), np.int64, len(part))
            ends = np.cumsum(lengths + 1) - 1
            starts = (ends - lengths).tolist()
            digest = xxhash.xxh64_intdigest
            hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1:].tolist())]
            seen += len(hashes)
            yield np.array(hashes, np.uint64)
        tail = part[len(part) - words + 1:] if len(part) >= words else part
    if not seen and tail:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(tail), SEED)], np.uint64)


def fingerprint(text: bytes | None, words: int) -> int:
    """A bit is set if over half the shingle hashes have it; 0 for a text without words.
    Signed, as Spark holds it."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text or b"", words):
        for i in range(0, len(hashes), 4096):
            part = hashes[i:i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def simhash(text: Column, words: int = 3) -> Column:
    """Fingerprint of a text column; NULL counts as empty."""
    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(x, words) for x in texts], dtype="int64")

    return of(F.coalesce(text, F.lit("")).cast("binary"))


# -- vantage-point trees -----------------------------------------------------------------
def distances(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def best_cut(points: np.ndarray, bits: int) -> tuple[np.uint64, int, int]:
    """Vantage point and radius whose larger side is smallest, and the size of that side."""
    best = (points[0], 0, len(points))
    for vantage in points[::max(1, len(points) // 8)][:8]:
        found = np.bincount(distances(points, vantage), minlength=65 + bits).cumsum()
        inside, outside = found[bits:65 + bits], len(points) - found[:65]
        larger = np.maximum(inside, outside)
        radius = int(larger.argmin())
        if larger[radius] < best[2]:
            best = (vantage, radius, int(larger[radius]))
    return best


def grow(sample: np.ndarray, total: float, bits: int) -> tuple:
    """Nested (vantage, radius, inside, outside); () is a shard.  ``total``: points that the
    sample stands for."""
    if total <= SHARD_POINTS or len(sample) < 16:
        return ()
    vantage, radius, larger = best_cut(sample, bits)
    if larger > 0.9 * len(sample):
        return ()
    d, share = distances(sample, vantage), total / len(sample)
    inside, outside = sample[d <= radius + bits], sample[d > radius]
    return (vantage, radius, grow(inside, share * len(inside), bits), grow(outside, share * len(outside), bits))


def route(points: np.ndarray, tree: tuple, bits: int) -> Iterator[tuple[str, np.ndarray]]:
    """(shard, its points): the side a point lies on, and the inside too if it is near."""
    todo = [("", tree, points)]
    while todo:
        path, node, own = todo.pop()
        if not node:
            yield path, own
            continue
        d = distances(own, node[0])
        todo += [(path + "i", node[2], own[d <= node[1] + bits]), (path + "o", node[3], own[d > node[1]])]


class Labels:
    """Groups of points, merged as links are found."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, members: np.ndarray) -> None:
        own = np.unique(self.of[members])
        if len(own) > 1:
            self.of[np.isin(self.of, own)] = own[0]


def link(points: np.ndarray, bits: int) -> np.ndarray:
    """For each of the distinct points, the index of a point that stands for its group."""
    labels, todo = Labels(len(points)), [np.arange(len(points))]
    while todo:
        own = todo.pop()
        if len(own) > LEAF_POINTS:
            vantage, radius, larger = best_cut(points[own[::max(1, len(own) // 512)]], bits)
            d = distances(points[own], vantage)
            sides = [own[d <= radius + bits], own[d > radius]]
            if max(map(len, sides)) <= 0.9 * len(own):
                todo += sides
                continue
        for i in range(0, len(own), 512):  # beside a dense ball that no radius cuts: in blocks
            left = own[i:i + 512]
            near = np.bitwise_count(points[left][:, None] ^ points[own[i:]][None, :]) <= bits
            for row in np.nonzero(near.sum(axis=1) > 1)[0]:
                labels.join(own[i:][near[row]])
    return labels.of


def fingerprint_links(prints: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``fp`` within ``bits``: per shard
    a star around the smallest fingerprint of each group found there."""
    total = prints.count()
    wanted = min(MOST_SAMPLED, SAMPLE_PER_SHARD * (1 + total // SHARD_POINTS)) if total > SHARD_POINTS else 0
    sample = [r.fp for r in prints.sample(min(1.0, wanted / total), seed=SEED).limit(2 * wanted).collect()] if wanted else []
    tree = grow(np.array(sorted(sample), np.int64).view(np.uint64), total, bits)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, own in route(batch.fp.to_numpy(np.int64).view(np.uint64), tree, bits):
                if len(own):
                    yield pd.DataFrame({"shard": shard, "fp": own.view(np.int64)})

    def stars(own: pd.DataFrame) -> pd.DataFrame:
        prints = np.sort(own.fp.to_numpy(np.int64))
        group = pd.Series(link(prints.view(np.uint64), bits))
        root = pd.Series(prints).groupby(group).transform("min").to_numpy()
        far = root != prints
        return pd.DataFrame({"a": prints[far], "b": root[far]})

    routed = prints.select("fp").mapInPandas(assign, "shard string, fp bigint")
    return routed.groupBy("shard").applyInPandas(stars, "a bigint, b bigint").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node, root being the smallest of its component.

    Alternating stars: each node hands its larger neighbours, then its smaller ones, to the
    smallest neighbour, until nothing changes.  Every round is written to shared storage."""
    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")),
                            F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first())

    def star(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))

    edges = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    now = state(edges)
    while now[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(star(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        least = star(large)
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = keep(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        before, now = now, state(edges)
        if before == now:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


# -- documents ------------------------------------------------------------------------
def groups_of(rows: DataFrame, id_col: str, bits: int) -> DataFrame:
    """Kept ``rows`` (with fingerprint ``fp``) and their ``root`` fingerprint and
    ``component_id``, the smallest id of the group."""
    prints = keep(rows.groupBy("fp").agg(F.min(id_col).alias("first")))
    roots = components(fingerprint_links(prints, bits)).select(F.col("node").alias("fp"), "root")
    rooted = keep(prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    groups = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(rooted.select("fp", "root").join(groups, "root"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                    bits: int = 3) -> DataFrame:
    """One row per document: its id, ``fingerprint`` (16 hex digits) and ``component_id``
    (smallest id that links lead to).

    A NULL text is an empty one: fingerprint zero, linked like any other.  NULL ids have a
    group and never name one unless it has no other id.  Repeated rows stay."""
    rows = keep(docs.select(F.col(id_col), simhash(docs[text_col], words).alias("fp")))
    return groups_of(rows, id_col, bits).select(
        id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                    bits: int = 3) -> DataFrame:
    """One whole row of each near-duplicate group: the one with the smallest id (NULL last),
    then the smallest hash of its columns; of equal rows one."""
    hashed = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).alias("id"), F.xxhash64(*docs.columns).alias("row"))
    rows = keep(hashed.select("id", "row", simhash(F.col(f"doc.`{text_col}`"), words).alias("fp")))
    own = groups_of(rows, "id", bits).groupBy("root", "id", "row").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("id").isNull(), "id", "row", "n")
    first = keep(own.groupBy("root").agg(F.min(order).alias("f")).select("f.id", "f.row", "f.n"))

    def picked(chosen: DataFrame) -> DataFrame:
        same = hashed["id"].eqNullSafe(chosen["id"]) & (hashed["row"] == chosen["row"])
        return hashed.join(chosen, same, "left_semi").select("doc.*")

    kept, repeated = picked(first.where("n = 1")), first.where("n > 1")
    return kept if repeated.isEmpty() else kept.union(picked(repeated).dropDuplicates())
