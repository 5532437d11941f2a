"""Line dedup by a deletion-neighbourhood join.

Two lines are near copies if one word inserted, deleted or replaced turns one into the other.
A line's deletion neighbourhood is itself and itself without one word, each with the place of
the gap: two lines within the bound share a variant, and lines that share one are within it.
Of the lines that share a variant the earliest stays, so a variant's lines are reduced to
their minimum and never paired with each other.

Halving keeps the neighbourhood small: lines within one edit agree before or after their
middle, so only lines whose half occurs in another line emit variants.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.llm.common import attach, keep, map_rows

#: Words from which one edit leaves a similarity of 0.8; shorter lines must be equal.
LEAST_WORDS = 5


def signed(value: int) -> int:
    """A 64-bit number as Spark holds it."""
    return value - (value >> 63 << 64)


def digest(words: list[bytes]) -> int:
    """Signed 64-bit hash of a row of words."""
    return signed(xxhash.xxh3_64_intdigest(b" ".join(words)))


def halves(words: list[bytes]) -> list[int]:
    """Hashes of which two lines within one edit share one: for either length n that the
    longer may have, the first (n - 1) // 2 words and the last n // 2."""
    n, found = len(words), []
    if n >= LEAST_WORDS - 1:
        for longer in (n, n + 1):
            if longer >= LEAST_WORDS:
                front = (longer - 1) // 2
                back = longer - 1 - front
                found += [digest([b"%d front" % longer, *words[:front]]), digest([b"%d back" % longer, *words[n - back:]])]
    return found


def variants(words: list[bytes]) -> Iterator[tuple[int, int]]:
    """(hash of the words before a gap, of those after it) for the line with a gap between
    any two words and for the line without one of its words."""
    n = len(words)

    def running(parts: list[bytes]) -> list[int]:
        state, out = xxhash.xxh3_64(), []
        for part in [b"", *parts]:
            state.update(part + b" ")
            out.append(signed(state.intdigest()))
        return out

    front, back = running(words), running(words[::-1])[::-1]
    if n >= LEAST_WORDS - 1:
        yield from zip(front, back)
    if n >= LEAST_WORDS:
        yield from zip(front[:-1], back[1:])


def within_one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """At most one word inserted, deleted or replaced."""
    if abs(len(a) - len(b)) > 1:
        return False
    same = 0
    while same < min(len(a), len(b)) and a[same] == b[same]:
        same += 1
    if len(a) == len(b):
        return a[same + 1:] == b[same + 1:]
    a, b = sorted((a, b), key=len)
    return a[same:] == b[same + 1:]


def line_rows(docs: Iterator[tuple]) -> Iterator[tuple]:
    """(id, row, key, text) to one row per line with words: id, row, key, the line's number,
    two hashes and its halves."""
    for *doc, text in docs:
        for n, line in enumerate(text.split(b"\n")):
            if words := line.lower().split():
                joined = b" ".join(words)
                yield (*doc, n, signed(xxhash.xxh3_64_intdigest(joined)), signed(xxhash.xxh64_intdigest(joined, 1)), halves(words))


def concerned_lines(docs: Iterator[tuple]) -> Iterator[tuple]:
    """The lines of a document that ``places`` names (number, hashes), with their text."""
    for *doc, text, places in docs:
        lines = text.split(b"\n")
        for p in places:
            yield (*doc, p["n"], p["h"], p["g"], lines[p["n"]])


def variant_rows(lines: Iterator[tuple]) -> Iterator[tuple]:
    """(h, line) to one row per variant: a hash of its two halves, and the line's."""
    for h, text in lines:
        for front, back in variants(text.lower().split()):
            yield signed((front * 0x9E3779B97F4A7C15 + back) & 0xFFFFFFFFFFFFFFFF), h


def place(*more: str) -> Column:
    """What orders lines: id (NULL last), document, line number; further columns follow."""
    return F.struct(F.col("id").isNull().alias("last"), "id", "row", "key", "n", *more)


def near_copies(first: DataFrame, docs: DataFrame, kind: str) -> DataFrame:
    """Hashes (h, g) of the distinct lines of which an earlier one is within one edit.

    ``first``: kept first places of the distinct lines; ``docs``: id, row, key and text."""
    halved = first.select("h", F.explode("halves").alias("half"))
    flagged = shared_by(halved, "half").select("h").distinct()
    places = first.join(flagged, "h").groupBy("row", "key").agg(F.collect_list(F.struct("n", "h", "g")).alias("places"))
    own = attach(docs, keep(places), ["row", "key"], salts=1).select("id", "row", "key", "text", "places").dropDuplicates(["row", "key"])
    texts = keep(map_rows(own, concerned_lines, f"id {kind}, row bigint, key bigint, n int, h bigint, g bigint, line binary"))
    found = keep(shared_by(map_rows(texts.select("h", "line"), variant_rows, "v bigint, h bigint"), "v"))
    # a variant's earliest line against each of the others; equal hashes are no proof
    placed = found.join(texts.select("h", "g", place().alias("at")), "h")
    earliest = placed.groupBy("v").agg(F.min(F.struct("at", "h", "g")).alias("e")).select("v", F.col("e.h").alias("eh"), F.col("e.g").alias("eg"))
    pairs = placed.join(earliest, "v").where("h != eh or g != eg").select("h", "g", "eh", "eg").distinct()

    @F.pandas_udf("boolean")
    def verified(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([within_one_edit(x.lower().split(), y.lower().split()) for x, y in zip(a, b)], dtype="bool")

    lines = texts.select("h", "g", "line")
    others = lines.select(F.col("h").alias("eh"), F.col("g").alias("eg"), F.col("line").alias("other"))
    return pairs.join(lines, ["h", "g"]).join(others, ["eh", "eg"]).where(verified("line", "other")).select("h", "g").distinct()


def shared_by(rows: DataFrame, key: str) -> DataFrame:
    """The (key, h) rows whose key several lines have."""
    spread = rows.groupBy(key).agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a != b").select(key)
    return rows.join(spread, key, "left_semi")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: bool = True) -> DataFrame:
    """``docs`` with their text cut to the lines that stay, ``lines`` (lines with words) and
    ``kept_lines``; columns of these names are replaced.

    A line goes if an earlier line has the same words or, with ``near`` and five words or
    more, is within one edit; case (A-Z) and blanks do not count.  Earlier: smaller id
    (NULL last), then smaller hash of the document, then the line's number.  An earlier line
    counts even if it goes itself.  Blank lines stay.  NULL texts stay NULL.  Rows equal in
    every column are one document given several times, and all get its result.
    """
    columns = [c for c in docs.columns if c.lower() not in ("lines", "kept_lines")]
    docs = docs.select(*columns)
    rows = docs.select(F.struct(*columns).alias("doc"), F.col(id_col).alias("id"), F.xxhash64(*columns).alias("row"),
                       F.xxhash64(F.lit(1), *columns).alias("key"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    narrow = rows.select("id", "row", "key", "text")
    kind = docs.schema[id_col].dataType.simpleString()
    lines = map_rows(narrow, line_rows, f"id {kind}, row bigint, key bigint, n int, h bigint, g bigint, halves array<bigint>")
    first = keep(lines.groupBy("h", "g").agg(F.min(place("halves")).alias("f"))
                 .select("h", "g", "f.id", "f.row", "f.key", "f.n", "f.halves"))
    kept = first.join(near_copies(first, narrow, kind), ["h", "g"], "left_anti") if near else first
    numbers = keep(kept.groupBy("row", "key").agg(F.collect_list("n").alias("numbers")))

    @F.pandas_udf("text string, lines int, kept_lines int")
    def rebuilt(texts: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        out = []
        for text, own in zip(texts, numbers):
            parts, stay = text.split(b"\n"), set() if own is None else set(own)
            worded = [bool(p.split()) for p in parts]
            left = [p for n, p in enumerate(parts) if n in stay or not worded[n]]
            out.append((b"\n".join(left).decode("utf-8", "replace"), sum(worded), len(stay)))
        return pd.DataFrame(out, columns=["text", "lines", "kept_lines"])

    joined = rows.join(numbers, ["row", "key"], "left").withColumn("new", rebuilt("text", "numbers"))
    text = F.when(F.col(f"doc.`{text_col}`").isNotNull(), F.col("new.text")).alias(text_col)
    return joined.select(*[text if c == text_col else F.col(f"doc.`{c}`") for c in columns], "new.lines", "new.kept_lines")
