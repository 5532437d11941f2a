"""Benchmark decontamination by the q-gram lemma.

An occurrence of a passage of m characters with at most k edits shares at least
m + 1 - q(k + 1) q-grams with it, and their diagonals (place in the document less place in
the passage) span at most k + 1 values.  Shared q-grams are counted in overlapping bands of
diagonals, bands that reach the bound are kept, and a banded alignment verifies them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.llm.common import BLOCK_BYTES, attach, keep, map_rows

#: Characters (bytes of normalised text) of a q-gram: what one 64-bit number holds.
Q = 8
#: Edits allowed per character of a passage.
EDIT_SHARE = 0.1
#: Bytes of benchmark text that one index holds; a larger benchmark takes several scans.
INDEX_BYTES = 8 << 20
#: Slots of the table that sorts out q-grams which no passage has.
SLOT_BITS = 22

_CLEAN = bytes(ord(" ") if i < 128 and not chr(i).isalnum() else i for i in range(256)).lower()


def normalised(text: bytes | None) -> bytes:
    """Lower case (A-Z), ASCII punctuation as blanks, single blanks, one at either end."""
    return b" " + b" ".join((text or b"").translate(_CLEAN).split()) + b" "


def grams(text: bytes) -> np.ndarray:
    """Every q-gram as a number."""
    n = len(text) - Q + 1
    return np.ndarray((max(n, 0),), "<u8", text, 0, (1,)).copy() if n > 0 else np.zeros(0, np.uint64)


def slot(values: np.ndarray) -> np.ndarray:
    return (values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)


def edit_budget(m: int, share: float) -> int:
    """Largest k within the share for which the lemma still asks for a shared q-gram."""
    return max(0, min(int(share * m), m // Q - 1))


def grouped(labels: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct labels, and the values of each."""
    order = np.argsort(labels, kind="stable")
    found, starts = np.unique(labels[order], return_index=True)
    return found, np.split(values[order], starts[1:])


@dataclass
class Index:
    """q-grams of the passages: sorted values, and passage and place of each."""

    ids: list
    texts: list[bytes]
    share: float

    def __post_init__(self) -> None:
        lengths = np.array([len(t) for t in self.texts], np.int64)
        self.budget = np.array([edit_budget(m, self.share) for m in lengths], np.int64)
        self.least = lengths + 1 - Q * (self.budget + 1)
        own = [grams(t) for t in self.texts]
        values = np.concatenate(own) if own else np.zeros(0, np.uint64)
        order = np.argsort(values, kind="stable")
        self.values = values[order]
        self.item = np.repeat(np.arange(len(own)), [len(g) for g in own])[order]
        self.place = np.concatenate([np.arange(len(g)) for g in own])[order] if own else values
        self.known = np.zeros(1 << SLOT_BITS, bool)
        self.known[slot(self.values)] = True
        self.reach = int((lengths + 2 * self.budget).max(initial=0)) + Q

    def bands(self, text: bytes) -> Iterator[tuple[int, int, int]]:
        """(passage, first and last diagonal) of every band that reaches its bound."""
        if not self.texts:
            return
        values = grams(text)
        at = np.nonzero(self.known[slot(values)])[0]
        low = np.searchsorted(self.values, values[at], "left")
        n = np.searchsorted(self.values, values[at], "right") - low
        hits = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        item, diagonal = self.item[hits], np.repeat(at, n) - self.place[hits]
        width = self.budget[item] + 1
        band = (diagonal + self.reach) // width
        span = np.int64(len(text) + 2 * self.reach)
        at = np.repeat(at, n)
        both = np.concatenate([item * span + band, item * span + np.maximum(band - 1, 0)])
        keys, group, counts = np.unique(both, return_inverse=True, return_counts=True)
        enough = counts >= self.least[keys // span]
        hits = np.nonzero(enough[group])[0]
        # a q-gram that repeats counts once in the passage and once in the document
        for key, own in zip(*grouped(group[hits], hits % len(item))):
            i, b = divmod(int(keys[key]), int(span))
            if min(len(np.unique(at[own])), len(np.unique(at[own] - diagonal[own]))) >= self.least[i]:
                first = b * int(self.budget[i] + 1) - self.reach
                yield i, first, first + 2 * int(self.budget[i]) + 1

    def matches(self, text: bytes) -> Iterator[tuple[int, int, int, int]]:
        """(passage, start, end, edits) of verified occurrences; of those of a passage that
        overlap, the one with fewest edits, then the first.  A text is searched in stretches
        that look ahead: each reports what starts in its block, overlaps are settled over all."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        for begin in range(0, len(text), BLOCK_BYTES):
            stretch = text[begin:begin + BLOCK_BYTES + 2 * self.reach]
            for i, first, last in self.bands(stretch):
                passage, k = self.texts[i], int(self.budget[i])
                start, end = max(0, first - k), min(len(stretch), last + len(passage) + k)
                match = occurrence(passage, stretch[start:end], k)
                if match and start + match[0] < BLOCK_BYTES:
                    found.setdefault(i, []).append((match[2], begin + start + match[0], begin + start + match[1]))
        for i, own in found.items():
            taken: list[tuple[int, int]] = []
            for edits, start, end in sorted(set(own)):
                if all(end <= a or b <= start for a, b in taken):
                    taken.append((start, end))
                    yield i, start, end, edits


class Short:
    """Passages of fewer than ``Q`` characters, found as they are between blanks.  With the
    blank after it a passage fits one number, and so does the text from any of its words on."""

    def __init__(self, ids: list, texts: list[bytes]):
        self.ids: dict[int, dict[int, list]] = {}
        for i, t in zip(ids, texts):
            self.ids.setdefault(len(t) - 1, {}).setdefault(int.from_bytes(t[1:], "little"), []).append(i)
        self.values = {n: np.array(sorted(own), np.uint64) for n, own in self.ids.items()}

    def matches(self, text: bytes) -> Iterator[tuple]:
        """(passage's id, start, end) of every occurrence, with the blanks around it."""
        for begin in range(0, len(text) if self.ids else 0, BLOCK_BYTES):
            part = text[begin:begin + BLOCK_BYTES + Q] + bytes(Q)
            blanks = np.flatnonzero(np.frombuffer(part, np.uint8, min(BLOCK_BYTES, len(text) - begin)) == ord(" "))
            following = grams(part)[blanks + 1]
            for n, values in self.values.items():
                first = following & np.uint64((1 << 8 * n) - 1)
                for at in np.flatnonzero(np.isin(first, values)):
                    start = begin + int(blanks[at])
                    yield from ((i, start, start + n + 1) for i in self.ids[n][int(first[at])])


def last_row(passage: bytes, region: bytes, k: int, anchored: bool) -> np.ndarray | None:
    """Edits between the passage and the best stretch of the region ending at each place;
    ``anchored``: the stretch begins where the region does.  Only the diagonals that a
    stretch within the region can use are aligned; None as soon as all are beyond k edits."""
    n, m = len(region), len(passage)
    letters, places = np.frombuffer(region, np.uint8), np.arange(n + 1, dtype=np.int32)
    slack = k if anchored else max(n - m, 0) + k
    row = np.full(n + 2, k + 1, np.int32)  # one more place, so that a band may end before it
    row[:min(slack, n) + 1] = places[:min(slack, n) + 1] if anchored else 0
    for i, letter in enumerate(passage, 1):
        low, high = max(i - k, 0), min(i + slack, n)
        if low > high:
            return None
        part = row[low:high + 1] + 1
        if low:
            np.minimum(part, row[low - 1:high] + (letters[low - 1:high] != letter), out=part)
            row[low - 1] = k + 1
        else:
            np.minimum(part[1:], row[:high] + (letters[:high] != letter), out=part[1:])
        part -= places[low:high + 1]
        np.minimum.accumulate(part, out=part)
        part += places[low:high + 1]
        row[low:high + 1] = part
        if i % 8 == 0 and part.min() > k:
            return None
    return np.minimum(row[:n + 1], k + 1)


def occurrence(passage: bytes, region: bytes, k: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the passage's best occurrence in the region, if within k."""
    at = region.find(passage)
    if at >= 0:
        return at, at + len(passage), 0
    row = last_row(passage, region, k, False)
    if row is None or row.min() > k:
        return None
    end = int(row.argmin())
    back = last_row(passage[::-1], region[:end][::-1], k, True)
    return end - int(back.argmin()), end, int(row[end])


def find_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", share: float = EDIT_SHARE,
                  short: bool = False) -> DataFrame:
    """One row per occurrence of a benchmark passage in a document: ``doc_id``, ``item_id``,
    ``start`` and ``end`` in the document's normalised text, and ``edits``.

    Passages of fewer than ``Q`` characters are too short for the lemma: with ``short`` they
    are found without edits and as whole words, else they take no part.  NULL and empty
    passages never do; a NULL document is empty.  Repeated documents and passages are reported
    each.  The benchmark is read in blocks of ``INDEX_BYTES``, so that what tasks hold is
    bounded; each block is one scan of the documents.  Texts are searched in overlapping
    stretches.
    """
    # a clashing name or type of the ids does no harm: they are renamed here
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"))
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("binary").alias("_text")).where("_text is not null")
    size = items.agg(F.sum(F.length("_text"))).first()[0] or 0
    blocks = 1 + int(size) // INDEX_BYTES
    kinds = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}"
    out = None
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "_text"), F.lit(blocks)) == block).collect()
        cleaned = sorted(((r.item_id, normalised(bytes(r["_text"]))) for r in own), key=lambda x: x[1])
        brief = [(i, t) for i, t in cleaned if short and 0 < len(t) - 2 < Q]
        cleaned = [(i, t) for i, t in cleaned if len(t) - 2 >= Q]
        index = Index([i for i, _ in cleaned], [t for _, t in cleaned], share)
        found = map_rows(rows, searcher(index, Short([i for i, _ in brief], [t for _, t in brief])), f"{kinds}, start bigint, end bigint, edits int")
        out = found if out is None else out.union(found)
    return out


def searcher(index: Index, short: Short | None = None):
    """(id, text) to (id, passage, start, end, edits) of every occurrence."""
    def search(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc, text in rows:
            text = normalised(text)
            yield from ((doc, index.ids[i], start, end, edits) for i, start, end, edits in index.matches(text))
            if short:
                yield from ((doc, *hit, 0) for hit in short.matches(text))

    return search


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without any benchmark passage.  Rows are judged by their text alone, so
    NULL and repeated ids do no harm."""
    texts = docs.select(F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("text"))
    leaks = keep(find_passages(texts, benchmark, "_hash", "text").select(F.col("doc_id").alias("_hash")).distinct())
    marked = docs.select(F.struct(*docs.columns).alias("doc"), F.xxhash64(text_col).alias("_hash"))
    return attach(marked, leaks, ["_hash"], "left_anti").select("doc.*")
