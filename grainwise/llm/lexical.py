"""Ranked lexical search over an index stratified by document length.

The score of a term depends on its count ``tf`` and on the document's normaliser ``m``, which
follows its length.  Documents of equal ``m`` are a stratum; a term's postings lie by stratum
and, within it, by ``tf``, so an impact is worked out once per run of equal (m, tf).  The
largest impacts of an item's terms bound a stratum's scores: strata are visited from the
highest bound down, until no bound reaches the k-th score.

The index is dealt out by document: a segment holds whole documents of one task, is searched
alone, and only its k best per item leave it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from grainwise.llm.common import BLOCK_BYTES, keep

#: A term: the longest run of ASCII letters and digits and of anything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"
#: The same on bytes: every other byte is a blank, A-Z in lower case.
_BREAK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
#: Postings after which a segment is closed, and rows of an index batch.
SEGMENT, ROWS = 1_000_000, 50_000
#: Bytes of the items that are searched in one scan of the index.
ITEM_BYTES = 4 << 20
#: Strata of the first visit; each next visit takes twice as many.
FIRST_VISIT = 4

POSTINGS = "segment bigint, term string, docs int, m array<bigint>, tf array<bigint>, doc array<int>, ids array<bigint>"
FOUND = "item int, doc_id bigint, score bigint"


@dataclass
class Index:
    """``postings``: a row per segment and term with its ``docs`` and, sorted by ``m`` and
    ``tf``, the places of documents in the segment; one row without a term lists the ids of
    the segment's documents.  ``n_docs`` (N) and ``n_terms`` (L) are those of all documents."""

    postings: DataFrame
    n_docs: int
    n_terms: int


def terms(text: bytes) -> Counter:
    """Counts of a text's terms, cut between terms into blocks of about ``BLOCK_BYTES``."""
    counts: Counter = Counter()
    start = 0
    while start < len(text):
        cut = _BREAK.search(text, start + BLOCK_BYTES) if len(text) - start > BLOCK_BYTES else None
        end = cut.start() if cut else len(text)
        counts.update(text[start:end].translate(FOLD).split())
        start = end
    return counts


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What one unit of weight is worth, in whole numbers."""
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


# -- the index ---------------------------------------------------------------------------
class Segment:
    """Documents of one task on their way into the index."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.m: list[int] = []
        self.distinct: list[int] = []
        self.terms: list[bytes] = []
        self.tf: list[int] = []

    def add(self, doc_id: int | None, counts: Counter, m: int) -> None:
        self.ids.append(doc_id)
        self.m.append(m)
        self.distinct.append(len(counts))
        self.terms.extend(counts.keys())
        self.tf.extend(counts.values())

    def batches(self, number: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The segment's rows: terms in order, their postings by stratum, count and place."""
        # places follow ids, so that ties in a segment go to the smaller id; NULL ids come last
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        known = [self.ids[i] for i in order if self.ids[i] is not None]
        coded = pa.array(self.terms, pa.binary()).dictionary_encode()
        by_term = pc.array_sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(by_term), np.int64)
        rank[by_term] = np.arange(len(by_term))
        term = rank[coded.indices.to_numpy()]
        m, tf = np.repeat(np.array(self.m, np.int64), self.distinct), np.array(self.tf, np.int64)
        doc = np.repeat(place, self.distinct)
        sort = np.lexsort((doc, tf, m, term))
        term, m, tf, doc = term[sort], m[sort], tf[sort], doc[sort]
        names = coded.dictionary.take(pa.array(by_term)).cast(pa.string())
        ends = np.searchsorted(term, np.arange(len(names) + 1))
        ids = pa.array([known], pa.list_(pa.int64()))
        blank = [pa.array([[]], schema.field(c).type) for c in ("m", "tf", "doc")]
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.nulls(1, pa.string()), pa.array([len(order)], pa.int32()), *blank, ids], schema=schema)
        for first in range(0, len(names), ROWS):
            bounds = ends[first:first + ROWS + 1]
            n, (low, high) = len(bounds) - 1, (bounds[0], bounds[-1])
            lists = [pa.ListArray.from_arrays(pa.array(bounds - low, pa.int32()), pa.array(x[low:high])) for x in (m, tf, doc)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, number)), names[first:first + n], pa.array(np.diff(bounds), pa.int32()),
                 *lists, pa.nulls(n, schema.field("ids").type)], schema=schema)


def count_terms(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TERM)).cast("bigint")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index of all terms of whole texts.  Lengths are summed first, for the normalisers; texts
    are then cut once, and no posting is shuffled.  Documents without a term (NULL and empty
    texts among them) take no part; rows of equal ids are documents of their own."""
    n_docs, n_terms = docs.select(count_terms(F.col(text_col)).alias("n")).agg(
        F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()

    layout = to_arrow_schema(T.StructType.fromDDL(POSTINGS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 24, Segment()
        for batch in batches:
            for doc_id, text in zip(*batch.columns):
                counts = terms(text.as_py())
                if not counts:
                    continue
                held.add(doc_id.as_py(), counts, 50 + 50 * counts.total() * n_docs // n_terms)
                if len(held.tf) >= SEGMENT:
                    yield from held.batches(number, layout)
                    number, held = number + 1, Segment()
        if held.ids:
            yield from held.batches(number, layout)

    rows = docs.select(F.col(id_col).cast("bigint"), F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    return Index(keep(rows.mapInArrow(run, POSTINGS)), n_docs, n_terms)


# -- the search --------------------------------------------------------------------------
def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of runs, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Strata:
    """The postings of one segment for the terms of the items, as runs of equal stratum."""

    def __init__(self, names: list[str], m: list[np.ndarray], tf: list[np.ndarray], doc: list[np.ndarray]):
        rows = np.repeat(np.arange(len(names)), [len(x) for x in m])
        m, tf, self.doc = (np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64) for x in (m, tf, doc))
        first = np.ones(len(m), bool)  # of a run of equal row, stratum and count
        first[1:] = (rows[1:] != rows[:-1]) | (m[1:] != m[:-1]) | (tf[1:] != tf[:-1])
        counted = np.flatnonzero(first)
        self.impact = np.repeat(impacts(tf[counted], m[counted]), np.diff(np.append(counted, len(m))))
        first[1:] = (rows[1:] != rows[:-1]) | (m[1:] != m[:-1])
        self.start = np.flatnonzero(first)
        self.length = np.diff(np.append(self.start, len(m)))
        # counts rise within a stratum, and impacts with them
        self.highest = self.impact[self.start + self.length - 1]
        normalisers, self.stratum = np.unique(m[self.start], return_inverse=True)
        self.count = len(normalisers)
        ends = np.searchsorted(rows[self.start], np.arange(len(names) + 1))
        self.runs = {name: slice(a, b) for name, a, b in zip(names, ends, ends[1:])}
        self.scores = np.zeros(int(self.doc.max(initial=-1)) + 1, np.int64)

    def best(self, weights: dict[str, int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best documents, best first, ties to the smaller place."""
        own = [(self.runs[t], w) for t, w in weights.items() if t in self.runs]
        places, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        if not own:
            return places, scores
        runs = np.concatenate([np.arange(r.start, r.stop) for r, _ in own])
        heavy = np.repeat([w for _, w in own], [r.stop - r.start for r, _ in own])
        bound = np.zeros(self.count, np.int64)
        np.add.at(bound, self.stratum[runs], heavy * self.highest[runs])
        order = np.argsort(-bound, kind="stable")
        turn = np.empty(self.count, np.int64)
        turn[order] = np.arange(self.count)
        by_turn = np.argsort(turn[self.stratum[runs]], kind="stable")
        runs, heavy = runs[by_turn], heavy[by_turn]
        ends = np.searchsorted(turn[self.stratum[runs]], np.arange(self.count + 1))
        at, step, least = 0, FIRST_VISIT, 1
        while at < self.count and bound[order[at]] >= least:
            upto = min(at + step, self.count)
            part = slice(ends[at], ends[upto])
            picked = spans(self.start[runs[part]], self.length[runs[part]])
            docs = self.doc[picked]
            np.add.at(self.scores, docs, self.impact[picked] * np.repeat(heavy[part], self.length[runs[part]]))
            docs = np.unique(docs)
            places, scores = np.append(places, docs), np.append(scores, self.scores[docs])
            self.scores[docs] = 0
            top = np.lexsort((places, -scores))[:k]
            places, scores = places[top], scores[top]
            if len(scores) == k:  # an equal score may still win by its id
                least = max(int(scores[-1]), 1)
            at, step = upto, 2 * step
        return places[scores > 0], scores[scores > 0]


def search(index: Index, items: DataFrame, k: int = 50, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``k`` best documents of every item: ``item_id``, ``rank`` from 1, ``doc_id`` and
    ``score`` above 0; equal scores by ascending ``doc_id``, NULL last.

    Rows of one ``item_id`` are one item with the terms of all; a NULL id is an item of its
    own; items without a term in the index have no rows.  Items are searched in blocks of
    ``ITEM_BYTES``, each one scan of their terms' postings."""
    spark = items.sparkSession
    kind = items.schema[item_id].dataType.simpleString()
    rows = items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + size // ITEM_BYTES
    found = None
    for block in range(blocks):
        asked: dict = {}
        for name, text in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect():
            asked.setdefault(name, set()).update(t.decode() for t in terms(bytes(text)))
        best = search_block(index, [sorted(a) for a in asked.values()], k)
        names = spark.createDataFrame(list(enumerate(asked)), f"item int, item_id {kind}")
        best = best.join(F.broadcast(names), "item").select("item_id", "doc_id", "score")
        found = best if found is None else found.unionByName(best)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search_block(index: Index, asked: list[list[str]], k: int) -> DataFrame:
    """The k best documents of every segment for each list of terms."""
    spark = index.postings.sparkSession
    wanted = spark.createDataFrame([(t,) for t in sorted({t for own in asked for t in own})], "term string")
    used = index.postings.join(F.broadcast(wanted), "term", "left_semi")
    df = dict(used.groupBy("term").agg(F.sum("docs")).collect())
    weights = [{t: weight(index.n_docs, df[t]) for t in own if t in df} for own in asked]
    sent = spark.sparkContext.broadcast(weights)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids = next((i for i in rows["ids"] if i is not None), [])
        rows = rows[rows["term"].notna()]
        strata = Strata(list(rows["term"]), list(rows["m"]), list(rows["tf"]), list(rows["doc"]))
        out: tuple[list, list, list] = ([], [], [])
        for item, own in enumerate(sent.value):
            places, scores = strata.best(own, k)
            for column, values in zip(out, ([item] * len(places), (int(ids[p]) if p < len(ids) else None for p in places), scores.tolist())):
                column.extend(values)
        return pd.DataFrame({"item": pd.Series(out[0], dtype="int32"), "doc_id": pd.Series(out[1], dtype="Int64"), "score": pd.Series(out[2], dtype="int64")})

    listed = index.postings.where("term IS NULL")
    columns = ["segment", "term", "m", "tf", "doc", "ids"]
    return used.select(columns).unionByName(listed.select(columns)).groupBy("segment").applyInPandas(run, FOUND)
