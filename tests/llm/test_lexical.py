import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainwise.llm import lexical as L


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def brute(docs, items, k):
    """The contract, document by document."""
    counted = [(i, Counter(words(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, total = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in counted:
            m = 100 - 50 + 50 * c.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                        for t in set(words(text)) if t in c)
            if score > 0:
                found.append((i, score))
        found.sort(key=lambda r: (-r[1], r[0] is None, r[0] or 0))
        out += [(item, rank, i, score) for rank, (i, score) in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


def run(spark, docs, items, k):
    docs = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    items = spark.createDataFrame(items, "item_id bigint, text string")
    found = L.search(L.build_index(docs), items, k)
    return sorted((tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def corpus(rng, n):
    vocabulary = [f"w{i}" for i in range(60)]
    return [(i, " ".join(rng.choices(vocabulary, [1 / (j + 1) for j in range(60)], k=rng.choice([1, 2, 5, 5, 5, 40]))))
            for i in range(n)]


@pytest.mark.parametrize("segment", [10_000, 40])
def test_against_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(L, "SEGMENT", segment)
    rng = random.Random(segment)
    docs = corpus(rng, 150)
    items = [(i, t) for i, (_, t) in enumerate(corpus(rng, 12))]
    for k in (3, 50):
        assert run(spark, docs, items, k) == brute(docs, items, k)


def test_edge_cases(spark):
    """NULLs, empty texts, ties, repeated rows, letters beyond ASCII, items without a match."""
    docs = [(5, "a b"), (3, "a b"), (None, "A B"), (3, "a b"), (9, None), (8, ""), (7, "-- !"), (2**60, "É é a"), (4, "x_y x")]
    items = [(1, "a"), (2, "É"), (3, None), (4, "zzz"), (5, "b x"), (None, "y")]
    assert run(spark, docs, items, 3) == brute(docs, items, 3)
    assert run(spark, [], items, 3) == [] and run(spark, docs, [], 3) == []
    assert run(spark, [(1, None)], items, 3) == []


def test_rows_of_one_item(spark):
    docs = [(1, "a c"), (2, "b"), (3, "c")]
    assert run(spark, docs, [(1, "a"), (1, "b a")], 5) == brute(docs, [(1, "a b")], 5)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(L, "ITEM_BYTES", 30)
    rng = random.Random(1)
    docs, items = corpus(rng, 40), [(i, t) for i, (_, t) in enumerate(corpus(rng, 9))]
    assert run(spark, docs, items, 4) == brute(docs, items, 4)


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = ("éa1 B-c " * 50).encode()
    for size in (1, 3, 10, 1000):
        monkeypatch.setattr(L, "BLOCK_BYTES", size)
        assert L.terms(text) == Counter({"éa1".encode(): 50, b"b": 50, b"c": 50})
    assert L.terms(b"x" * 100) == Counter([b"x" * 100])


def test_strata_below_the_bound_are_not_visited():
    """Short documents outscore all longer ones: the search ends before it sees them."""
    m = np.repeat(np.arange(50, 550), 4)
    strata = L.Strata(["t"], [m], [np.ones(len(m))], [np.arange(len(m))])
    seen = []
    spans = L.spans
    L.spans = lambda starts, lengths: (seen.append(int(lengths.sum())), spans(starts, lengths))[1]
    try:
        places, scores = strata.best({"t": 10, "missing": 5}, 6)
    finally:
        L.spans = spans
    assert places.tolist() == [0, 1, 2, 3, 4, 5] and sum(seen) < 20
    assert scores[0] == 10 * (10**9 // (1000 + 20 * 50))


def test_columns_of_other_names(spark, docs_of):
    docs = docs_of([(1, "a b"), (2, "a")]).withColumn("term", F.lit("x")).withColumn("segment", F.lit(1))
    items = spark.createDataFrame([("q", "b", 1)], "name string, words string, rank int")
    rows = L.search(L.build_index(docs), items, 5, "name", "words").collect()
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in rows] == [("q", 1, 1)]
