import random

import pytest
from pyspark.sql import functions as F

from grainwise.llm import decontaminate as D


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def least_edits(passage, text):
    """Fewest edits of the passage against any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(passage, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def prose(rng, n):
    return " ".join("".join(rng.choices(["th", "er", "on", "an", "re", "ing"], k=rng.randint(1, 4))) for _ in range(n))


def damaged(rng, text, k):
    out = list(text)
    for _ in range(k):
        at = rng.randrange(len(out))
        kind = rng.choice("sid")
        out[at:at + 1] = {"s": [rng.choice("abc")], "i": [out[at], rng.choice("xyz")], "d": []}[kind]
    return "".join(out)


def test_every_occurrence_within_the_budget_is_found(spark, docs_of):
    rng = random.Random(2)
    items = [prose(rng, n) for n in (9, 14, 25, 40)]
    texts = []
    for i in range(60):
        passage = damaged(rng, rng.choice(items), rng.choice([0, 0, 1, 3, 6, 12, 25]))
        texts.append(prose(rng, rng.randint(0, 30)) + " " + (passage.upper() if i % 5 == 0 else passage) + ". " + prose(rng, rng.randint(0, 30)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in D.find_passages(docs_of(list(enumerate(texts))), bench).collect()}
    want = {}
    for d, t in enumerate(texts):
        for i, p in enumerate(items):
            passage = D.normalised(p.encode())
            least = least_edits(passage, D.normalised(t.encode()))
            if least <= D.edit_budget(len(passage), D.EDIT_SHARE):
                want[d, i] = least
    assert set(got) == set(want)
    assert all(got[k] == want[k] for k in want)
    assert any(want.values()) and len(want) < len(texts)


def test_spans_hold_the_match(spark, docs_of):
    bench = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog")], "item_id bigint, text string")
    text = "Intro words here. the quick brown  FOX jumped over the lazy dog! More. The quick brown fox jumps over the lazy dog"
    rows = sorted(D.find_passages(docs_of([(7, text)]), bench).collect(), key=lambda r: r.start)
    clean = D.normalised(text.encode())
    assert [clean[r.start:r.end].strip() for r in rows] == [b"the quick brown fox jumped over the lazy dog", b"the quick brown fox jumps over the lazy dog"]
    assert [r.edits for r in rows] == [2, 0]


@pytest.mark.parametrize("k", [0, 2, 5])
def test_banded_alignment(k):
    rng = random.Random(k)
    for _ in range(40):
        p = damaged(rng, "abcabdabeabfabg" * 2, 2)
        region = damaged(rng, "xx" + p + "yyy", k)
        found, least = D.occurrence(p.encode(), region.encode(), k), least_edits(p, region)
        if least > k:
            assert found is None
        else:
            assert found[2] == least == edits(p, region[found[0]:found[1]])


def test_long_texts_are_searched_in_stretches(spark, docs_of, monkeypatch):
    from grainwise.llm import decontaminate

    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    rng = random.Random(5)
    items = [prose(rng, 20), prose(rng, 30)]
    text = " ".join([prose(rng, 50), items[0], prose(rng, 33), items[1], prose(rng, 7), items[0]])
    index = D.Index([0, 1], [D.normalised(i.encode()) for i in items], D.EDIT_SHARE)
    assert sorted(item for _, item, _, _, edits in D.searcher(index)(iter([(1, text.encode())])) if edits == 0) == [0, 0, 1]


def test_small_index_blocks_give_the_same(spark, small, small_docs, monkeypatch):
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    want = sorted(map(str, D.find_passages(small_docs, bench).collect()))
    monkeypatch.setattr(D, "INDEX_BYTES", 2000)
    assert sorted(map(str, D.find_passages(small_docs, bench).collect())) == want and want


def test_whole_passages_in_documents_are_found(spark, small, small_docs):
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in D.find_passages(small_docs, bench).collect()}
    items = [(r.item_id, r.text) for r in bench.collect()]
    assert got >= {(d.doc_id, i) for d in small_docs.collect() for i, t in items if t in d.text}


def test_nulls_repeats_empty_tables_and_clean_documents(spark, docs_of):
    bench = spark.createDataFrame([(1, "one two three four five six"), (None, None), (2, ""), (3, "hi")], "item_id bigint, text string")
    docs = docs_of([(1, "x one two three four five six"), (1, "x one two three four five six"), (None, "One, two three four five six!"),
                    (2, None), (3, ""), (4, "one two hi")]).withColumn("_hash", F.lit("old"))
    assert sorted(((r.doc_id, r.item_id) for r in D.find_passages(docs, bench).collect()), key=str) == [(1, 1), (1, 1), (None, 1)]
    left = D.clean_documents(docs, bench)
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r["_hash"]) for r in left.collect()) == [(2, "old"), (3, "old"), (4, "old")]
    assert D.find_passages(docs, bench.limit(0)).count() == 0
    assert D.find_passages(docs.limit(0), bench).count() == 0


def test_the_query_reports_short_passages(spark, tmp_path, monkeypatch):
    from grainwise.llm.queries import QUERIES

    items = [(1, "Hi"), (2, "a b c d"), (3, "seven77"), (4, "hi!"), (5, "..."), (6, "x"), (7, None), (8, "eight888"), (9, "\u00fc")]
    docs = [(1, "hi hi, this chip"), (2, "A b c d e"), (3, "a b c do"), (4, "seven77"), (5, None), (6, ""), (7, "x " * 40 + "eight888 \u00fc"), (None, "x")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for d, text in docs:
        clean = D.normalised((text or "").encode())
        for i, passage in items:
            own = D.normalised((passage or "").encode())
            want += [(d, i, at, at + len(own), 0) for at in range(len(clean)) if len(own) > 2 and clean.startswith(own, at)]
    for size in (D.BLOCK_BYTES, 7, 1):
        monkeypatch.setattr(D, "BLOCK_BYTES", size)
        got = [(r.doc_id, r.item_id, r.start, r.end, r.edits) for r in QUERIES["op3_decontaminate"](spark, str(tmp_path)).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert len(want) == 49


def test_an_occurrence_at_the_border_of_stretches_is_one(monkeypatch):
    """Exact and damaged passages at every offset around the border of a block."""
    rng = random.Random(5)
    passage = prose(rng, 16)[:94].encode()
    index = D.Index([7], [D.normalised(passage)], D.EDIT_SHARE)
    assert index.budget[0] == 9
    for copy in (passage, damaged(rng, passage.decode(), 4).encode()):
        for offset in range(150, 420):
            text = D.normalised(b"q" * offset + b" " + copy + b" " + b"z" * 700)
            monkeypatch.setattr(D, "BLOCK_BYTES", 1 << 20)
            whole = list(index.matches(text))
            monkeypatch.setattr(D, "BLOCK_BYTES", 300)
            cut = list(index.matches(text))
            assert len(whole) == len(cut) == 1
            assert cut[0][3] == whole[0][3] and abs(cut[0][1] - whole[0][1]) <= 9 and abs(cut[0][2] - whole[0][2]) <= 9
