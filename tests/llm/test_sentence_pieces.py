import hashlib
import random

import pytest
from pyspark.sql import functions as F

from grainwise.llm import queries
from grainwise.llm import sentence_pieces as S

TEXTS = ["", " ", "  a", "a ", "a  ", "▁a", "a▁b ▁▁ c", "\n", "a\tb\r\n", "\x00x", "<s> </s> <0x41>", "﻿ab​",
         "퟿😀x", None, "x" * 5000 + " " * 300 + "y", "日本語テキスト 12345 3.14 (a) '''...", "naïve café ﬁ Ａ", "-" * 5000]


@pytest.fixture(scope="module")
def vocabulary():
    return S.read_vocabulary()


def check(rows, vocabulary):
    for r in rows:
        ids = vocabulary.processor.encode(r["text"] or "")
        assert list(r["ids"]) == ids and r["decoded"] == vocabulary.processor.decode(ids)


@pytest.mark.parametrize("head", [S.HEAD, 300, 0])
def test_as_the_library(spark, docs_of, small_docs, vocabulary, head):
    """Whole texts, encoded at once by the library, whatever part of the chunks is joined."""
    docs = small_docs.limit(60).select("doc_id", "text").unionByName(
        docs_of([(i, t) for i, t in enumerate(TEXTS)] * 3).select("doc_id", "text"))
    rows = S.decode(S.encode(docs, vocabulary, head=head), vocabulary).collect()
    assert len(rows) == 60 + 3 * len(TEXTS)
    check(rows, vocabulary)


def test_random_texts(spark, vocabulary):
    rng = random.Random(3)
    letters = "ab  \n▁é’.,;()0123日 ß́\U0001F600" + "".join(chr(rng.randrange(0x20, 0xD000)) for _ in range(40))
    texts = ["".join(rng.choices(letters, k=rng.randrange(0, 60))) for _ in range(300)]
    docs = spark.createDataFrame(enumerate(texts), "doc_id bigint, text string")
    check(S.decode(S.encode(docs, vocabulary, head=50), vocabulary).collect(), vocabulary)


def test_every_chunk_once(spark, docs_of, vocabulary):
    docs = docs_of([(1, "a bb a"), (2, "bb a"), (3, None)])
    rows = {r["chunk"]: r["n"] for r in S.chunk_counts(docs, vocabulary).collect()}
    assert rows == {"▁a": 3, "▁bb": 2}
    known = S.segment_all(S.frequent(S.chunk_counts(docs, vocabulary)), vocabulary)
    assert set(known) == {"▁a", "▁bb"} and known["▁a"] == vocabulary.pack("▁a")


def test_a_task_adds_a_chunk_once(vocabulary, monkeypatch):
    made = []
    pack = S.Vocabulary.pack
    monkeypatch.setattr(S.Vocabulary, "pack", lambda self, chunk: (made.append(chunk), pack(self, chunk))[1])
    table = S.ChunkTable({"▁a": b"known"}, vocabulary)
    assert [table[c] for c in ("▁a", "▁b", "▁b")] == [b"known", pack(vocabulary, "▁b"), pack(vocabulary, "▁b")]
    assert made == ["▁b"]
    table["x" * S.LONGEST]
    table["x" * (S.LONGEST + 1)]
    assert len(table) == 3 <= table.bound


def test_head_is_bounded(spark, vocabulary, monkeypatch):
    counts = spark.createDataFrame([(f"c{i}", 1 + i) for i in range(100)], "chunk string, n bigint")
    for limit in (0, 5, 30, 1000):
        known = {int(r["chunk"][1:]) for r in S.frequent(counts, limit).collect()}
        assert len(known) <= limit and (limit < 5 or known) and min(known, default=100) == 100 - len(known)
    monkeypatch.setattr(S, "HEAD_CHARS", 30)
    assert 0 < S.frequent(counts, 1000).count() <= 10


def test_table_starts_anew(spark, docs_of, vocabulary, monkeypatch):
    monkeypatch.setattr(S, "ADDED", 3)
    docs = docs_of([(i, f"word{i} other{i} more{i % 7}") for i in range(50)])
    check(S.decode(S.encode(docs, vocabulary, head=2), vocabulary).collect(), vocabulary)


def test_tables_and_columns(spark, docs_of, vocabulary):
    """An empty table, clashing columns, NULL ids."""
    assert S.encode(docs_of([]), vocabulary).count() == 0
    docs = docs_of([(None, "a b"), (4, "c")]).withColumn("ids", F.lit("mine")).withColumn("key", F.lit(7)).withColumn("decoded", F.lit(0))
    out = S.decode(S.encode(docs, vocabulary), vocabulary)
    assert {r["doc_id"]: (r["key"], r["decoded"]) for r in out.collect()} == {None: (7, "a b"), 4: (7, "c")}
    blank = S.decode(docs_of([(1, "a")]).withColumn("ids", F.lit(None).cast("array<int>")), vocabulary)
    assert blank.first()["decoded"] == ""


def test_unsuitable_models():
    with pytest.raises(OSError):
        S.read_vocabulary("/nowhere.model")
    assert S.neighbours(["ab", "▁bc", "x", "12", "▁▁"]) == ["12", "abc"]


def test_query(spark, small, vocabulary):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op11_sentence_pieces(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = vocabulary.processor.encode(texts[r["doc_id"]])
        want = [hashlib.sha256(t.encode()).hexdigest() for t in (",".join(map(str, ids)), vocabulary.processor.decode(ids))]
        assert [r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]] == [len(ids), *want]
