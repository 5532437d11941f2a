from collections import Counter

from pyspark.sql import functions as F

from grainwise.llm import token_counts as C


def test_lengths_equal_those_of_another_library(small_docs):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    other.encode_special_tokens = True
    for r in C.with_length(small_docs, C.read_ranks()).collect():
        assert r.n_tokens == len(other.encode(r.text, add_special_tokens=False).ids)


def test_histogram_answers_every_limit(spark, monkeypatch):
    monkeypatch.setattr(C, "RANGE", 4)
    lengths = [0, 0, 3, 3, 3, 7, 8, 20, 21, 21, 400]
    hist = C.histogram(spark.createDataFrame([(n,) for n in lengths] + [(None,)], "n_tokens bigint"))
    rows = hist.collect()
    assert {r.length: r.docs for r in rows} == Counter(lengths)
    for r in rows:
        assert r.tokens == r.length * r.docs
        assert r.docs_from == sum(n >= r.length for n in lengths) and r.docs_upto == sum(n <= r.length for n in lengths)
        assert r.tokens_from == sum(n for n in lengths if n >= r.length)
        assert r.truncated_tokens == sum(min(n, r.length) for n in lengths)
    assert [C.truncated_total(hist, k) for k in (0, 5, 1000)] == [sum(min(n, k) for n in lengths) for k in (0, 5, 1000)]
    assert [C.quantile(hist, q) for q in (0.1, 0.5, 1.0)] == [0, 7, 400]


def test_edge_cases(docs_of):
    docs = docs_of([(1, None), (None, ""), (2, "<|endoftext|>"), (2, "<|endoftext|>"), (3, "a" * 20_000)]).withColumn("n_tokens", F.lit("x"))
    rows = C.with_length(docs, C.read_ranks()).collect()
    assert [r.n_tokens for r in rows if not r.text] == [0, 0]
    assert {r.n_tokens for r in rows if r.doc_id == 2} == {7}
    empty = C.histogram(C.with_length(docs.limit(0), C.read_ranks()))
    assert empty.count() == 0 and C.quantile(empty, 0.5) is None and C.truncated_total(empty, 5) == 0
