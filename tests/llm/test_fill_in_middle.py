import hashlib

import pytest
from pyspark.sql import functions as F

from grainwise.llm import fill_in_middle as M

TEXTS = ["", " ", None, "a<P>b", "xy", "é😀" * 900, "z", "<M>", "< P> fine", "a\x00b\r\n"]


def output(doc_id, text):
    """The contract, on whole texts."""
    text = text or ""
    code = hashlib.sha256(b"1:" + (b"" if doc_id is None else str(doc_id).encode())).hexdigest()
    h1, h2, h3, h4 = (int(code[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}", text
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}", text


def brute(rows):
    out = []
    for doc_id, text in rows:
        *about, made, back = output(doc_id, text)
        out.append((doc_id, *about, *(hashlib.sha256(t.encode()).hexdigest() for t in (made, back))))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows(small_docs):
    given = [tuple(r) for r in small_docs.select("doc_id", "text").collect()]
    return given + [(10**6 + i, t) for i, t in enumerate(TEXTS * 6)]


@pytest.mark.parametrize("unit", [M.UNIT, 100])
def test_against_whole_texts(docs_of, rows, unit):
    found = M.fill_in_middle(docs_of(rows), unit=unit)
    want = brute(rows)
    assert sorted(map(tuple, found.collect()), key=repr) == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"}


def test_texts_and_their_restoration(docs_of, rows):
    """Real outputs, and the texts that come back from nothing but them."""
    ordered = M.in_output_order(M.pieces(docs_of(rows), unit=50))
    made = sorted(((r["doc_id"], r["text"]) for r in M.texts(ordered).collect()), key=repr)
    assert made == sorted(((i, output(i, t)[4]) for i, t in rows), key=repr)
    back = sorted(((r["doc_id"], r["text"]) for r in M.texts(M.in_text_order(ordered)).collect()), key=repr)
    assert back == sorted(((i, t or "") for i, t in rows), key=repr)


def test_repeated_rows_and_null_ids(docs_of):
    """Equal rows in one task and in several, equal ids with different texts, NULL ids."""
    rows = [(1, "one two three four")] * 300 + [(1, "another text")] * 2 + [(None, "no id")] * 3 + [(None, "")] * 2
    for parts in (1, 4):
        found = M.fill_in_middle(docs_of(rows).repartition(parts), unit=4)
        assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)


def test_empty_table_and_clashing_columns(docs_of):
    assert M.fill_in_middle(docs_of([])).collect() == []
    docs = docs_of([(1, "abc")]).withColumn("place", F.lit(9)).withColumn("form", F.lit("x")).withColumn("doc_key", F.lit("y"))
    assert sorted(map(tuple, M.fill_in_middle(docs).collect())) == brute([(1, "abc")])


def test_pieces_are_bounded_and_shuffled_once(docs_of):
    docs = docs_of([(i, "é" * 1000) for i in range(8)])
    assert max(len(r["piece"]) for r in M.pieces(docs, unit=64).collect()) <= 64
    plan = M.fill_in_middle(docs)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("Exchange") == 1
