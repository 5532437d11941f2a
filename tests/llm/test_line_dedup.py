import random

import pytest
from pyspark.sql import functions as F

from grainwise.llm import line_dedup as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(docs, near=True):
    """Texts left, with documents in order of id."""
    seen, out = [], []
    for i, text in sorted(docs, key=lambda d: (d[0] is None, d[0])):
        kept = []
        for line in (text or "").split("\n"):
            words = line.encode().lower().split()
            if not words:
                kept.append(line)
                continue
            if not any(words == s or near and max(len(words), len(s)) >= 5 and abs(len(words) - len(s)) <= 1 and distance(words, s) <= 1 for s in seen):
                kept.append(line)
            seen.append(words)
        out.append((i, None if text is None else "\n".join(kept)))
    return sorted(out, key=str)


def got(docs, **options):
    return sorted(((r.doc_id, r.text) for r in L.dedup_lines(docs, **options).collect()), key=str)


def planted(seed, n=60):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(30)]
    pool = [[rng.choice(words) for _ in range(rng.choice([1, 3, 4, 5, 6, 8, 12]))] for _ in range(25)]
    docs = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(0, 8)):
            line = list(rng.choice(pool))
            at = rng.randrange(len(line))
            kind = rng.choice(["same", "same", "swap", "drop", "add"])
            line[at:at + 1] = {"same": [line[at]], "swap": [rng.choice(words)], "drop": [], "add": [line[at], rng.choice(words)]}[kind]
            text = rng.choice([" ", "  ", "\t"]).join(line)
            lines.append(rng.choice([text, text.upper(), ""]))
        docs.append((i, "\n".join(lines)))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("near", [True, False])
def test_planted_lines_against_brute_force(docs_of, seed, near):
    docs = planted(seed)
    assert got(docs_of(docs).repartition(3), near=near) == brute(docs, near)


def test_documents_against_brute_force(small_docs):
    docs = [(r.doc_id, r.text) for r in small_docs.select("doc_id", "text").collect()]
    assert got(small_docs) == brute(docs)


def test_neighbours_share_a_variant_and_a_half():
    rng = random.Random(3)
    for _ in range(400):
        a = [b"%d" % rng.randint(0, 3) for _ in range(rng.randint(4, 9))]
        b = list(a)
        at = rng.randrange(len(a))
        b[at:at + 1] = rng.choice([[b"x"], [a[at], b"x"], [], [b"x", a[at]]])
        if rng.random() < 0.3:
            b.insert(0, b"y")
        fits = distance(a, b) <= 1 and max(len(a), len(b)) >= 5
        assert bool(set(L.variants(a)) & set(L.variants(b))) == fits
        assert L.within_one_edit(a, b) == (distance(a, b) <= 1)
        if fits:
            assert set(L.halves(a)) & set(L.halves(b))


def test_a_template_with_many_fillings(docs_of):
    docs = [(i, f"page {i} of the whole report\nown line number {i}") for i in range(200)]
    assert got(docs_of(docs)) == brute(docs)


def test_edge_cases(docs_of):
    docs = docs_of([(None, "a b\nc"), (3, None), (4, ""), (5, "\n \n"), (6, "c\nc\nA  B"), (6, "c\nc\nA  B")]).withColumn("lines", F.lit("old")).withColumn("row", F.lit(1))
    out = L.dedup_lines(docs)
    assert set(out.columns) == {"doc_id", "text", "lang", "source", "n_chars", "row", "lines", "kept_lines"}
    rows = sorted(((r.doc_id, r.text, r.lines, r.kept_lines) for r in out.collect()), key=str)
    assert rows == sorted([(None, "", 2, 0), (3, None, 0, 0), (4, "", 0, 0), (5, "\n \n", 0, 0), (6, "c\nA  B", 3, 2), (6, "c\nA  B", 3, 2)], key=str)
    assert L.dedup_lines(docs.limit(0)).count() == 0
