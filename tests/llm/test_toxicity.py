import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainwise.llm import toxicity as T

STEMS = ["vorgl", "skramp", "tulnex"]


@pytest.fixture(scope="module")
def corpus(spark):
    """Prose with an insult (a stem and an ending) in the toxic documents, and its labels."""
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(700):
        words = ["".join(rng.choices(["th", "er", "on", "an", "re"], k=rng.randint(1, 3))) for _ in range(rng.randint(20, 120))]
        toxic = int(i % 3 == 0)
        for _ in range(1 + len(words) // 40 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(STEMS) + rng.choice(["a", "en", "oss", "ix", "um"]))
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


@pytest.fixture(scope="module")
def model(corpus):
    return T.learn(*corpus)


def test_held_out_documents_are_told_apart(corpus, model):
    docs, labels = corpus
    rows = T.toxicity(docs, model).join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.predicted == r.toxic for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_unseen_forms_share_their_subwords(model):
    prose = "there on an there rean " * 10
    for word in ("vorgloid", "skrampish", "tulnexes"):
        assert model.score(f"{prose} {word} {prose}".encode()) > 0.5 > model.score(f"{prose}{prose}".encode())


def test_held_out_labels_and_other_columns_change_nothing(corpus, model):
    docs, labels = corpus
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    flipped = labels.withColumn("toxic", F.when(fold, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = T.learn(docs.repartition(3), flipped.repartition(2))
    assert np.allclose(again.weight, model.weight) and np.allclose(again.scale, model.scale)


def test_score_is_that_of_the_highest_window(model):
    """Word by word, n-gram by n-gram."""
    def buckets(word):
        marked = b" " + word + b" "
        for n in T.LENGTHS:
            for i in range(len(marked) - n + 1):
                h = marked[i]
                for c in marked[i + 1:i + n]:
                    h = (h * 0x01000193 & 0xFFFFFFFF) ^ c
                yield ((h + n & 0xFFFFFFFF) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - T.BUCKET_BITS)

    rng = random.Random(4)
    for n in (1, 2, 4, 5, 40):
        words = ["".join(rng.choices(["th", "er", "vorgl", "an", "ö"], k=rng.randint(1, 3))) for _ in range(n)]
        own = [list(buckets(w.encode())) for w in words]
        tops = []
        for i in range(max(1, n - T.WINDOW + 1)):
            window = [b for w in own[i:i + T.WINDOW] for b in w]
            tops.append(sum(model.weight[b] for b in window) / len(window) + model.bias)
        a, b, c = model.scale
        text = ", ".join(words).upper().replace("Ö", "ö").encode()
        assert model.score(text) == pytest.approx(1 / (1 + np.exp(-(a * max(tops) + b * np.log1p(n) + c))))


def test_every_word_of_a_sampled_text_is_in_a_window():
    for n in (0, 1, 3, 4, 5, 200, 1003):
        text = [f"w{i % 90}".encode() for i in range(n)]
        words, windows = T.gather([(1, *T.numbered(text))])
        assert windows[0].shape == (0, 4) and len(windows[1]) == -(-n // 4)
        spelled = [[words[i - 1] for i in row if i] for row in windows[1]]
        assert [w for row in spelled[:n // 4] for w in row] == text[:n // 4 * 4]
        if n:
            assert spelled[-1] == text[-4:]


def test_bound_on_bytes_takes_whole_texts(corpus, monkeypatch):
    """Texts beyond the bound give no window; those before it are read to the end."""
    sizes = []
    monkeypatch.setattr(T, "fit_windows", lambda words, windows: sizes.append(list(map(len, windows))) or T.Model(np.zeros(1 << T.BUCKET_BITS)))
    T.learn(*corpus)
    monkeypatch.setattr(T, "BYTES_PER_CLASS", 1)
    T.learn(*corpus)
    assert all(one < whole and one >= 5 for one, whole in zip(sizes[1], sizes[0]))


def test_features_are_the_words_own(model):
    buckets, n = T.features([b"abc", b"d", b"abc"])
    assert n[0] == n[2] and (buckets[:n[0]] == buckets[-n[2]:]).all()
    assert (T.features([b"zz", b"d"])[0][T.features([b"zz", b"d"])[1][0]:] == T.features([b"d"])[0]).all()


def test_blocks_of_a_long_text(model, monkeypatch):
    text = ("there on an rean " * 300 + "vorglix " + "on there " * 200).encode()
    whole = model.highest(text)
    monkeypatch.setattr(T, "BLOCK_BYTES", 80)
    assert model.highest(text) == pytest.approx(whole)


def test_edge_cases(spark, corpus, model):
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "..."), (2, "..."), (3, "vorgla " * 5000)], "doc_id bigint, text string")
    rows = T.toxicity(docs.withColumn("score", F.lit("old")), model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id != 3}) == 1 and rows[0].predicted == 0
    none = T.learn(docs, corpus[1].limit(0))
    assert all(r.predicted == 0 for r in T.toxicity(docs, none).collect())
    one = T.learn(docs, spark.createDataFrame([(3, 0), (None, 1), (3, None)], "doc_id bigint, toxic int"))
    assert all(r.predicted == 0 for r in T.toxicity(docs, one).collect())
    assert T.toxicity(docs.limit(0), model).count() == 0
