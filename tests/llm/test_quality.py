import random

import numpy as np
from pyspark.sql import functions as F

from grainwise.llm import quality as Q


def test_labellers_find_their_noise():
    rng = random.Random(3)
    prose = ". ".join("The " + " ".join(rng.choices([f"word{i}" for i in range(300)], k=9)) for _ in range(12)) + "."
    assert Q.BAD not in Q.digits(np.array([Q.votes(prose.encode())]))
    for junk in ("buy*** now&&& cheap%%% deals$$$ ", "WIN!! A!! PRIZE!! NOW!! ", "home | news | shop | about | ", "spam " * 8):
        assert (Q.digits(np.array([Q.votes((junk * 6).encode())])) == Q.BAD).sum() >= 2
    assert (Q.digits(np.array([Q.votes(None), Q.votes(b" \n")])) == Q.BAD).all()


def test_blocks_give_the_same_measures(monkeypatch):
    text = ("one two two three | four!! FIVE " * 40).encode()
    whole = Q.profile(text)
    monkeypatch.setattr(Q, "BLOCK_BYTES", 1 << 30)
    again = Q.profile(text)
    assert (whole[0] == again[0]).all() and np.allclose(whole[1], again[1])


def test_accuracies_are_estimated():
    """Votes drawn from known chances: the estimate finds them again without labels."""
    rng = np.random.default_rng(1)
    n, m = 20_000, len(Q.LABELLERS)
    good = rng.random(n) < 0.8
    right = rng.uniform(0.7, 0.95, m)
    silent = rng.uniform(0.0, 0.4, m)
    votes = np.where(rng.random((n, m)) < right, np.where(good, Q.GOOD, Q.BAD)[:, None], np.where(good, Q.BAD, Q.GOOD)[:, None])
    votes[rng.random((n, m)) < silent] = Q.NONE
    codes, counts = np.unique(votes @ (3 ** np.arange(m - 1, -1, -1)), return_counts=True)
    weak = Q.estimate(codes, counts.astype(float))
    assert abs(weak.prior - good.mean()) < 0.02
    for j in range(m):
        said = weak.chances[j, 1]
        assert abs(said[Q.GOOD] / (said[Q.GOOD] + said[Q.BAD]) - right[j]) < 0.03
    posterior = np.array([weak.posterior[c] for c in votes @ (3 ** np.arange(m - 1, -1, -1))])
    assert ((posterior >= 0.5) == good).mean() > 0.97


def test_documents_are_told_apart_as_their_labels_say(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    weak, scorer = Q.learn(docs)
    rows = Q.quality(docs.select("doc_id", "text"), weak, scorer).join(labels, "doc_id").collect()
    assert np.mean([r.keep == r.quality for r in rows]) > 0.95
    clean = [r for r in rows if r.quality == 1]
    assert np.mean([r.keep for r in clean]) > 0.98
    again = Q.learn(docs.repartition(3))
    assert np.allclose(again[1].weight, scorer.weight)


def test_edge_cases(docs_of):
    rng = random.Random(2)
    docs = docs_of([(None, None), (1, ""), (1, ""), (2, "word " * 30_000)] + [(i, " ".join(rng.choices("ab cd ef gh ij".split(), k=30))) for i in range(3, 40)])
    docs = docs.withColumn("keep", F.lit("old"))
    rows = Q.quality(docs, *Q.learn(docs)).collect()
    assert len(rows) == 41 and all(0 <= r.score <= 1 and r.keep in (0, 1) for r in rows)
    assert len({r.score for r in rows if not r.text}) == 1
    none = Q.learn(docs.limit(0))
    assert {r.score for r in Q.quality(docs, *none).collect()} == {0.5}
    assert Q.quality(docs.limit(0), *none).count() == 0
