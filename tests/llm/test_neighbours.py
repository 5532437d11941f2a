import numpy as np
import pytest
from pyspark.sql import functions as F

from grainwise.llm import neighbours as N


def nearest(frame, **options):
    return N.nearest(frame, F.col("vec_id") % 50 == 0, **options)


def brute(rows, k=5, is_query=lambda i: i % 50 == 0):
    sound = sorted({(i, tuple(float(x) for x in v)) for i, v in rows if i is not None and v is not None
                    and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    out = []
    for i, v in sound:
        if is_query(i):
            a = np.array(v)
            near = [(-float(a @ np.array(w)) / (np.linalg.norm(a) * np.linalg.norm(w)), j) for j, w in sound if j != i and len(w) == len(v)]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted((round(s, 12), j) for s, j in near)[:k])]
    return out


def compare(got, want):
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-11)


def test_factor_one_is_exact(spark, small, monkeypatch):
    monkeypatch.setattr(N, "SHARD_ROWS", 150)
    monkeypatch.setattr(N, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(N, "LEAF_POINTS", 16)
    frame = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    compare(nearest(frame).collect(), brute(rows))


def test_relaxed_search_keeps_recall(spark, small, monkeypatch):
    monkeypatch.setattr(N, "LEAF_POINTS", 16)
    frame = spark.read.parquet(f"{small}/embeddings.parquet")
    want = {w[:3:2] for w in brute([(r.vec_id, r.embedding) for r in frame.collect()])}
    got = {(r.query_id, r.vec_id) for r in nearest(frame, relax=6.0).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_clusters_are_pruned_without_loss():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 8))
    points = np.repeat(centres, 100, axis=0) + rng.normal(scale=0.01, size=(2000, 8))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    ids = np.arange(2000)
    found = N.Search(ids, points, ids[::50], points[::50], 5, 1.0)
    found.walk(N.build(points, ids, rng), np.arange(40))
    near = points[::50] @ points.T
    near[np.arange(40), ids[::50]] = -9
    assert np.allclose(np.sort(near, axis=1)[:, :-6:-1], found.best)
    N.LEAF_POINTS, old = 32, N.LEAF_POINTS
    try:
        fine = N.Search(ids, points, ids[::50], points[::50], 5, 1.0)
        fine.walk(N.build(points, ids, rng), np.arange(40))
    finally:
        N.LEAF_POINTS = old
    assert np.allclose(fine.best, found.best) and fine.compared < 0.5 * near.size


def test_ties_unusable_vectors_and_repeats(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 2.0]), (100, [0.0, 0.0]), (150, None), (200, [float("nan"), 1.0]), (250, [float("inf"), 1.0]),
            (300, [None, 1.0]), (350, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (400, [1e-200, 1e-200]), (450, [1e200, -1e200]), (500, [])]
    rows += [(i, [3.0, 0.0]) for i in range(1, 40)] + [(7, [3.0, 0.0])] * 30
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("old"))
    got = nearest(frame).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    assert by[0] == [(i, 1.0) for i in range(1, 6)]
    assert set(by) == {0, 50, 400, 450} and by[400][0] == (0, round(2**-0.5, 9))
    assert nearest(frame.limit(0)).count() == 0
    assert nearest(frame.where("vec_id in (0, 350)")).count() == 0


@pytest.mark.parametrize("shards", [1, 7])
def test_floats_and_few_candidates(spark, shards, monkeypatch):
    monkeypatch.setattr(N, "SHARD_ROWS", max(1, 6 // shards))
    rows = [(i, [float(i % 3) + 0.5, 1.0, float(i)]) for i in (0, 1, 2, 50)]
    frame = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    compare(nearest(frame).collect(), brute(rows))


@pytest.mark.parametrize("kind", ["low rank with an offset", "decaying"])
def test_the_query_finds_all_neighbours_of_structured_vectors(spark, tmp_path, kind):
    from grainwise.llm.queries import QUERIES

    rng = np.random.default_rng(7)
    if kind == "decaying":
        points = rng.normal(size=(6000, 64)) / np.arange(1, 65)
    else:
        points = rng.normal(size=(6000, 16)) @ rng.normal(size=(16, 64)) + 4 * rng.normal(size=64)
    rows = [(i, v) for i, v in enumerate(points.tolist())]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.query_id, r.vec_id) for r in QUERIES["op5_neighbours"](spark, str(tmp_path)).collect()}
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    near = unit[::50] @ unit.T
    near[np.arange(120), np.arange(0, 6000, 50)] = -9
    assert got == {(50 * q, v) for q, own in enumerate(np.argsort(-near, axis=1)[:, :5].tolist()) for v in own}


def test_near_ties_are_decided_by_the_exact_similarity(spark, monkeypatch):
    """Rows whose cosines differ by 1e-13 and less: the larger one is found, not the smaller id."""
    monkeypatch.setattr(N, "LEAF_POINTS", 4)
    rng = np.random.default_rng(2)
    # angles so small apart that cosines at 45 degrees differ by about 7e-14 a step
    angles = np.pi / 4 - 1e-13 * rng.permutation(12)
    rows = [(0, [1.0, 0.0])] + [(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angles, 1)] + [(20, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")

    def cosine(v):
        scaled = np.array([v]) / max(map(abs, v))
        return float((np.array([[1.0, 0.0]]) * scaled).sum(axis=1)[0] / np.sqrt((scaled * scaled).sum(axis=1))[0])

    want = sorted(((-cosine(v), i) for i, v in rows if i))[:5]
    assert want[0][0] != want[4][0] and abs(want[0][0] - want[4][0]) < 1e-12
    assert [(-r.score, r.vec_id) for r in nearest(frame).orderBy("rank").collect()] == want
