import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from grainwise.llm import simhash as S


def print_of(text, words=3):
    parts = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(parts[i:i + words]) for i in range(len(parts) - words + 1)] or ([b" ".join(parts)] if parts else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute(rows, bits=3):
    """id -> smallest id reachable."""
    prints = [print_of(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    return [(rows[i][0], f"{prints[i]:016x}", least[group[i]]) for i in range(len(rows))]


def test_documents_against_brute_force(small_docs):
    rows = [(r.doc_id, r.text) for r in small_docs.collect()]
    got = [tuple(r) for r in S.near_duplicates(small_docs).select("doc_id", "fingerprint", "component_id").collect()]
    assert sorted(got) == sorted(brute(rows))
    assert any(i != c for i, _, c in got)


def test_edge_cases(docs_of):
    rows = [(5, None), (3, ""), (9, " \n\t "), (None, "one two"), (4, "One  TWO"), (4, "One  TWO"), (8, "É a b"), (2, "é a b"), (1, "x " * 50)]
    got = sorted((tuple(r) for r in S.near_duplicates(docs_of(rows)).collect()), key=str)
    assert got == sorted(brute(rows), key=str)
    assert S.near_duplicates(docs_of(rows).limit(0)).count() == 0


def test_blocks_give_the_same_fingerprint():
    text = " ".join(random.Random(1).choices(["ab", "cde", "f", "ghij"], k=3000)).encode()
    whole = np.concatenate(list(S.shingle_hashes(text, 3)))
    parts = np.concatenate(list(S.shingle_hashes(text, 3, 64)))
    assert (whole == parts).all()


def chains(seed, n):
    """Fingerprints with chains of near ones and a dense ball."""
    rng = random.Random(seed)
    points = set()
    for _ in range(n):
        p = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 1, 4])):
            points.add(p)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
                p ^= 1 << b
    ball = rng.getrandbits(64)
    points |= {ball ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)}
    return np.array(sorted(points), np.uint64)


def classes(points, bits):
    group = np.arange(len(points))
    for i in range(len(points)):
        near = np.nonzero(np.bitwise_count(points ^ points[i]) <= bits)[0]
        merged = np.isin(group, np.unique(group[near]))
        group[merged] = group[merged].min()
    return group


def same_partition(a, b):
    return len(set(zip(a.tolist(), b.tolist()))) == len(set(a.tolist())) == len(set(b.tolist()))


def test_tree_inside_a_shard_is_exact(monkeypatch):
    monkeypatch.setattr(S, "LEAF_POINTS", 32)
    points = chains(1, 400)
    assert same_partition(S.link(points, 3), classes(points, 3))


def test_shards_meet_every_near_pair(monkeypatch):
    monkeypatch.setattr(S, "SHARD_POINTS", 100)
    points = chains(2, 500)
    tree = S.grow(points[::2], len(points), 3)
    shards = [set(own.tolist()) for _, own in S.route(points, tree, 3)]
    assert len(shards) > 4 and max(map(len, shards)) < len(points)
    for p in points:
        for q in points[np.bitwise_count(points ^ p) <= 3]:
            assert any(int(p) in s and int(q) in s for s in shards)


def test_links_and_components_over_shards(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_POINTS", 150)
    monkeypatch.setattr(S, "LEAF_POINTS", 32)
    points = chains(3, 400)
    frame = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp bigint")
    roots = {r.node: r.root for r in S.components(S.fingerprint_links(frame, 3)).collect()}
    got = np.array([roots.get(int(p), int(p)) for p in points.view(np.int64)])
    assert same_partition(got, classes(points, 3))


def test_components_of_a_long_path(spark):
    nodes = list(range(60))
    random.Random(4).shuffle(nodes)
    links = spark.createDataFrame(list(zip(nodes, nodes[1:])) + [(100, 101)], "a bigint, b bigint")
    assert {r.node: r.root for r in S.components(links).collect()} == {**{n: 0 for n in range(1, 60)}, 101: 100}


def test_one_row_of_each_group_stays(small_docs, docs_of):
    kept = S.first_of_groups(small_docs)
    assert kept.columns == small_docs.columns
    want = {r.doc_id for r in S.near_duplicates(small_docs).where("doc_id = component_id").collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    odd = docs_of([(4, "a b c"), (4, "a b c"), (None, "a b c"), (None, None), (None, None), (6, "q r s t")]).withColumn("fp", F.lit(1))
    kept = S.first_of_groups(odd)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(4, "a b c"), (None, None), (6, "q r s t")], key=str)
    assert S.first_of_groups(odd.limit(0)).count() == 0
