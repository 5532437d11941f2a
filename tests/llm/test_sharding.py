from collections import defaultdict

from pyspark.sql import functions as F

from grainwise.llm.sharding import shard_rows


def jump(key, shards):
    """The published loop, in exact integers."""
    state, b, j = key % 2**64, -1, 0
    while j < shards:
        b = j
        state = (state * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((state >> 33) + 1)))
    return b


def check_slots(rows):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_follow_the_published_loop(small_docs):
    rows = shard_rows(small_docs, "doc_id", 16).collect()
    assert len(rows) == small_docs.count()
    for r in rows:
        assert (r.shard, r.grown_shard) == (jump(r.doc_id, 16), jump(r.doc_id, 17))
        assert r.grown_shard in (r.shard, 16)
    check_slots(rows)


def test_slots_are_gapless_over_several_buckets(spark, monkeypatch):
    from grainwise.llm import sharding

    monkeypatch.setattr(sharding, "SLOT_ROWS", 20)
    rows = shard_rows(spark.range(-500, 500).withColumnRenamed("id", "doc_id"), "doc_id", 3).collect()
    check_slots(rows)
    assert {r.shard for r in rows} == {jump(i, 3) for i in range(-500, 500)}


def test_nulls_repeats_clashing_columns_and_empty_tables(spark, docs_of):
    docs = docs_of([(None, "a"), (None, None), (7, ""), (7, ""), (7, "x")]).withColumn("slot", F.lit("old")).withColumn("_x", F.lit(1))
    rows = shard_rows(docs, "doc_id", 4).collect()
    assert len(rows) == 5
    check_slots(rows)
    assert {r.shard for r in rows if r.doc_id is None} == {jump(0, 4)}
    assert len({r.shard for r in rows if r.doc_id == 7}) == 1
    assert shard_rows(docs.limit(0)).count() == 0


def test_text_keys(docs_of):
    rows = shard_rows(docs_of([(i, "t", f"s{i % 5}") for i in range(40)]), "source", 8).collect()
    shards = defaultdict(set)
    for r in rows:
        shards[r.source].add(r.shard)
    assert all(len(s) == 1 for s in shards.values())
    check_slots(rows)


def test_same_rows_on_reruns(small_docs):
    first = shard_rows(small_docs.select("doc_id", "source")).collect()
    again = shard_rows(small_docs.select("doc_id", "source").repartition(3)).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))
