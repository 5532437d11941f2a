import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from grainwise.llm import decontaminate, queries, simhash, toxicity

FOLDER = "/root/testdata/sf0.01"


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    tidy = [tuple(round(r[n], 6) if isinstance(r[n], float) else r[n] for n in order) for r in rows]
    return sorted(columns), sorted(tidy, key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    cur = con.execute(queries.ORACLES[name])
    want = table([d[0] for d in cur.description], cur.fetchall())
    df = queries.QUERIES[name](spark, FOLDER)
    assert table(df.columns, [tuple(r) for r in df.collect()]) == want


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_stages_do_what_they_say(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES:
        before, docs = docs, P.keep(stage(spark, docs, small))
        kept[name] = docs
        if name == "toxicity":
            model = toxicity.learn(before, spark.read.parquet(f"{small}/labels.parquet"))
            clean = {r.doc_id for r in before.collect() if model.score(r.text.encode()) < 0.5}
            assert {r.doc_id for r in docs.collect()} == clean
        elif name == "simhash_near_dedup":
            groups = simhash.near_duplicates(before).groupBy("component_id").count().count()
            assert docs.count() == groups < before.count()
        elif name == "benchmark_decontamination":
            index = [decontaminate.normalised(r.text.encode()) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
            left = [decontaminate.normalised(r.text.encode()) for r in docs.collect()]
            assert not any(p in t for p in index for t in left) and docs.count() < before.count()
        elif name == "mixing":
            assert {tuple(r) for r in docs.collect()} <= {tuple(r) for r in before.collect()}
        if name != "sharding":
            assert docs.columns == before.columns
    rows = kept["sharding"].collect()
    assert len(rows) == kept["mixing"].count() and {r.shard for r in rows} <= set(range(16))
    again = P.run(spark, small)
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))


def test_stages_take_odd_tables(spark, small, docs_of):
    odd = docs_of([(None, None, None), (1, "", "a"), (1, "", "a"), (2, "word " * 3000, "a"), (3, "a b c", None)]).withColumn("copies", F.lit("x"))
    for docs in (odd, odd.limit(0)):
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, docs, small)
            assert out.columns == docs.columns
            out.collect()
        assert P.STAGES[-1][1](spark, docs, small).count() == docs.count()
