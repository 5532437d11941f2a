"""Key profiles, exact copies, top keys, sample rows."""

import random

import pytest
from pyspark.sql import functions as F

from grainwise import Join, JoinChain, audit, exact_duplicates, keep_latest, key_stats, pre_aggregate, top_keys
from grainwise.operators.fixes import grain_columns
from grainwise.operators.rewrites import measure_fn, pick_order_col
from grainwise.operators.samples import worst_key_rows
from grainwise.plans.forest import Forest
from grainwise.plans.prefix import unique_names


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [(1, "a", 1.0), (1, "a", 1.0), (1, "b", 2.0), (2, None, 3.0), (None, "a", 4.0), (None, "a", 4.0),
         (None, None, 5.0)], "k int, s string, v double")


def test_null_is_one_group(rows):
    got = key_stats(rows, ["k"]).first().asDict()
    assert got == {"n_rows": 7, "n_keys": 3, "max_dup": 3, "max_dup_non_null": 3, "dup_keys": 2, "null_rows": 3}
    got = key_stats(rows, ["k", "s"]).first().asDict()
    assert got == {"n_rows": 7, "n_keys": 5, "max_dup": 2, "max_dup_non_null": 2, "dup_keys": 2, "null_rows": 4}


def test_empty_table(rows):
    got = key_stats(rows.where("false"), ["k"]).first().asDict()
    assert set(got.values()) == {0}
    assert exact_duplicates(rows.where("false")).first()[0] == 0
    assert top_keys(rows.where("false"), ["k"]).count() == 0


def test_exact_duplicates(spark, rows):
    assert exact_duplicates(rows).first()[0] == 2
    assert exact_duplicates(rows.distinct()).first()[0] == 0
    # equal to GROUP BY though the bits differ
    zeros = spark.sql("SELECT * FROM VALUES (0.0D), (-0.0D), (double('NaN')), (double('NaN')) t(x)")
    assert exact_duplicates(zeros).first()[0] == 2
    # different rows whose hashes agree
    assert exact_duplicates(spark.sql("SELECT * FROM VALUES (1, NULL), (NULL, 1) t(a, b)")).first()[0] == 0


def test_exact_duplicates_of_maps_and_variants(spark):
    maps = spark.sql("SELECT map('a', id % 2) AS m FROM range(4)")
    assert exact_duplicates(maps).first()[0] == 2
    variants = spark.sql("SELECT parse_json(concat('{\"a\":', id % 2, '}')) AS v FROM range(4)")
    assert exact_duplicates(variants).first()[0] == 2


def test_top_keys(rows):
    assert [(r["k"], r["rows_per_key"]) for r in top_keys(rows, ["k"]).collect()] == [(1, 3), (None, 3)]
    assert top_keys(rows, ["k"], 1).count() == 1


def test_worst_key_rows(rows, spark):
    left = spark.createDataFrame([(1, "p"), (1, "q"), (2, "r"), (None, "s")], "k int, name string")
    chain = JoinChain(left, "l", [Join(rows, "r", "left", on=[("l.k", "k")], residual="r.v < 2")])
    r = audit(chain, fixes=False)
    sample = r.worst_key_rows(1)
    assert sample.columns == ["k", "name", "k_1", "s", "v"]
    assert sorted(x["name"] for x in sample.collect()) == ["p", "p", "q", "q"]
    assert r.worst_key_rows(1, limit=3).count() == 3
    unique = JoinChain(rows, "r", [Join(left.where("k = 2"), "l", on=[("r.k", "k")])])
    assert audit(unique).worst_key_rows(1) is None


def test_worst_key_sample_is_cut_before_the_join(spark):
    many = spark.range(10_000).select(F.lit(1).alias("k"))
    chain = JoinChain(many, "l", [Join(many, "r", on=[("l.k", "k")])])
    assert audit(chain, fixes=False, exact_duplicates=False).worst_key_rows(1).count() == 8


def test_unique_names():
    assert unique_names(["a", "a", "b", "a"]) == ["a", "a_1", "b", "a_2"]
    assert unique_names(["a", "a_1", "a"]) == ["a", "a_1", "a_2"]


def test_order_column_rule():
    assert pick_order_col(["id", "name", "created_at", "updated_at"], ["id"]) == "updated_at"
    assert pick_order_col(["event_id", "ts", "user_id"], ["user_id"]) == "event_id"
    assert pick_order_col(["ID", "valid_ts"], ["id"]) == "valid_ts"
    assert pick_order_col(["id"], ["id"]) is None


def test_keep_latest(rows, spark):
    got = {(r["k"], r["s"], r["v"]) for r in keep_latest(rows, ["k"], "v").collect()}
    assert got == {(1, "b", 2.0), (2, None, 3.0), (None, None, 5.0)}
    ties = spark.createDataFrame([(1, 5, "x"), (1, 5, "y"), (1, None, "z")], "k int, n int, s string")
    assert [tuple(r) for r in keep_latest(ties, ["k"], "n").collect()] == [(1, 5, "y")]
    assert keep_latest(ties.select("k"), ["k"]).count() == 1


def test_keep_latest_of_the_columns_that_are_read(spark):
    rng = random.Random(5)
    some = lambda *values: rng.choice([None, *values])
    rows = spark.createDataFrame(
        [(some(1, 2, 3), some(7, 8), some("x", "y"), some(0.5, float("nan")), some("p", "q"), {"m": rng.randrange(2)}) for _ in range(200)],
        "k int, at int, s string, v double, pad string, m map<string,int>")
    for order in ("at", "v", None, "k"):
        whole = keep_latest(rows.drop("m"), ["k"], order)
        for read in (["s"], ["S", "k"], ["v"], ["at", "pad"], ["at"], []):
            got = keep_latest(rows, ["k"], order, read)
            columns = ["k", *(c for c in whole.columns if c != "k" and c in {r.lower() for r in read})]
            assert "m" not in got.columns and set(columns) <= set(got.columns)
            assert sorted(map(repr, got.select(columns).collect())) == sorted(map(repr, whole.select(columns).collect()))
    assert keep_latest(rows, ["k"], "at", ["s"]).columns == ["k", "at", "s"]
    assert keep_latest(rows, ["k"], "at", ["m"]).columns == rows.columns  # a map has no order, so its row is kept whole


def test_recount_shuffles_what_the_condition_reads(spark, monkeypatch):
    """Whole rows of the repeating table went through the shuffle before."""
    left = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    right = spark.createDataFrame([(1, 1, 5.0, "a"), (1, 1, 9.0, "b"), (1, 0, 99.0, "c"), (2, 3, 1.0, "d"), (2, 2, 50.0, "e")],
                                  "key int, at_date int, v double, pad string")
    seen, recount = [], Forest.recount
    monkeypatch.setattr(Forest, "recount", lambda self, b, df: seen.append(df.columns) or recount(self, b, df))

    def latest(condition, how="inner"):
        chain = JoinChain(left, "l", [Join(right, "r", how, on=[("l.id", "key")], residual=condition)], select=["l.id", "r.v"])
        return {f.kind: f.verified_rows for f in audit(chain).step_list[0].fixes}["keep_latest"], seen.pop()

    assert latest("r.v > 4") == (1, ["key", "at_date", "v"])  # of key 2, the latest row has 1.0
    assert latest("v > 4", "left") == (3, ["key", "at_date", "v"])
    assert latest("r.pad <> 'd'") == (1, ["key", "at_date", "v", "pad"])
    assert latest("r.v * 2 > 4") == (1, ["key", "at_date", "v", "pad"])  # may be a star
    assert not seen


def test_pre_aggregate(rows):
    got = {r["k"]: (r["s"], r["v"], r["_row_count"]) for r in pre_aggregate(rows, ["k"], ["s", "v"]).collect()}
    assert got == {1: ("b", 4.0, 3), 2: (None, 3.0, 1), None: ("a", 13.0, 3)}


def test_measure_functions(spark):
    schema = spark.sql("SELECT 1 AS i, 1.5D AS d, true AS b, 'x' AS s, map('a', 1) AS m, now() AS t").schema
    assert [measure_fn(f.dataType) for f in schema] == ["SUM", "SUM", "MAX", "MAX", "ANY_VALUE", "MAX"]


def test_grain_candidates(spark):
    left = spark.createDataFrame([(1, 1, 1, 1, 1, 1)], "k int, c1 int, c2 int, c3 int, c4 int, c5 int")
    right = spark.range(6).select(F.lit(1).alias("k"), *[F.col("id").alias(f"c{n}") for n in (1, 2, 3, 4)],
                                  (F.col("id") % 2).alias("c5"), F.col("id").alias("own"))
    chain = JoinChain(left, "l", [Join(right, "r", on=[("l.k", "k")])])
    assert grain_columns(chain, 0, 6) == ["c1", "c2", "c3", "c4"]
    one = JoinChain(left.select("k", "c5"), "l", [Join(right, "r", on=[("l.k", "k")])])
    assert grain_columns(one, 0, 6) == []
    later = JoinChain(left.select("k"), "l", [Join(right, "r", on=[("l.k", "k")]),
                                              Join(left, "m", on=[("l.k", "k")])])
    assert grain_columns(later, 0, 6) == []


def test_grain_search_copies_no_rows(spark, monkeypatch):
    """51 shared columns: those that repeat beside the worst keys are refuted at once, and one
    whose repetition lies outside these rows by the pass over the table."""
    from grainwise.operators import fixes

    right = spark.range(400).select((F.col("id") % 20).alias("k"), *[(F.col("id") % (n + 2)).alias(f"c{n}") for n in range(48)],
                                    F.col("id").alias("own"), F.when(F.col("id") % 20 != 3, F.col("id")).alias("gaps"),
                                    F.when(F.col("id") % 20 != 15, F.col("id")).otherwise(0).alias("late"))
    chain = JoinChain(right, "l", [Join(right, "r", on=[("l.k", "k")])])
    passes = []
    unique = fixes._unique
    monkeypatch.setattr(fixes, "_unique", lambda df, columns: passes.append(columns) or unique(df, columns))
    expected = []
    rows = right.collect()
    for c in right.columns[1:]:
        pairs = [(r.k, r[c]) for r in rows]
        if len(set(pairs)) == len(pairs):
            expected.append(c)
    assert grain_columns(chain, 0, 400) == expected and "own" in expected and not {"gaps", "late"} & set(expected)
    assert ["k", "late"] in passes and ["k", "gaps"] not in passes and len(passes) == len(expected) + 1 < 25
    monkeypatch.setattr(fixes, "REFUTING_ROWS", 1)
    passes.clear()
    narrow = JoinChain(right.select("k", "c0", "own", "late"), "l", [Join(right, "r", on=[("l.k", "k")])])
    assert grain_columns(narrow, 0, 400) == ["own"] and len(passes) == 3  # one row refutes nothing
    for columns in passes[:2]:
        plan = right.groupBy(*columns).count()._jdf.queryExecution().executedPlan().toString()
        assert "Expand" not in plan


@pytest.mark.parametrize("residual", [None, "r.v > 3", "l.n < r.v"])
@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "semi", "anti"])
def test_all_rows_of_the_worst_key(spark, how, residual):
    left = spark.createDataFrame([(1, n) for n in range(4)] + [(2, 9), (None, 1)], "k int, n int")
    right = spark.createDataFrame([(1, v) for v in (2, 2, 3, 7, None)] + [(2, 1), (3, 1)], "k int, v int")
    chain = JoinChain(left, "l", [Join(right, "r", how, on=[("l.k", "k")], residual=residual)])
    found = worst_key_rows(chain, 0, limit=None)
    terms = "l.k = r.k" + (f" AND {residual}" if residual else "")
    if residual == "r.v > 3":  # what a condition on the right side refuses is no row of the key
        right = right.where("v > 3")
    word = {"semi": "LEFT SEMI", "anti": "LEFT ANTI"}.get(how, how.upper())
    wanted = spark.sql(f"SELECT * FROM {{l}} l {word} JOIN {{r}} r ON {terms}", l=left.where("k = 1"), r=right.where("k = 1"))
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, map(tuple, wanted.collect())))


@pytest.mark.parametrize("n_left, n_right", [(1, 6000), (3000, 2), (90, 90)])
def test_rows_of_the_worst_key_are_spread(spark, n_left, n_right):
    left = spark.range(0, n_left, 1, 4).select(F.lit(1).alias("k"), F.col("id").alias("n"))
    right = spark.range(0, n_right, 1, 4).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    chain = JoinChain(left, "l", [Join(right, "r", "left", on=[("l.k", "k")])])
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = worst_key_rows(chain, 0, limit=None)
        tasks = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert rows.select("n", "v").distinct().count() == sum(tasks) == n_left * n_right
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(tasks) <= 2 * sum(tasks) / 8


def test_fix_gates(spark, rows):
    left = spark.createDataFrame([(1, "p"), (2, "q")], "k int, name string")

    def kinds(how="inner", **chain):
        j = Join(rows, "r", how, on=[("l.k", "k")])
        return [f.kind for f in audit(JoinChain(left, "l", [j], **chain)).step_list[0].fixes]

    assert kinds(select=["l.name"]) == ["distinct", "exists", "preaggregate", "keep_latest"]
    assert kinds("left", select=["l.name"]) == ["distinct", "drop", "preaggregate", "keep_latest"]
    assert kinds("right", select=["l.name"]) == ["distinct", "preaggregate", "keep_latest"]
    for read in ({"select": ["*"]}, {"select": ["r.*"]}, {"select": ["l.name", "r.v + 1"]}, {}):
        assert kinds(**read) == ["distinct", "preaggregate", "keep_latest"]
    assert "exists" not in kinds(select=["l.name"], uses=["r.s"])
