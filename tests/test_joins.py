"""Every join kind against the joined rows themselves."""

import pytest
from pyspark.sql import functions as F

from grainwise import Agg, AuditError, Join, JoinChain, audit, rewrite_chain
from grainwise.plans.forest import Forest
from grainwise.plans.spec import quoted
from grainwise.plans.storage import Shelf

A = [(1, 10, 1.0), (1, 11, 2.0), (2, 10, 3.0), (3, None, 4.0), (None, 12, 5.0), (None, None, None)]
B = [(1, "x"), (1, "y"), (1, "y"), (2, "z"), (None, "n"), (9, "u"), (9, "u")]
C = [(10, 1), (10, 2), (11, 3), (None, 4), (99, 5)]


@pytest.fixture(scope="module")
def abc(spark):
    return (spark.createDataFrame(A, "k int, j int, v double"), spark.createDataFrame(B, "k bigint, s string"),
            spark.createDataFrame(C, "j int, n int"))


def check(chain, fixes=False):
    """Every step count, and with ``fixes`` every verified rewrite, against the joined rows."""
    r = audit(chain, fixes=fixes, exact_duplicates=fixes)
    assert r.driving_rows == chain.driving.count()
    for s in r.step_list:
        assert s.rows_after == chain.to_df(s.index + 1).count(), s.bound.on_sql
        for f in s.fixes:
            if f.verified_rows is not None:
                upto = s.index if f.kind == "drop" else s.index + 1
                cut = rewrite_chain(chain, s.index, f.kind, f.column)
                assert cut.to_df(upto).count() == f.verified_rows, f.kind
    return r


HOWS = ["inner", "left", "right", "full", "semi", "anti"]


@pytest.mark.parametrize("how", HOWS)
def test_equality(abc, how):
    a, b, c = abc
    check(JoinChain(a, "a", [Join(b, "b", how, on=[("a.k", "k")]), Join(c, "c", "left", on=[("a.j", "j")])],
                    select=["a.v"]), fixes=True)


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_second_join_on_the_first_right_side(abc, spark, how):
    a, b, c = abc
    d = spark.createDataFrame([("y", 1), ("y", 2), ("u", 3), (None, 4)], "s string, m int")
    check(JoinChain(a, "a", [Join(b, "b", how, on=[("a.k", "k")]), Join(d, "d", "left", on=[("b.s", "s")]),
                             Join(c, "c", how, on=[("a.j", "j")])]))


@pytest.mark.parametrize("how", HOWS)
def test_condition_on_the_right_side(abc, how):
    a, b, c = abc
    check(JoinChain(a, "a", [Join(b, "b", how, on=[("a.k", "k")], residual="b.s <> 'y'"),
                             Join(c, "c", on=[("a.j", "j")])], select=["c.n"]), fixes=True)


@pytest.mark.parametrize("how", HOWS)
@pytest.mark.parametrize("ops", [("<", "<="), (">", ">=")])
def test_comparison_of_both_sides(abc, how, ops):
    a, _, c = abc
    for op in ops:
        check(JoinChain(a, "a", [Join(c, "c", how, on=[("a.j", "j")], residual=f"a.v {op} c.n")]))


@pytest.mark.parametrize("how", HOWS)
def test_comparison_without_key(abc, how):
    a, _, c = abc
    check(JoinChain(a, "a", [Join(c, "c", how, residual="c.n < a.v"),
                             Join(c, "d", "left", on=[("a.j", "j")])]))


@pytest.mark.parametrize("how", HOWS)
def test_or_condition(abc, how):
    a, b, c = abc
    r = check(JoinChain(a, "a", [Join(c, "c", how, residual="a.j = c.j OR a.k = c.n"),
                                 Join(b, "b", "left", on=[("a.k", "k")])]))
    assert r.step_list[0].cause == "not_equality" and not r.step_list[0].bound.equi


@pytest.mark.parametrize("how", HOWS)
def test_using_repeatedly(abc, spark, how):
    a, b, _ = abc
    a = a.drop("j")
    d = spark.createDataFrame([(1, True), (9, False), (9, True), (None, False)], "k int, f boolean")
    chain = JoinChain(a, "a", [Join(b, "b", how, using=["k"]), Join(d, "d", "left", using=["k"])])
    r = check(chain)
    assert r.step_list[0].bound.on_sql == "USING (k)"
    assert chain.to_df().columns.count("k") == 1


def test_rows_removed_below_a_left_join_match_nothing(abc, spark):
    a, b, c = abc
    b = b.withColumn("j", F.lit(10))
    gone = spark.createDataFrame([("x",), ("y",), ("z",)], "s string")
    check(JoinChain(a, "a", [Join(b, "b", "left", on=[("a.k", "k")]), Join(gone, "g", "anti", on=[("b.s", "s")]),
                             Join(c, "c", "cross"),
                             Join(b, "e", "right", on=[("a.j", "j"), ("b.k", "k")],
                                  residual="e.s = 'y' OR c.n = e.j")]))


def test_natural(abc, spark):
    a, b, _ = abc
    r = check(JoinChain(a, "a", [Join(b, "b", natural=True)]))
    s = r.step_list[0]
    assert s.cause == "natural" and s.cardinality == "unknown" and r.key_stats.count() == 0
    nothing_shared = spark.createDataFrame([(1,), (2,)], "other int")
    check(JoinChain(a, "a", [Join(nothing_shared, "n", natural=True)]))


def test_cross_and_empty(abc, spark):
    a, b, c = abc
    empty = b.where("false")
    check(JoinChain(a, "a", [Join(b, "b", "cross"), Join(c, "c", on=[("a.j", "j")])]))
    check(JoinChain(a, "a", [Join(b, "b", "cross"), Join(a, "d", on=[("b.k", "k")])]))
    r = check(JoinChain(empty, "e", [Join(b, "b", "cross"), Join(c, "c", "full", on=[("e.k", "j")])]))
    assert r.step_list[0].factor is None and not r.step_list[0].fanout
    r = check(JoinChain(a, "a", [Join(empty, "e", on=[("a.k", "k")]), Join(b, "b", on=[("a.k", "k")])]))
    assert r.step_list[1].rows_before == 0 and r.step_list[1].factor is None


def test_several_keys(abc, spark):
    a, _, _ = abc
    d = spark.createDataFrame([(1, 10), (1, 10), (3, None), (None, None)], "k bigint, j bigint")
    r = check(JoinChain(a, "a", [Join(d, "d", "left", on=[("a.k", "k"), ("a.j", "j")])]))
    c = r.step_list[0].counts
    assert (c.n_keys, c.max_dup, c.null_rows) == (3, 2, 2)


def test_keys_from_two_inputs(abc, spark):
    a, b, _ = abc
    d = spark.createDataFrame([(10, "y"), (10, "y"), (11, "x")], "j int, s string")
    check(JoinChain(a, "a", [Join(b, "b", "left", on=[("a.k", "k")]),
                             Join(d, "d", "left", on=[("a.j", "j"), ("b.s", "s")])]))


def test_null_keys_do_not_count_as_repeated(spark):
    left = spark.createDataFrame([(1,), (2,), (None,), (None,)], "k int")
    right = spark.createDataFrame([(1,), (2,), (None,), (None,), (None,)], "k int")
    s = audit(JoinChain(left, "l", [Join(right, "r", on=[("l.k", "k")])])).step_list[0]
    assert s.cardinality == "one-to-one" and not s.fanout
    assert (s.counts.max_dup, s.counts.max_dup_non_null, s.counts.null_rows) == (3, 1, 3)
    assert s.counts.left_max_dup == 2 and s.counts.left_max_dup_non_null == 1


def siblings(spark, n=40):
    """Two inputs hang off the same hot key and are both read later."""
    base = spark.range(6).select((F.col("id") % 2).alias("k"))
    left = spark.range(n).select(F.lit(0).alias("k"), F.col("id").alias("p"))
    right = spark.range(n).select((F.col("id") % 3).alias("k"), F.col("id").alias("q"))
    lx = spark.range(n * 2).select((F.col("id") % 7).alias("p"))
    rx = spark.range(n).select((F.col("id") % 5).alias("q"))
    return base, left, right, lx, rx


@pytest.mark.parametrize("how, hot_floor", [("inner", 1), ("left", 1), ("left", 1_000_000), ("full", 1)])
def test_siblings_are_not_paired(spark, how, hot_floor):
    base, left, right, lx, rx = siblings(spark)
    chain = JoinChain(base, "b", [
        Join(left, "l", "left", on=[("b.k", "k")]), Join(right, "r", "left", on=[("b.k", "k")]),
        Join(lx, "x", how, on=[("l.p", "p")]), Join(rx, "y", "left", on=[("r.q", "q")])],
        aggs=[Agg("sum", "b.k")])
    r = audit(chain, fixes=False, hot_floor=hot_floor)
    for s in r.step_list:
        assert s.rows_after == chain.to_df(s.index + 1).count()
    want = chain.to_df().agg(F.sum("k")).first()[0]
    assert r.risk_list[0].joined_value == want
    # after the second join both inputs are held side by side, with one row per value
    bound = chain.bind()
    forest = Forest(bound, Shelf(spark), hot_floor=hot_floor)
    for i in range(2):
        forest.advance(i, forest.measure(i))
    sizes = [n.df.count() for n in forest.parts[0].nodes()]
    assert len(sizes) == 2 and sum(sizes) <= 2 * 40 + 6


def test_join_over_both_siblings(spark):
    base, left, right, _, _ = siblings(spark, 6)
    both = spark.createDataFrame([(1, 1), (1, 1), (2, 5), (None, 3)], "p bigint, q bigint")
    chain = JoinChain(base, "b", [
        Join(left, "l", "left", on=[("b.k", "k")]), Join(right, "r", "left", on=[("b.k", "k")]),
        Join(both, "x", "left", on=[("l.p", "p"), ("r.q", "q")]),
        Join(both, "y", "right", on=[("x.p", "p")])])
    check(chain)


@pytest.mark.parametrize("how, first, second, read, floor", [
    ("inner", "left", "left", True, 1), ("left", "left", "inner", True, 10_000), ("left", "left", "left", False, 1),
    ("right", "inner", "left", False, 10_000), ("full", "left", "left", True, 1), ("semi", "left", "left", False, 10_000),
    ("anti", "left", "left", False, 1)])
def test_keys_from_two_siblings(spark, how, first, second, read, floor, monkeypatch):
    """Nothing is flattened; counts, sums and the most repeated key tuple are those of the rows."""
    monkeypatch.setattr(Forest, "_flatten", None)

    def table(rows, names):
        return spark.createDataFrame(rows, ", ".join(f"{n} bigint" for n in names.split())).coalesce(1)

    base = table([(i % 3 if i % 5 else None, i) for i in range(7)], "k z")
    left = table([(i % 2, i % 4) for i in range(12)] + [(None, 1), (1, None)], "k p")
    right = table([(i % 3, i % 5) for i in range(14)] + [(0, None)], "k q")
    both = table([(1, 1, 1), (1, 1, 2), (2, 3, 3), (2, 3, 3), (None, 3, 4), (3, 4, 5), (9, 9, 6)], "p q w")
    few = table([(i % 6,) for i in range(9)], "w")
    chain = JoinChain(base, "b", [
        Join(left, "l", first, on=[("b.k", "k")]), Join(right, "r", second, on=[("b.k", "k")]),
        Join(both, "x", how, on=[("l.p", "p"), ("r.q", "q")]), Join(few, "y", "left", on=[("x.w" if read else "b.z", "w")]),
        Join(few, "u", "anti", on=[("r.q", "w")])], select=["b.z"], aggs=[Agg("sum", "b.z")])
    r = audit(chain, fixes=False, exact_duplicates=False, hot_floor=floor)
    assert [s.rows_after for s in r.step_list] == [chain.to_df(n).count() for n in range(1, 6)]
    sizes = chain.to_df(2).groupBy("p", "q").count()
    c = r.step_list[2].counts
    assert (c.left_max_dup, c.left_max_dup_non_null) == (
        sizes.agg(F.max("count")).first()[0], sizes.dropna().agg(F.max("count")).first()[0])
    assert not r.risk_list or (r.risk_list[0].joined_value or 0) == (chain.to_df().agg(F.sum("z")).first()[0] or 0)


def test_siblings_met_by_few_rows_form_few_tuples(spark):
    """300 rows beside 300 of one key, and five rows that match."""
    base = spark.createDataFrame([(1, 1)], "k bigint, z bigint")
    side = spark.range(300).select(F.lit(1).alias("k"), F.col("id").alias("p"))
    both = spark.range(5).select(F.col("id").alias("p"), (F.col("id") * 2).alias("q"), "id")
    later = spark.range(3)
    for how, want in (("inner", 5), ("left", 90_000)):
        bound = JoinChain(base, "b", [
            Join(side, "l", on=[("b.k", "k")]), Join(side, "r", on=[("b.k", "k")]),
            Join(both, "x", how, on=[("l.p", "p"), ("r.p", "q")]), Join(later, "y", "left", on=[("x.id", "id")])]).bind()
        forest = Forest(bound, Shelf(spark))
        for i in range(3):
            forest.advance(i, forest.measure(i))
        assert forest.rows == want and forest.measure(3).rows_after == want
        assert sum(n.df.count() for part in forest.parts for n in part.nodes()) <= 2 * 300 + 1 + 2 * 5


def test_huge_counts_are_exact(spark):
    """Counts beyond 64 bits: rows that stand for others are never built."""
    one = spark.range(100_000).select(F.lit(1).alias("k"))
    chain = JoinChain(one, "a", [Join(one, f"j{n}", on=[("a.k", "k")]) for n in range(4)])
    r = audit(chain, fixes=False, exact_duplicates=False)
    assert r.final_rows == 100_000 ** 5
    rows = r.steps.collect()
    assert int(rows[-1]["rows_after"]) == 10 ** 25 and int(rows[0]["rows_after"]) == 10 ** 10
    assert dict(r.steps.dtypes)["rows_after"] == "decimal(38,0)"
    assert int(r.sections.first()["final_rows"]) == 10 ** 25


def test_salting_keeps_the_counts(spark):
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"),
                                   (F.col("id") % 50).alias("p"), F.col("id").alias("q"))
    dim = spark.range(500).select((F.col("id") % 100).alias("k"))
    many = spark.range(2000).select((F.col("id") % 2).alias("k"), F.col("id").alias("r"))
    for how in ("left", "right"):
        chain = JoinChain(big, "a", [
            Join(dim, "d", how, on=[("a.k", "k")]), Join(dim, "e", "left", on=[("a.p", "k")]),
            Join(many, "m", how, on=[("a.q", "k")]), Join(dim, "f", "left", on=[("m.r", "k")])])
        plain = [s.rows_after for s in audit(chain, fixes=False).step_list]
        salted = [s.rows_after for s in audit(chain, fixes=False, hot_floor=1).step_list]
        assert plain == salted == [chain.to_df(n).count() for n in (1, 2, 3, 4)]


def test_written_state(abc, tmp_path, monkeypatch):
    """With a checkpoint folder, states are written there, counts stay the same, and nothing is left."""
    a, b, c = abc
    chain = JoinChain(a, "a", [Join(b, "b", "left", on=[("a.k", "k")]), Join(c, "c", "full", on=[("a.j", "j")]),
                               Join(b, "d", "left", on=[("c.n", "k")])], aggs=[Agg("sum", "a.v")])
    monkeypatch.setattr("grainwise.plans.storage.checkpoint_folder", lambda spark: str(tmp_path))
    written = []
    keep = Shelf.keep
    monkeypatch.setattr(Shelf, "keep", lambda shelf, df: (kept := keep(shelf, df), written.extend(kept.inputFiles()))[0])
    r = audit(chain)
    assert written and all(str(tmp_path) in path for path in written) and not list(tmp_path.iterdir())
    assert [s.rows_after for s in r.step_list] == [chain.to_df(n).count() for n in (1, 2, 3)]
    assert r.risk_list[0].joined_value == chain.to_df().agg(F.sum("v")).first()[0]


def test_local_folders_are_refused_on_a_cluster():
    from types import SimpleNamespace

    from grainwise.plans.storage import checkpoint_folder

    def session(master, folder):
        return SimpleNamespace(conf={"spark.checkpoint.dir": folder}, sparkContext=SimpleNamespace(master=master))

    assert checkpoint_folder(session("local[4]", "file:///tmp/x")) == "file:///tmp/x"
    assert checkpoint_folder(session("yarn", "hdfs:///x")) == "hdfs:///x"
    with pytest.raises(AuditError, match="do not share"):
        checkpoint_folder(session("yarn", "file:///tmp/x"))


def test_bare_paths_follow_the_default_file_system(spark):
    from types import SimpleNamespace

    from grainwise.plans.storage import checkpoint_folder, new_folder

    def session(folder, default, **conf):
        hadoop = SimpleNamespace(get=lambda key, other: default or other)
        context = SimpleNamespace(master="yarn", _jsc=SimpleNamespace(hadoopConfiguration=lambda: hadoop))
        return SimpleNamespace(conf={"spark.checkpoint.dir": folder, **conf}, sparkContext=context)

    assert checkpoint_folder(session("/shared/x", "hdfs://name:8020")) == "/shared/x"
    for default in ("file:///", None):
        with pytest.raises(AuditError, match="do not share"):
            checkpoint_folder(session("/tmp/x", default))
    with pytest.raises(AuditError, match="warehouse.dir"):
        new_folder(session(None, "hdfs://name", **{"spark.sql.warehouse.dir": "file:/home/me/spark-warehouse"}))
    assert new_folder(spark) != new_folder(spark)


@pytest.fixture()
def cluster(spark, monkeypatch):
    """The session as under a cluster's master, with a checkpoint folder to be named."""
    def named(folder):
        spark.conf.set("spark.checkpoint.dir", folder)
        return spark

    spark.conf.set("spark.sql.legacy.setCommandRejectsSparkCoreConfs", "false")
    monkeypatch.setattr(spark.sparkContext, "master", "spark://name:7077")
    monkeypatch.setattr("grainwise.plans.storage._TRIED", set(), raising=False)
    yield named
    spark.conf.unset("spark.checkpoint.dir")
    spark.conf.unset("spark.sql.legacy.setCommandRejectsSparkCoreConfs")


@pytest.mark.parametrize("scheme", ["file://", ""])
def test_mounts_that_executors_share_are_taken(cluster, abc, tmp_path, scheme):
    """A folder of scheme file is no folder of one machine if the driver finds what executors write."""
    from grainwise.plans.storage import checkpoint_folder, new_folder

    folder = f"{scheme}{tmp_path}"
    spark = cluster(folder)
    assert checkpoint_folder(spark) == folder and new_folder(spark).startswith(f"{folder}/")
    a, b, _ = abc
    chain = JoinChain(a, "a", [Join(b, "b", "left", on=[("a.k", "k")])])
    assert audit(chain).step_list[0].rows_after == chain.to_df().count()
    assert not list(tmp_path.iterdir())


def test_audits_need_no_shared_folder(cluster, abc, tmp_path):
    """States are persisted where the named folder cannot be written; tables that others read are refused."""
    from grainwise.plans.storage import new_folder

    (tmp_path / "file").touch()
    spark = cluster(f"file://{tmp_path}/file/under")
    a, b, c = abc
    chain = JoinChain(a, "a", [Join(b, "b", "left", on=[("a.k", "k")]), Join(c, "c", "full", on=[("a.j", "j")])])
    with pytest.warns(UserWarning, match="persisted"):
        assert [s.rows_after for s in audit(chain).step_list] == [chain.to_df(n).count() for n in (1, 2)]
    with pytest.raises(AuditError, match="do not share"):
        new_folder(spark)


def test_rows_that_stay_with_executors_are_noticed(cluster, spark, tmp_path, monkeypatch):
    """What executors wrote to disks of their own is not found by the driver."""
    from grainwise.plans.storage import checkpoint_folder

    made = spark.range
    monkeypatch.setattr(type(spark), "range", lambda _, start, end, step, tasks: made(start, end - 1, step, tasks))
    with pytest.raises(AuditError, match="do not share"):
        checkpoint_folder(cluster(f"file://{tmp_path}"))
    assert not list(tmp_path.iterdir())


def test_names(abc):
    a, b, c = abc
    with pytest.raises(AuditError, match="twice"):
        JoinChain(a, "a", [Join(b, "A", on=[("a.k", "k")])]).bind()
    with pytest.raises(AuditError, match="known alias"):
        JoinChain(a, "a", [Join(b, "b", on=[("k", "k")])]).bind()
    with pytest.raises(AuditError, match="not visible"):
        JoinChain(a, "a", [Join(b, "b", on=[("c.j", "k")]), Join(c, "c", on=[("a.j", "j")])]).bind()
    with pytest.raises(AuditError, match="not visible"):
        JoinChain(a, "a", [Join(b, "b", "semi", on=[("a.k", "k")]), Join(c, "c", on=[("b.k", "j")])]).bind()
    with pytest.raises(AuditError, match="ambiguous"):
        JoinChain(a, "a", [Join(b, "b", on=[("a.k", "k")]), Join(b, "d", using=["k"])]).bind()
    with pytest.raises(AuditError, match="Unknown join type"):
        JoinChain(a, "a", [Join(b, "b", "sideways", on=[("a.k", "k")])]).bind()
    check(JoinChain(a, "A", [Join(b, "b", on=[("a.K", "B.K")], residual="B.S = 'y'")]))


def test_odd_column_names(spark):
    left = spark.createDataFrame([(1, 2), (1, 3)], ["order id", "x.y"])
    right = spark.createDataFrame([(1, "a"), (1, "b")], ["order id", "t`q"])
    chain = JoinChain(left, "l", [Join(right, "r", on=[("l.order id", "order id")])], select=["l.order id"])
    r = audit(chain)
    assert r.final_rows == 4 == chain.to_df().count()
    assert chain.to_df().columns == ["order id", "x.y", "order id_1", "t`q"]
    assert r.worst_key_rows(1).select(quoted("t`q")).count() == 4


MIXED = {
    "int and text": ([(1, 1), (2, 1), (2, 2)], "k int, x int", [("1", "a"), ("01", "b"), ("2", "c"), (None, "d")], "k string, s string"),
    "double and bigint": ([(float(2**53), 1), (1.5, 2)], "k double, x int", [(2**53, "a"), (2**53 + 1, "b"), (7, "c")], "k bigint, s string"),
    "text and date": ([("2024-01-05", 1), ("2024-1-5", 1), (None, 2)], "k string, x int", [(1, "a"), (1, "b")], "k int, s string"),
}


@pytest.mark.parametrize("how", HOWS)
@pytest.mark.parametrize("case", MIXED)
def test_keys_of_different_types(spark, how, case):
    rows, left, others, right = MIXED[case]
    a, b = spark.createDataFrame(rows, left), spark.createDataFrame(others, right)
    if case == "text and date":
        b = b.select(F.expr("date'2024-01-05'").alias("k"), "s")
    c = spark.createDataFrame([(1, 1), (1, 2), (3, 3)], "x int, n int")
    check(JoinChain(a, "a", [Join(b, "b", how, on=[("a.k", "k")]), Join(c, "c", "left", on=[("a.x", "x")])], select=["a.x"]), fixes=True)
    check(JoinChain(b, "b", [Join(a, "a", how, on=[("b.k", "k")], residual="a.x < 2")]))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_alternatives_of_different_types(spark, how):
    a = spark.createDataFrame([(1, 5), (2, 6)], "id int, x int")
    b = spark.createDataFrame([("1", 5), ("01", 6), ("9", 6)], "sid string, y bigint")
    check(JoinChain(a, "a", [Join(b, "b", how, residual="a.id = b.sid OR a.x = b.y")]))


CONDITIONS = ["a.k = b.k OR a.j = b.m OR a.k = b.m OR a.j = b.k OR a.k = b.n", "a.k = b.k OR a.j = b.m", "a.k <= b.m", "a.k >= b.k AND a.k < b.m",
              "a.k BETWEEN b.k AND b.m AND a.j > b.n"]


@pytest.mark.parametrize("how", HOWS)
@pytest.mark.parametrize("condition", CONDITIONS)
def test_conditions_on_both_sides_without_keys(spark, how, condition):
    a = spark.createDataFrame([(i % 7, i % 4 if i % 5 else None) for i in range(40)], "k int, j int")
    b = spark.createDataFrame([(i % 5 if i % 6 else None, i % 9, i % 3) for i in range(25)], "k int, m bigint, n int")
    c = spark.createDataFrame([(i % 3,) for i in range(7)], "n int")
    later = [Join(c, "c", "left", on=[("a.k" if how in ("semi", "anti") else "b.n", "n")])]
    check(JoinChain(a, "a", [Join(b, "b", how, residual=condition), *later]))


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "left_semi", "left_anti"])
def test_no_nested_loops(spark, how):
    from grainwise.plans.pairs import Bounds, join_any, join_ranges
    from grainwise.plans.spec import Ref

    a = spark.range(50).select(F.struct(F.col("id").alias("k"), (F.col("id") % 7).alias("j")).alias("a"))
    b = spark.range(60).select(F.struct(F.col("id").alias("k"), (F.col("id") + 5).alias("m")).alias("b"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ranged = join_ranges(a, b, Bounds(Ref("a", "k"), ["k"], ["m"], "bigint"), "b", F.expr("a.k >= b.k AND a.k < b.m"), how, 8)
        either = join_any(a, b, [F.expr("a.k = b.k"), F.expr("a.j = b.m")], how)
        for df, on in ((ranged, "a.k >= b.k AND a.k < b.m"), (either, "a.k = b.k OR a.j = b.m")):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "NestedLoop" not in plan
            assert df.count() == a.join(F.broadcast(b), F.expr(on), how).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("how, op, keyed, floor", [
    ("inner", "<=", False, 1), ("left", ">=", False, 1), ("left", "<", True, 10_000), ("right", ">", False, 10_000),
    ("right", "<=", True, 1), ("full", "<", False, 1), ("full", ">=", True, 10_000), ("inner", ">", True, 1)])
def test_range_then_only_the_right_side_forms_no_pairs(spark, how, op, keyed, floor, monkeypatch):
    """Later joins read the right side alone; some keys, values and measures are NULL."""
    monkeypatch.setattr("grainwise.plans.forest.Forest._measure_real", None)
    a = spark.createDataFrame([(i % 3 if i % 8 else None, i % 11 if i % 7 else None, i if i % 4 else None,
                                i / 4) for i in range(50)], "k int, v int, m int, d double")
    b = spark.createDataFrame([(i % 4 if i % 9 else None, i % 13 if i % 5 else None, i % 6 if i % 7 else None)
                               for i in range(40)], "k int, w bigint, n int")
    few = spark.createDataFrame([(i % 5,) for i in range(8)], "n int")
    chain = JoinChain(a.coalesce(1), "a", [
        Join(b.coalesce(1), "b", how, on=[("a.k", "k")] if keyed else [], residual=f"b.w {op} a.v"),
        Join(few, "c", "inner" if how == "left" else "left", on=[("b.n", "n")])],
        select=["a.v"], aggs=[Agg("sum", "a.m"), Agg("count", "a.m"), Agg("sum", "a.d")])
    r = audit(chain, fixes=False, exact_duplicates=False, hot_floor=floor)
    assert [s.rows_after for s in r.step_list] == [chain.to_df(n).count() for n in (1, 2)]
    joined = chain.to_df().agg(F.sum("m"), F.count("m"), F.sum("d")).first()
    assert [x.joined_value for x in r.risk_list] == [joined[0], joined[1], pytest.approx(joined[2])]


@pytest.mark.parametrize("op", ["<", "<=", ">", ">="])
def test_sums_of_found_rows_keep_their_digits(spark, op):
    """A large number beside small ones is not taken off again where it was never counted."""
    from grainwise.plans.ranges import range_matches

    values = [(1, 0.5), (2, 1e20), (4, None), (5, 0.25), (7, 1e20), (8, 2.0)]
    left = spark.createDataFrame(values, "v bigint, s double").select("v", F.lit(1).alias("lw"), F.lit(1).alias("lt"), "s")
    right = spark.range(10).select(F.col("id").alias("v"), F.lit(1).alias("rw"))
    for r in range_matches(left, right, [], op, ["s"], 3, True).where("rw > 0").collect():
        met = [s for v, s in values if eval(f"{v} {op} {r.v}")]
        assert r.found == len(met)
        assert r.s_found == (sum(s for s in met if s is not None) if any(s is not None for s in met) else None)


def test_copies_for_ranges_are_not_broadcast(spark):
    """Their number is the rows times the ranges they reach, which Spark does not see."""
    from grainwise.plans.pairs import Bounds, join_ranges
    from grainwise.plans.spec import Ref

    a = spark.range(50).select(F.struct(F.col("id").alias("k")).alias("a"), F.lit(1).alias("x"))
    b = spark.range(9).select(F.struct(F.col("id").alias("k")).alias("b"))
    for how in ("inner", "left", "right", "full", "left_semi", "left_anti"):
        df = join_ranges(a, b, Bounds(Ref("a", "k"), ["k"], [], "bigint"), "b", F.expr("a.k >= b.k"), how, 8)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and df.count() == a.join(F.broadcast(b), F.expr("a.k >= b.k"), how).count()


def test_sums_keep_every_digit(spark):
    a = spark.createDataFrame([(1, 2**53 + 1), (1, 2), (2, None)], "k int, v bigint").withColumn("d", F.expr("cast(v as decimal(30,8)) + 0.00000001"))
    b = spark.createDataFrame([(1, i) for i in range(3)], "k int, n int")
    r = audit(JoinChain(a, "a", [Join(b, "b", "left", on=[("a.k", "k")])], aggs=[Agg("sum", "a.v"), Agg("sum", "a.d"), Agg("avg", "a.v")]))
    exact = {x.expression: (x.base_exact, x.joined_exact) for x in r.risk_list}
    assert exact["SUM(a.v)"] == (str(2**53 + 3), str(3 * (2**53 + 3)))
    assert exact["SUM(a.d)"] == (f"{2**53 + 3}.00000002", f"{3 * (2**53 + 3)}.00000006")


@pytest.mark.parametrize("how, low, high, keyed, turned, floor", [
    ("inner", ">=", "<", True, False, 1), ("left", ">", "<=", False, False, 10_000), ("right", ">=", "<=", True, False, 1),
    ("full", ">", "<", False, True, 10_000), ("full", ">=", "<", True, True, 1), ("semi", ">", "<=", True, True, 10_000),
    ("anti", ">=", "<=", False, True, 1), ("anti", ">=", "<", True, False, 10_000)])
def test_intervals_are_counted(spark, how, low, high, keyed, turned, floor, monkeypatch):
    """A value within bounds of the other side, on either side, with and without a key; some
    intervals end before they start, are empty, or miss a bound."""
    monkeypatch.setattr("grainwise.plans.forest.Forest._measure_real", None)
    a = spark.createDataFrame([(i % 3 if i % 8 else None, i % 11 if i % 7 else None) for i in range(50)], "k int, v int")
    b = spark.createDataFrame([(i % 4 if i % 9 else None, i % 6 if i % 5 else None, (i * 7) % 10 if i % 6 else None, i)
                               for i in range(40)], "k int, lo bigint, hi bigint, v int")
    few = spark.createDataFrame([(i % 3,) for i in range(5)], "k int")
    residual = f"a.v {low} b.lo AND b.hi {'>' + high[1:]} a.v"
    if turned:
        a, b, residual = b, a, f"(b.v {low} a.lo) AND b.v {high} a.hi"
    chain = JoinChain(a.coalesce(1), "a", [
        Join(b.coalesce(1), "b", how, on=[("a.k", "k")] if keyed else [], residual=residual),
        Join(few, "c", "left", on=[("a.k", "k")])], select=["a.v"], aggs=[Agg("sum", "a.v")])
    r = audit(chain, fixes=False, exact_duplicates=False, hot_floor=floor)
    assert [s.rows_after for s in r.step_list] == [chain.to_df(n).count() for n in (1, 2)]
    assert not r.risk_list or r.risk_list[0].joined_value == chain.to_df().agg(F.sum("v")).first()[0]


def test_between_dates_is_counted(spark, monkeypatch):
    monkeypatch.setattr("grainwise.plans.forest.Forest._measure_real", None)
    days = spark.range(60).select(F.expr("date'2024-01-01' + cast(id % 40 as int)").alias("d"), "id")
    spans = spark.range(12).select(F.expr("date'2024-01-01' + cast(3 * id as int)").alias("first"),
                                   F.expr("date'2024-01-05' + cast(2 * id as int)").alias("last"))
    check(JoinChain(days, "d", [Join(spans, "s", "full", residual="d.d BETWEEN s.first AND s.last")], select=["d.id"]))


def test_interval_plan_joins_no_pairs(spark):
    """The only joins look sums up by key and value."""
    from grainwise.plans.intervals import interval

    values = spark.range(100).select((F.col("id") % 10).alias("k"), F.col("id").alias("v"))
    spans = spark.range(30).select((F.col("id") % 10).alias("k"), F.col("id").alias("lo"), (F.col("id") + 20).alias("hi"))
    bound = JoinChain(values, "a", [Join(spans, "b", on=[("a.k", "k")], residual="a.v >= b.lo AND a.v < b.hi")]).bind()
    found = interval(bound, bound.joins[0])
    assert found.closed == (True, False) and set(found.left) == {"v"}
    left = values.groupBy(F.col("k").alias("k0"), "v").agg(F.count(F.lit(1)).alias("lw"), F.count(F.lit(1)).alias("lt"))
    right = spans.groupBy(F.col("k").alias("k0"), "lo", "hi").agg(F.count(F.lit(1)).alias("rw"))
    for df in found.matches(left, right, ["k0"], [], 4, lambda df, cols: None):
        plan = df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        joins = [line for line in plan.split("\n") if "Join" in line]
        assert joins and "NestedLoop" not in plan and "Cartesian" not in plan
        assert all("<" not in line and ">" not in line for line in joins)


@pytest.mark.parametrize("residual", ["a.v > b.lo AND b.hi < 8.5", "b.k = a.k OR b.lo = 1.0", "a.v >= b.lo AND 2.5 <= b.hi"])
def test_numbers_are_not_names(spark, residual):
    a = spark.createDataFrame([(i % 3, i % 11) for i in range(20)], "k int, v int").coalesce(1)
    b = spark.createDataFrame([(i % 4, i % 6, i % 10) for i in range(20)], "k int, lo int, hi int").coalesce(1)
    check(JoinChain(a, "a", [Join(b, "b", "left", residual=residual)]))
