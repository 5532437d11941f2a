"""Which aggregates a fan-out affects."""

import pytest

from grainwise import Agg, Join, JoinChain, audit


@pytest.fixture(scope="module")
def chain(spark):
    a = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, None)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 3.0)], "k int, w double")
    c = spark.createDataFrame([(1, 5.0), (1, 6.0)], "k int, x double")

    def make(*aggs, joins=2):
        return JoinChain(a, "a", [Join(b, "b", "left", on=[("a.k", "k")]),
                                  Join(c, "c", "left", on=[("a.k", "k")])][:joins], aggs=list(aggs))

    return make


def affected(result):
    return {r.expression: r.affected_joins for r in result.risk_list}


def test_rule(chain):
    r = audit(chain(Agg("sum", "a.v"), Agg("sum", "b.w"), Agg("sum", "c.x"), Agg("count"), Agg("sum", "loose"),
                    Agg("max", "a.v"), Agg("min", "a.v"), Agg("any_value", "a.v"),
                    Agg("count", "a.k", distinct=True), Agg("sum", "a.v", distinct=True)), fixes=False)
    assert [s.cardinality for s in r.step_list] == ["one-to-many", "many-to-many"]
    # a joined table's own rows are copied by its own join only if that is many-to-many
    assert affected(r) == {"SUM(a.v)": [1, 2], "SUM(b.w)": [2], "SUM(c.x)": [1, 2], "COUNT(*)": [1, 2],
                           "SUM(loose)": [1, 2]}


def test_values(chain):
    r = audit(chain(Agg("sum", "a.v"), Agg("avg", "a.v"), Agg("count", "a.v"), Agg("count"),
                    Agg("sum", "a.v * 2"), Agg("stddev", "a.v"), Agg("sum", "b.w"),
                    Agg("sum", "a.v + b.w")), fixes=False)
    got = {x.expression: (x.base_value, x.joined_value) for x in r.risk_list}
    # joined rows: key 1 four times, key 2 once, key 3 once
    assert got["SUM(a.v)"] == (30.0, 60.0)
    assert got["AVG(a.v)"] == (15.0, 12.0)
    assert got["COUNT(a.v)"] == (2.0, 5.0)
    assert got["COUNT(*)"] == (3.0, 6.0)
    assert got["SUM(a.v * 2)"] == (60.0, 120.0)
    assert got["STDDEV(a.v)"] == got["SUM(b.w)"] == got["SUM(a.v + b.w)"] == (None, None)
    pct = {x.expression: x.inflation_pct for x in r.risk_list}
    assert pct["SUM(a.v)"] == pytest.approx(100.0) and pct["AVG(a.v)"] == pytest.approx(-20.0)


def test_zero_base_has_no_percentage(spark):
    a = spark.createDataFrame([(1, 1.0), (1, -1.0)], "k int, v double")
    b = spark.createDataFrame([(1,), (1,)], "k int")
    r = audit(JoinChain(a, "a", [Join(b, "b", on=[("a.k", "k")])], aggs=[Agg("sum", "a.v")]), fixes=False)
    assert r.risk_list[0].base_value == 0.0 and r.risk_list[0].inflation_pct is None


def test_values_after_a_right_join(spark, chain):
    """Rows without a driving row add nothing to its sums."""
    full = chain(Agg("sum", "a.v"), Agg("count", "a.v"))
    d = spark.createDataFrame([(1,), (1,), (7,)], "k int")
    for how in ("right", "full"):
        c = full.with_joins([*full.joins, Join(d, "d", how, on=[("a.k", "k")]),
                             Join(d, "e", "left", on=[("d.k", "k")])])
        r = audit(c, fixes=False)
        want = c.to_df().selectExpr("sum(v)", "count(v)").first()
        got = {x.kind: x.joined_value for x in r.risk_list}
        assert (got["sum"], got["count"]) == (want[0], float(want[1]))


def test_text_measure_counts(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, s string")
    b = spark.createDataFrame([(1,), (1,)], "k int")
    r = audit(JoinChain(a, "a", [Join(b, "b", "left", on=[("a.k", "k")])], aggs=[Agg("count", "a.s")]),
              fixes=False)
    assert (r.risk_list[0].base_value, r.risk_list[0].joined_value) == (1.0, 2.0)
