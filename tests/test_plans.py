"""Physical plans: what is read, and what is never built."""

import pytest

from checks.queries import Tables, customer_orders_events, orders_customer_lineitem
from grainwise import Join
from grainwise.plans.forest import Forest
from grainwise.plans.storage import Shelf


def text(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture
def tables(spark, small):
    return Tables(spark, small)


def count_plan(chain, spark, step):
    forest = Forest(chain.bind(), Shelf(spark))
    for i in range(step):
        forest.advance(i, forest.measure(i))
    b = forest.chain.joins[step]
    return text(forest.matched_keys(b, forest.left_keys(b), forest.right_keys(b)))


def test_only_keys_are_read(spark, tables):
    plan = count_plan(orders_customer_lineitem(tables), spark, 1)
    reads = {line.split("ReadSchema: ")[1].split("\n")[0] for line in plan.split("FileScan parquet")[1:]}
    assert reads == {"struct<o_orderkey:bigint>", "struct<l_orderkey:bigint>"}


def test_counts_are_partial_before_the_shuffle(spark, tables):
    plan = count_plan(orders_customer_lineitem(tables), spark, 0)
    physical = plan.split("== Physical Plan ==")[1]
    assert physical.count("Exchange hashpartitioning") == 2
    assert physical.count("partial_count") == 2


def test_no_pairs_of_siblings(spark, tables):
    chain = customer_orders_events(tables)
    chain = chain.with_joins([
        *chain.joins, Join(tables.lineitem, "l", "left", on=[("o.o_orderkey", "l_orderkey")]),
        Join(tables.documents, "d", "left", on=[("e.event_id", "doc_id")])])
    for step in (2, 3):
        physical = count_plan(chain, spark, step).split("== Physical Plan ==")[1]
        assert "NestedLoop" not in physical and "CartesianProduct" not in physical


def test_neutral_join_leaves_no_trace(spark, tables):
    """orders to customer matches every order once: the next step reads orders alone."""
    forest = Forest(orders_customer_lineitem(tables).bind(), Shelf(spark))
    forest.advance(0, forest.measure(0))
    assert "c_custkey" not in text(forest.parts[0].root.df)
