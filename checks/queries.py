"""Audits of the given tables, one per operator; each takes (spark, folder)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainwise import (
    Agg, Join, JoinChain, audit, audit_query, audit_sections, exact_duplicates, keep_latest, key_stats,
    next_month, pre_aggregate, register_functions, rewrite_chain, top_keys)
from grainwise.plans.storage import new_folder
from grainwise.sources import (
    load_folder, query_row_count, register_tables, sample_by_key, sample_chain, sample_coverage, table_chain,
    validate_sample)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(fn: Callable[[Tables], DataFrame]) -> Callable:
    """Registers a query under its function name."""
    QUERIES[fn.__name__] = lambda spark, folder: fn(Tables(spark, folder))
    return fn


def steps(chain: JoinChain, **options) -> DataFrame:
    """The measured columns of the step report."""
    return audit(chain, fixes=False, exact_duplicates=False, **options).steps.select(
        "step", "join_type", "rows_before", "rows_after", F.round("factor", 6).alias("factor"), "fanout",
        "equi", "cardinality", "left_max_dup", "cause")


def fixes(chain: JoinChain) -> DataFrame:
    return audit(chain).fixes.select(
        "step", "rank", "kind", "verified_rows", F.round("verified_factor", 6).alias("verified_factor"),
        "restores_grain")


def risks(chain: JoinChain) -> DataFrame:
    return audit(chain, fixes=False, exact_duplicates=False).agg_risks.select(
        "expression", "kind", F.array_join("affected_joins", ",").alias("affected_joins"),
        F.round("base_value", 2).alias("base_value"), F.round("joined_value", 2).alias("joined_value"),
        F.round("inflation_pct", 3).alias("inflation_pct"))


# -- chains ------------------------------------------------------------------------
def orders_customer_lineitem(t: Tables, **chain) -> JoinChain:
    return JoinChain(t.orders, "o", [
        Join(t.customer, "c", on=[("o.o_custkey", "c_custkey")], name="customer"),
        Join(t.lineitem, "l", "left", on=[("o.o_orderkey", "l_orderkey")], name="lineitem"),
    ], name="orders", **chain)


def customer_orders_events(t: Tables, **chain) -> JoinChain:
    return JoinChain(t.customer, "c", [
        Join(t.orders, "o", "left", on=[("c.c_custkey", "o_custkey")], name="orders"),
        Join(t.events, "e", "left", on=[("c.c_custkey", "user_id")], name="events"),
    ], name="customer", **chain)


def customer_orders(t: Tables, how: str = "left", **chain) -> JoinChain:
    return JoinChain(t.customer, "c", [
        Join(t.orders, "o", how, on=[("c.c_custkey", "o_custkey")], name="orders")],
        name="customer", **chain)


def hot_events(t: Tables) -> DataFrame:
    """Events in which one user holds a third of all rows on top of its own."""
    user = F.when(F.pmod("event_id", F.lit(3)) == 0, 1).otherwise(F.col("user_id"))
    return t.events.withColumn("user_id", user)


# -- measuring ---------------------------------------------------------------------
@query
def steps_two_joins(t):
    return steps(orders_customer_lineitem(t))


@query
def steps_compounding(t):
    return steps(customer_orders_events(t))


@query
def steps_inner(t):
    return steps(JoinChain(t.orders, "o", [Join(t.lineitem, "l", on=[("o.o_orderkey", "l_orderkey")])]))


@query
def steps_clean(t):
    result = audit_sections({
        "nation": JoinChain(t.nation, "n", [Join(t.region, "r", on=[("n.n_regionkey", "r_regionkey")])]),
        "orders": JoinChain(t.orders, "o", [Join(t.customer, "c", on=[("o.o_custkey", "c_custkey")])],
                            aggs=[Agg("sum", "o.o_totalprice")]),
    }, exact_duplicates=False)
    return result.steps.select("section", "rows_before", "rows_after", "fanout", "cardinality", "cause")


@query
def steps_many_to_many(t):
    return steps(JoinChain(t.customer, "c", [Join(t.supplier, "s", on=[("c.c_nationkey", "s_nationkey")])]))


@query
def steps_cross(t):
    return steps(JoinChain(t.customer, "c", [Join(t.supplier, "s", "cross")]))


@query
def steps_theta(t):
    return steps(JoinChain(t.customer, "c", [Join(t.supplier, "s", residual="s.s_acctbal <= c.c_acctbal")]))


@query
def steps_range_per_key(t):
    return steps(JoinChain(t.customer, "c", [
        Join(t.supplier, "s", "left", on=[("c.c_nationkey", "s_nationkey")],
             residual="s.s_acctbal > c.c_acctbal")]))


@query
def steps_or(t):
    return steps(JoinChain(t.customer, "c", [
        Join(t.events, "e", "left", residual="c.c_custkey = e.user_id OR e.event_id = c.c_nationkey"),
        Join(t.orders, "o", on=[("c.c_custkey", "o_custkey")])]))


def text_events(t: Tables) -> DataFrame:
    """Events whose user is stored as text, every other one with leading zeros."""
    text = F.col("user_id").cast("string")
    return t.events.select("event_id", F.when(F.col("event_id") % 2 == 0, F.lpad(text, 12, "0")).otherwise(text).alias("user_text"))


@query
def steps_mixed_key_types(t):
    return steps(JoinChain(t.customer, "c", [
        Join(text_events(t), "e", "left", on=[("c.c_custkey", "user_text")], name="events"),
        Join(t.orders, "o", on=[("e.user_text", "o_custkey")]),
        Join(t.supplier, "s", "full", on=[("e.user_text", "s_suppkey")])]))


@query
def key_stats_mixed_types(t):
    """Keys of the right side are counted as stored, matches as compared."""
    chain = JoinChain(t.customer, "c", [Join(text_events(t), "e", on=[("c.c_custkey", "user_text")], name="events")])
    return audit(chain, fixes=False, exact_duplicates=False).key_stats.select(
        "n_rows", "n_keys", "max_dup", "max_dup_non_null", "dup_keys", "null_rows")


@query
def steps_or_mixed_types(t):
    return steps(JoinChain(t.customer, "c", [
        Join(text_events(t), "e", "left", residual="c.c_custkey = e.user_text OR c.c_nationkey = e.event_id", name="events"),
        Join(t.orders, "o", on=[("c.c_custkey", "o_custkey")])]))


@query
def steps_or_five(t):
    return steps(JoinChain(t.customer, "c", [
        Join(t.events, "e", "left", residual="c.c_custkey = e.user_id OR e.event_id = c.c_nationkey OR c.c_custkey = e.event_id "
             "OR c.c_nationkey = e.user_id OR e.event_id = c.c_acctbal"),
        Join(t.orders, "o", on=[("c.c_custkey", "o_custkey")])]))


@query
def steps_or_then_right_side(t):
    return steps(JoinChain(t.customer, "c", [
        Join(t.events, "e", "full", residual="c.c_custkey = e.user_id OR e.event_id = c.c_nationkey"),
        Join(t.orders, "o", on=[("e.user_id", "o_custkey")])]))


@query
def steps_range_then_right_side(t):
    return steps(JoinChain(t.customer, "c", [
        Join(t.supplier, "s", "left", residual="s.s_acctbal <= c.c_acctbal"),
        Join(t.nation, "n", on=[("s.s_nationkey", "n_nationkey")])]))


@query
def steps_interval(t):
    """Validity intervals: a value between two columns of the right side, one end open."""
    spans = t.supplier.select("s_nationkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 250).alias("high"))
    return steps(JoinChain(t.customer, "c", [
        Join(spans, "s", "right", residual="c.c_acctbal >= s.low AND c.c_acctbal < s.high", name="supplier"),
        Join(t.nation, "n", "left", on=[("s.s_nationkey", "n_nationkey")])]))


def with_spans(t: Tables) -> DataFrame:
    """Suppliers with an interval of balances; one in five ends before it starts."""
    return t.supplier.select("s_suppkey", "s_nationkey", F.col("s_acctbal").alias("low"),
                             (F.col("s_acctbal") + F.when(F.col("s_suppkey") % 5 == 0, -80).otherwise(250)).alias("high"))


@query
def steps_interval_counted(t):
    """Intervals that no later join reads: counted by running sums, per key and without one."""
    return steps(JoinChain(t.customer, "c", [
        Join(with_spans(t), "s", "left", residual="c.c_acctbal >= s.low AND c.c_acctbal < s.high", name="supplier"),
        Join(with_spans(t), "n", "right", on=[("c.c_nationkey", "s_nationkey")], name="supplier",
             residual="c.c_acctbal BETWEEN n.low AND n.high"),
        Join(t.orders, "o", on=[("c.c_custkey", "o_custkey")])]))


@query
def steps_interval_of_the_left(t):
    """The bounds stand on the left side, the values on the right."""
    return steps(JoinChain(with_spans(t), "s", [
        Join(t.customer, "c", "right", residual="s.low < c.c_acctbal AND c.c_acctbal <= s.high", name="customer"),
        Join(t.nation, "n", "left", on=[("s.s_nationkey", "n_nationkey")])]))


@query
def steps_right(t):
    return steps(JoinChain(t.lineitem, "l", [
        Join(t.orders, "o", "right", on=[("l.l_orderkey", "o_orderkey")]),
        Join(t.events, "e", "left", on=[("o.o_custkey", "user_id")])]))


@query
def steps_full(t):
    return steps(JoinChain(t.events, "e", [
        Join(t.supplier, "s", "full", on=[("e.user_id", "s_suppkey")]),
        Join(t.customer, "c", "left", on=[("s.s_nationkey", "c_nationkey")]),
        Join(t.orders, "o", "full", on=[("c.c_custkey", "o_custkey")])]))


@query
def steps_using(t):
    return steps(JoinChain(t.documents, "d", [Join(t.labels, "b", using=["doc_id"])]))


@query
def steps_natural(t):
    last = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    return steps(JoinChain(t.conversations, "m", [Join(last, "last", natural=True)]))


@query
def steps_residual(t):
    return steps(JoinChain(t.orders, "o", [
        Join(t.lineitem, "l", "left", on=[("o.o_orderkey", "l_orderkey")], residual="l.l_quantity > 25")]))


@query
def steps_residual_both_sides(t):
    return steps(JoinChain(t.orders, "o", [
        Join(t.lineitem, "l", "left", on=[("o.o_orderkey", "l_orderkey")],
             residual="l.l_shipdate > o.o_orderdate AND l.l_discount < 0.05"),
        Join(t.customer, "c", on=[("o.o_custkey", "c_custkey")])]))


@query
def steps_semi_anti(t):
    return steps(JoinChain(t.customer, "c", [
        Join(t.events, "e", "semi", on=[("c.c_custkey", "user_id")]),
        Join(t.orders, "o", "left", on=[("c.c_custkey", "o_custkey")]),
        Join(t.supplier, "s", "anti", on=[("c.c_nationkey", "s_nationkey"), ("c.c_custkey", "s_suppkey")])]))


@query
def steps_multi_key(t):
    return steps(JoinChain(t.lineitem, "a", [
        Join(t.lineitem, "b", on=[("a.l_partkey", "l_partkey"), ("a.l_suppkey", "l_suppkey")])]))


@query
def steps_keys_of_siblings(t):
    """A join by a key of each of two many-sides: their rows are never paired."""
    chain = customer_orders_events(t)
    return steps(chain.with_joins([
        *chain.joins,
        Join(t.lineitem, "l", "left", on=[("o.o_orderkey", "l_orderkey"), ("e.event_id", "l_partkey")], name="lineitem"),
        Join(t.part, "p", "left", on=[("l.l_partkey", "p_partkey")]),
        Join(t.labels, "b", "semi", on=[("e.event_id", "doc_id")])]))


@query
def steps_siblings(t):
    """Two many-sides of one table that later joins still read: never joined to each other."""
    chain = customer_orders_events(t)
    return steps(chain.with_joins([
        *chain.joins,
        Join(t.lineitem, "l", "left", on=[("o.o_orderkey", "l_orderkey")]),
        Join(t.documents, "d", "left", on=[("e.event_id", "doc_id")])]))


@query
def steps_hot_key(t):
    """A third of the driving rows share one key; keys above 100 rows are salted."""
    return steps(JoinChain(hot_events(t), "e", [
        Join(t.orders, "o", "left", on=[("e.user_id", "o_custkey")]),
        Join(t.lineitem, "l", "left", on=[("o.o_orderkey", "l_orderkey")]),
        Join(t.documents, "d", on=[("e.event_id", "doc_id")])]), hot_floor=100)


@query
def steps_hot_self_join(t):
    """Both sides repeat a key that holds a third of all rows."""
    return steps(JoinChain(hot_events(t), "e", [Join(hot_events(t), "f", on=[("e.user_id", "user_id")])]))


@query
def joined_rows(t):
    return orders_customer_lineitem(t).to_df().select(
        "o_orderkey", "o_custkey", "c_name", "l_linenumber", "l_quantity")


# -- keys --------------------------------------------------------------------------
KEYED = {
    "orders": ["o_orderkey"], "customer": ["c_nationkey"], "supplier": ["s_nationkey"],
    "lineitem": ["l_orderkey", "l_linenumber"], "events": ["user_id", "event_type"],
    "labels": ["doc_id"], "documents": ["text"], "conversations": ["conv_id", "turn"],
}


@query
def key_stats_tables(t):
    return reduce(DataFrame.unionByName, [
        key_stats(getattr(t, name), keys).select(F.lit(name).alias("table_name"), "*")
        for name, keys in KEYED.items()])


@query
def key_stats_null(t):
    users = F.when(F.col("user_id") % 10 != 0, F.col("user_id"))
    return key_stats(t.events.select(users.alias("user_id"), "value"), ["user_id"])


@query
def key_stats_of_audit(t):
    return audit(customer_orders_events(t), fixes=False).key_stats.drop("section")


@query
def exact_duplicates_events(t):
    return exact_duplicates(t.events.select("user_id", "event_type"))


@query
def exact_duplicates_lineitem(t):
    return exact_duplicates(t.lineitem)


@query
def top_keys_events(t):
    return top_keys(t.events, ["user_id"])


@query
def top_keys_of_audit(t):
    keys = audit(customer_orders_events(t), fixes=False, exact_duplicates=False).top_keys
    value = F.coalesce(F.col("key")["o_custkey"], F.col("key")["user_id"])
    return keys.select("step", value.alias("key_value"), "rows_per_key")


@query
def worst_key_rows(t):
    chain = JoinChain(t.customer, "c", [Join(t.events, "e", on=[("c.c_custkey", "user_id")])])
    rows = audit(chain, fixes=False, exact_duplicates=False).worst_key_rows(1, limit=None)
    return rows.select("c_custkey", "c_name", "event_id", "event_type", "value")


# -- rewrites ----------------------------------------------------------------------
@query
def fix_distinct(t):
    pairs = t.events.select("user_id", "event_type")
    return fixes(JoinChain(t.customer, "c", [
        Join(pairs, "e", "left", on=[("c.c_custkey", "user_id")])], select=["c.c_name", "e.event_type"]))


@query
def fix_grain(t):
    return fixes(JoinChain(t.conversations, "a", [
        Join(t.conversations, "b", on=[("a.conv_id", "conv_id")])], select=["a.turn", "b.turn"]))


@query
def fix_drop(t):
    return fixes(customer_orders(t, select=["c.c_name"]))


@query
def fix_exists(t):
    return audit_sections({
        "orders": JoinChain(t.orders, "o", [Join(t.lineitem, "l", on=[("o.o_orderkey", "l_orderkey")])],
                            select=["o.o_orderkey"]),
        "customer": JoinChain(t.customer, "c", [Join(t.events, "e", on=[("c.c_custkey", "user_id")])],
                              select=["c.c_name"]),
    }).fixes.select("section", "step", "rank", "kind", "verified_rows", "restores_grain")


@query
def fix_preaggregate(t):
    return fixes(customer_orders_events(
        t, select=["c.c_name"], aggs=[Agg("sum", "o.o_totalprice"), Agg("max", "e.value")]))


@query
def fix_residual(t):
    return fixes(JoinChain(t.orders, "o", [
        Join(t.lineitem, "l", "left", on=[("o.o_orderkey", "l_orderkey")], residual="l.l_quantity > 25")],
        select=["o.o_orderkey", "l.l_quantity"]))


@query
def fix_keep_latest(t):
    return keep_latest(t.events, ["user_id"], "ts").select("user_id", "event_id", "event_type", "value")


@query
def pre_aggregated_orders(t):
    return pre_aggregate(t.orders, ["o_custkey"], ["o_orderpriority", "o_totalprice"]).withColumn(
        "o_totalprice", F.round("o_totalprice", 2))


@query
def rewrite_preaggregate(t):
    """The rewritten query itself: revenue per segment without fan-out."""
    result = audit(customer_orders_events(
        t, select=["c.c_mktsegment"], aggs=[Agg("sum", "o.o_totalprice"), Agg("sum", "e.value")]),
        fixes=False, exact_duplicates=False)
    fixed = rewrite_chain(rewrite_chain(result.chain, 0, "preaggregate"), 1, "preaggregate")
    return fixed.to_df().groupBy("c_mktsegment").agg(
        F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.count(F.lit(1)).alias("customers"))


# -- aggregates --------------------------------------------------------------------
@query
def agg_inflation_exact(t):
    """Sums of large integers and of decimals, digit by digit."""
    keyed = t.orders.select("o_custkey", (F.col("o_orderkey") * 1_000_003 + (1 << 53)).alias("large"),
                            F.col("o_totalprice").cast("decimal(20,6)").alias("price"))
    chain = JoinChain(keyed, "o", [Join(t.events, "e", "left", on=[("o.o_custkey", "user_id")])],
                      aggs=[Agg("sum", "o.large"), Agg("sum", "o.price"), Agg("count", "o.price"), Agg("count")])
    return audit(chain, fixes=False, exact_duplicates=False).agg_risks.select("expression", "base_exact", "joined_exact")


@query
def agg_inflation(t):
    return risks(customer_orders_events(t, aggs=[
        Agg("sum", "c.c_acctbal"), Agg("avg", "c.c_acctbal"), Agg("count", "c.c_acctbal"), Agg("count"),
        Agg("min", "c.c_acctbal"), Agg("count", "c.c_custkey", distinct=True)]))


@query
def agg_inflation_orders(t):
    return risks(orders_customer_lineitem(t, aggs=[
        Agg("sum", "o.o_totalprice"), Agg("sum", "o.o_totalprice * 0.1"), Agg("sum", "l.l_extendedprice"),
        Agg("avg", "c.c_acctbal")]))


@query
def agg_risk_rules(t):
    """Which joins affect which aggregate, per table the aggregate reads."""
    return risks(customer_orders_events(t, aggs=[
        Agg("sum", "o.o_totalprice"), Agg("sum", "e.value"), Agg("sum", "value"),
        Agg("sum", "o.o_totalprice + e.value"), Agg("stddev", "c.c_acctbal")]))


# -- sections and documents ----------------------------------------------------------
@query
def sections_summary(t):
    per_order = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("price"))
    result = audit_query(
        [JoinChain(t.orders, "o", [Join(per_order, "p", on=[("o.o_orderkey", "l_orderkey")])]),
         customer_orders(t),
         JoinChain(t.supplier, "s")],
        ctes={"po": JoinChain(t.orders, "o", [Join(t.lineitem, "l", on=[("o.o_orderkey", "l_orderkey")])]),
              "plain": JoinChain(t.customer, "c")},
        fixes=False, exact_duplicates=False)
    return result.sections.select(
        "section", "joins", "fanouts", "driving_rows", "final_rows",
        F.round("overall_factor", 6).alias("overall_factor"), F.col("error").isNotNull().alias("failed"))


@query
def facts_json(t):
    return audit(orders_customer_lineitem(t, aggs=[Agg("sum", "o.o_totalprice")])).facts


@query
def facts_fields(t):
    """The facts document read back as columns."""
    facts = audit(orders_customer_lineitem(t, aggs=[Agg("sum", "o.o_totalprice")]), fixes=False).facts
    schema = ("driving_rows bigint, final_rows bigint, overall_factor double, "
              "joins array<struct<step int, rows_after bigint, max_repeats_of_a_key bigint>>, "
              "aggregates_at_risk array<struct<inflation_pct double>>")
    doc = facts.select(F.from_json("json", schema).alias("d"))
    return doc.select("d.driving_rows", "d.final_rows", "d.overall_factor",
                      F.col("d.joins")[1]["max_repeats_of_a_key"].alias("worst_key"),
                      F.col("d.aggregates_at_risk")[0]["inflation_pct"].alias("inflation_pct"))


# -- sources -----------------------------------------------------------------------
@query
def load_folder_counts(t):
    tables = load_folder(t.spark, t.folder).tables
    return reduce(DataFrame.unionByName, [
        df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n")) for name, df in tables.items()])


@query
def load_text_files(t):
    """Customers and suppliers as every row comes back from CSV and TSV files, under sniffed delimiters."""
    folder = new_folder(t.spark)
    for name, sep, df in (("Buyers 2024.csv", ";", t.customer.drop("c_mktsegment")), ("vendors.tsv", "\t", t.supplier)):
        named = df.toDF("Key", "Full Name", "nation", "balance")
        named.write.option("header", True).option("sep", sep).option("escape", '"').csv(f"{folder}/{name}")
    loaded = load_folder(t.spark, folder).tables
    kinds = {name: ",".join(kind for _, kind in df.dtypes) for name, df in loaded.items()}
    return reduce(DataFrame.unionByName, [
        df.select(F.lit(name).alias("table_name"), F.lit(kinds[name]).alias("types"), F.col("Key").cast("bigint").alias("key"),
                  F.col("Full Name").alias("full_name"), "nation", "balance") for name, df in loaded.items()])


@query
def registered_names(t):
    """Tables registered under their names and read in SQL."""
    register_tables(t.spark, {"audit_orders": t.orders, "audit_customer": t.customer})
    return t.spark.sql("SELECT c_mktsegment, count(*) AS n FROM audit_orders JOIN audit_customer "
                       "ON o_custkey = c_custkey GROUP BY c_mktsegment")


@query
def qualified_names(t):
    """A chain over names of two and three parts; nothing is copied into the catalog."""
    register_tables(t.spark, {"audit.orders": t.orders, "lake.audit.customer": t.customer})
    return steps(table_chain(t.spark, "audit.orders", "o", [
        {"table": "lake.audit.customer", "alias": "c", "on": [("o.o_custkey", "c_custkey")]}]))


@query
def sampled_keys(t):
    """Which keys a 5 % sample keeps, and how many rows of each."""
    return sample_by_key(t.orders, "o_custkey", 0.05).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query
def row_count_of_query(t):
    register_tables(t.spark, {"audit_orders": t.orders, "audit_lineitem": t.lineitem})
    n = query_row_count(t.spark, "SELECT * FROM audit_orders LEFT JOIN audit_lineitem "
                                 "ON o_orderkey = l_orderkey;")
    return t.spark.createDataFrame([(n,)], "n bigint")


@query
def sample_coverage_tables(t):
    return sample_coverage({name: getattr(t, name) for name in
                            ("customer", "orders", "lineitem", "events", "documents", "labels")}, 5_000)


@query
def validate_sample_by_key(t):
    chain = customer_orders(t)
    return validate_sample(chain, sample_chain(chain, {"c": "c_custkey", "o": "o_custkey"}, 0.2))


# -- functions ---------------------------------------------------------------------
@query
def next_month_orders(t):
    return t.orders.select("o_orderkey", next_month("o_orderdate").alias("next_month"))


@query
def next_month_join(t):
    register_functions(t.spark)
    return steps(JoinChain(t.orders, "o", [
        Join(t.lineitem, "l", on=[("o.o_orderkey", "l_orderkey")],
             residual="date_trunc('MM', l.l_shipdate) = next_month(o.o_orderdate)")]))
