"""Folders, catalog names, JDBC options, samples, demo tables, functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from grainwise import AuditError, Join, JoinChain, audit, count_chain, next_month
from grainwise.sources import (
    JdbcSource, demo_tables, load_folder, local_name, named_table, query_row_count, register_tables, sample_by_key,
    sample_chain, sample_coverage, sample_rows, sanitize_name, table_chain, validate_sample)
from grainwise.sources.jdbc import counting


def test_names():
    assert sanitize_name("Sales Orders (2024)") == "sales_orders_2024"
    assert sanitize_name("2024-orders") == "t_2024_orders"
    assert sanitize_name("--") == "table"
    assert local_name("srv.DB.Admin.Product Map") == "db.admin.product_map"


def test_load_folder(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/Order Items.parquet")
    (tmp_path / "people.csv").write_text("id,name,born\n1,Ann,2001-02-03\n2,Bo,\n")
    (tmp_path / "codes.tsv").write_text("code\tlabel\nA\tx, y\nB\tz\n")
    (tmp_path / "semi.txt").write_text("a;b\n1;2\n")
    (tmp_path / "broken.parquet").write_text("not parquet")
    (tmp_path / "notes.md").write_text("ignored")
    got = load_folder(spark, str(tmp_path), {"semi": "a long, b long"})
    assert sorted(got.tables) == ["codes", "order_items", "people", "semi"]
    assert got.tables["order_items"].count() == 5
    assert dict(got.tables["people"].dtypes) == {"id": "int", "name": "string", "born": "date"}
    assert got.tables["codes"].first()["label"] == "x, y"
    assert dict(got.tables["semi"].dtypes) == {"a": "bigint", "b": "bigint"}
    assert len(got.errors) == 1 and got.errors[0].startswith("broken.parquet: ")


def test_text_tables_as_written(spark, tmp_path):
    """Doubled quotes, a byte order mark, line breaks in values, compressed parts, and empty files."""
    (tmp_path / "quoted.csv").write_text('id;note\n1;"x ""q"" ; y"\n2;z\n')
    (tmp_path / "marked.tsv").write_bytes(b"\xef\xbb\xbfa\tb\n1\t2\n")
    (tmp_path / "breaks.csv").write_text('a,b\n1,"x\ny"\n')
    (tmp_path / "empty.csv").write_text("")
    spark.range(3).selectExpr("id", "id + 0.5 AS half").write.option("header", True).option("sep", "|").csv(
        f"{tmp_path}/parts.csv", compression="gzip")
    got = load_folder(spark, str(tmp_path), multiline=True)
    rows = {name: sorted(map(tuple, df.collect())) for name, df in got.tables.items()}
    assert rows == {"quoted": [(1, 'x "q" ; y'), (2, "z")], "marked": [(1, 2)], "breaks": [(1, "x\ny")],
                    "parts": [(0, 0.5), (1, 1.5), (2, 2.5)]}
    assert got.tables["marked"].columns == ["a", "b"]
    assert got.errors == ["empty.csv: No columns to read: the file is empty"]


def test_listing_runs_no_job(spark, small):
    """Names come from the file system: no job, whatever the files hold."""
    from grainwise.sources.files import list_files

    spark.sparkContext.setJobGroup("listing", "list")
    try:
        paths = list_files(spark, small)
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert f"{small}/orders.parquet" in paths and len(paths) == 14
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("listing")


def test_qualified_names(spark):
    """Names of two and three parts, without a copy; a catalog table of that name stays as it is."""
    spark.sql("CREATE SCHEMA IF NOT EXISTS sales")
    spark.range(5).write.mode("overwrite").saveAsTable("sales.orders")
    orders = spark.createDataFrame([(1, 10)], "id int, customer_id int")
    customers = spark.createDataFrame([(10, "Ada")], "id int, name string")
    register_tables(spark, {"sales.orders": orders, "lake.sales.customers": customers, "plain": orders})
    chain = table_chain(spark, "sales.orders", "o", [
        {"table": "lake.sales.customers", "alias": "c", "on": [("o.customer_id", "id")]}])
    r = audit(chain)
    assert (r.driving_rows, r.final_rows) == (1, 1)
    assert r.step_list[0].bound.join.source == "lake.sales.customers c" and chain.source == "sales.orders o"
    assert spark.table("plain").count() == 1 and spark.table("sales.orders").count() == 5
    assert query_row_count(spark, " SELECT * FROM sales.orders ; ") == 5
    with pytest.raises(AuditError, match="three"):
        register_tables(spark, {"a.b.c.d": orders})


def test_copies_into_the_catalog(spark):
    orders = spark.createDataFrame([(1, 10)], "id int, customer_id int")
    spark.sql("DROP TABLE IF EXISTS depot.orders")
    register_tables(spark, {"depot.orders": orders}, copy=True)
    assert query_row_count(spark, "SELECT * FROM depot.orders") == 1
    with pytest.raises(AuditError, match="not written"):
        register_tables(spark, {"spark_catalog.depot.orders": spark.range(3)}, copy=True)
    assert spark.table("depot.orders").count() == 1
    assert named_table(spark, "depot.orders").count() == 1


def test_files_of_one_name(spark, tmp_path):
    (tmp_path / "t a.csv").write_text("x\n1\n")
    (tmp_path / "t-a.csv").write_text("x\n1\n2\n")
    spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/t_a.parquet")
    got = load_folder(spark, str(tmp_path))
    assert {n: df.count() for n, df in got.tables.items()} == {"t_a": 1, "t_a_2": 2, "t_a_3": 3}


def test_fractions_and_null_keys(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("k"), F.col("id").alias("n"))
    for fraction in (0.0005, 0.02, 0.3):
        kept = sample_by_key(rows, "k", fraction)
        for some in (kept.where("k is null").count(), kept.where("k is not null").count()):
            assert abs(some - 2000 * fraction) <= 5 * (2000 * fraction) ** 0.5 + 1
    assert sample_by_key(rows, "k", 1).count() == 4000
    for bad in (0, -0.1, 1.5):
        with pytest.raises(AuditError, match="fraction"):
            sample_by_key(rows, "k", bad)


class Recorder:
    """Stands in for the session's reader: no database is contacted."""

    def __init__(self):
        self.seen = {}

    read = property(lambda self: self)

    def format(self, name):
        self.seen = {"format": name}
        return self

    def options(self, **options):
        self.seen |= options
        return self

    def option(self, key, value):
        self.seen[key] = value
        return self

    def load(self):
        return self

    def first(self):
        return (42,)


def test_jdbc_requests():
    r = Recorder()
    want = {"netezza": "SELECT * FROM s.t LIMIT 5", "databricks": "SELECT * FROM s.t TABLESAMPLE (5 ROWS)",
            "oracle": "SELECT * FROM s.t FETCH FIRST 5 ROWS ONLY", "sqlserver": "SELECT TOP (5) * FROM s.t"}
    for kind, sql in want.items():
        source = JdbcSource(r, kind, "jdbc:x://host/db", {"user": "u", "password": "secret"})
        source.sample("s.t", 5)
        assert r.seen == {"format": "jdbc", "url": "jdbc:x://host/db", "user": "u", "password": "secret",
                          "query": sql}
        assert "secret" not in repr(source)
    assert source.row_count("s.t") == 42 and r.seen["query"] == "SELECT COUNT(*) AS n FROM s.t"
    assert source.query_row_count(" SELECT 1; ") == 42
    assert r.seen["query"] == counting("SELECT 1") == "SELECT COUNT(*) AS n FROM (SELECT 1) counted"
    source.query("SELECT 2 ;")
    assert r.seen["query"] == "SELECT 2"
    source.table("s.t", "id", 0, 100, 8)
    assert (r.seen["dbtable"], r.seen["partitionColumn"], r.seen["numPartitions"]) == ("s.t", "id", 8)
    with pytest.raises(AuditError, match="needs lower"):
        source.table("s.t", "id")
    with pytest.raises(AuditError, match="Unknown database"):
        JdbcSource(r, "abacus", "jdbc:x")


def test_samples(spark):
    left = spark.range(1000).select(F.col("id").cast("int").alias("k"))
    right = spark.range(3000).select((F.col("id") % 1000).alias("k"), F.col("id").alias("n"))
    assert sample_rows(left, 7).count() == 7
    kept = {r[0] for r in sample_by_key(left, "k", 0.2).collect()}
    assert kept == {r[0] for r in sample_by_key(right, "k", 0.2).select("k").distinct().collect()}
    assert 100 < len(kept) < 300
    full = JoinChain(left, "l", [Join(right, "r", on=[("l.k", "k")])])
    sampled = sample_chain(full, {"l": "k", "r": "k"}, 0.2)
    assert count_chain(sampled) == 3 * len(kept)
    assert tuple(validate_sample(full, sampled).first()) == (3000, 3 * len(kept))
    got = {r["table_name"]: (r["sample_rows"], r["full_rows"])
           for r in sample_coverage({"left": left, "right": right}, 2000).collect()}
    assert got == {"left": (1000, 1000), "right": (2000, 3000)}


def test_demo_shapes(demo, spark):
    counts = {name: df.count() for name, df in demo.items()}
    assert (counts["customers"], counts["orders"], counts["shipments"]) == (200, 1000, 800)
    per_order = [r[0] for r in demo["payments"].groupBy("order_id").count().select("count").collect()]
    assert len(per_order) == 1000 and max(per_order) == 3
    assert 0.3 < sum(n > 1 for n in per_order) / 1000 < 0.4
    items = [r[0] for r in demo["order_items"].groupBy("order_id").count().select("count").collect()]
    assert set(items) == {1, 2, 3, 4, 5}
    for name, key in (("customers", "customer_id"), ("orders", "order_id"), ("payments", "payment_id"),
                      ("order_items", "item_id"), ("shipments", "order_id")):
        assert demo[name].select(key).distinct().count() == counts[name]
    assert {r[0] for r in demo["customers"].select("region").distinct().collect()} == {
        "North", "South", "East", "West"}
    assert dict(demo["orders"].dtypes) == {"order_id": "bigint", "customer_id": "bigint",
                                           "order_date": "timestamp", "amount": "double"}
    again = demo_tables(spark)["orders"].repartition(7).exceptAll(demo["orders"])
    assert again.count() == 0
    assert demo_tables(spark, seed=8)["orders"].exceptAll(demo["orders"]).count() > 0


def test_next_month(spark):
    dates = spark.sql("SELECT * FROM VALUES (DATE'2024-01-31'), (DATE'2024-12-15'), (NULL) t(d)")
    assert [r[0] for r in dates.select(next_month("d")).collect()] == [
        datetime.date(2024, 2, 1), datetime.date(2025, 1, 1), None]
