"""Registered queries under a cluster's master, with a checkpoint folder of scheme file: that executors share."""

import datetime
import json

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from checks.oracles import ORACLES
from checks.queries import QUERIES

from test_entry import table

DAY = datetime.datetime(1997, 1, 15)

#: Rows of the tables that the queries below read; keys repeat as in the given tables.
ROWS = {
    "region": [{"r_regionkey": n, "r_name": f"R{n}"} for n in range(2)],
    "nation": [{"n_nationkey": n, "n_name": f"N{n}", "n_regionkey": n % 2} for n in range(4)],
    "customer": [{"c_custkey": n, "c_name": f"C{n}", "c_nationkey": n % 4, "c_acctbal": 12.5 * n - 40, "c_mktsegment": "AB"[n % 2]}
                 for n in range(12)],
    "supplier": [{"s_suppkey": n, "s_name": f"S{n}", "s_nationkey": n % 3, "s_acctbal": 7.25 * n} for n in range(5)],
    "orders": [{"o_orderkey": n, "o_custkey": n * n % 11, "o_orderstatus": "FO"[n % 2], "o_totalprice": 100.25 + n,
                "o_orderdate": DAY + datetime.timedelta(days=9 * n), "o_orderpriority": f"{n % 3}-P"} for n in range(30)],
    "lineitem": [{"l_orderkey": n * 7 % 29, "l_partkey": n % 9, "l_suppkey": n % 5, "l_linenumber": n // 29, "l_quantity": 1.0 + n * 3 % 50,
                  "l_extendedprice": 10.5 * n, "l_discount": 0.01 * (n % 10), "l_tax": 0.02, "l_returnflag": "N", "l_linestatus": "O",
                  "l_shipdate": DAY + datetime.timedelta(days=9 * (n * 7 % 29) + n % 40)} for n in range(70)],
    "events": [{"event_id": n, "ts": DAY + datetime.timedelta(hours=n), "user_id": n * n % 13, "event_type": "xyz"[n % 3],
                "value": 0.5 * n, "props": "{}"} for n in range(40)],
    "conversations": [{"conv_id": n // 4, "turn": n % 4, "role": "ua"[n % 2], "text": f"t{n}"} for n in range(20)],
}
NARROW = {"r_regionkey", "n_nationkey", "n_regionkey", "c_nationkey", "s_nationkey", "l_linenumber"}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    for name, rows in ROWS.items():
        made = pa.Table.from_pylist(rows)
        fields = [pa.field(f.name, pa.int32() if f.name in NARROW else f.type) for f in made.schema]
        pq.write_table(made.cast(pa.schema(fields)), top / f"{name}.parquet")
    return str(top)


@pytest.fixture(scope="module")
def con(folder):
    con = duckdb.connect()
    for name in ROWS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


@pytest.fixture()
def cluster(spark, tmp_path, monkeypatch):
    spark.conf.set("spark.sql.legacy.setCommandRejectsSparkCoreConfs", "false")
    spark.conf.set("spark.checkpoint.dir", f"file://{tmp_path}")
    monkeypatch.setattr(spark.sparkContext, "master", "spark://name:7077")
    yield spark
    spark.conf.unset("spark.checkpoint.dir")
    spark.conf.unset("spark.sql.legacy.setCommandRejectsSparkCoreConfs")


#: Each was refused before: no folder of scheme file: was taken for a shared one.
NAMES = [
    "agg_inflation_exact",
    "agg_inflation_orders",
    "agg_risk_rules",
    "facts_fields",
    "fix_distinct",
    "fix_drop",
    "fix_exists",
    "fix_grain",
    "fix_preaggregate",
    "fix_residual",
    "key_stats_mixed_types",
    "key_stats_of_audit",
    "load_text_files",
    "next_month_join",
    "rewrite_preaggregate",
    "qualified_names",
    "sections_summary",
    "steps_clean",
    "steps_cross",
    "steps_compounding",
    "steps_full",
]


@pytest.mark.parametrize("name", NAMES)
def test_query_on_a_cluster(cluster, con, folder, name):
    df = QUERIES[name](cluster, folder)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(ORACLES[name])
    assert got == table([d[0] for d in cur.description], cur.fetchall()) and got[1]


def test_facts_on_a_cluster(cluster, con, folder):
    """facts_json has no SQL; its counts are those of the joins."""
    doc = json.loads(QUERIES["facts_json"](cluster, folder).first()["json"])
    customer = "orders JOIN customer ON o_custkey = c_custkey"
    sources = ["orders", customer, f"{customer} LEFT JOIN lineitem ON o_orderkey = l_orderkey"]
    rows = [con.execute(f"SELECT count(*) FROM {s}").fetchone()[0] for s in sources]
    assert [doc["driving_rows"], *(j["rows_after"] for j in doc["joins"])] == rows and doc["final_rows"] == rows[-1]
    assert doc["joins"][1]["top_fix_verified_rows"] and doc["aggregates_at_risk"][0]["expression"] == "SUM(o.o_totalprice)"
