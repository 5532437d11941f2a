"""Every registered query against its SQL, on the smallest tables."""

import datetime
import glob
import os

import duckdb
import pytest

import __spark_entry__ as driver
from checks.oracles import ORACLES
from checks.queries import QUERIES


@pytest.fixture(scope="module")
def con(small):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def normal(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.date()
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    return sorted(columns), sorted((tuple(normal(r[n]) for n in order) for r in rows), key=repr)


def test_every_oracle_has_a_query():
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"facts_json"}


def test_entry(spark):
    assert driver.entry(spark).count() == 2


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, small, name):
    df = QUERIES[name](spark, small)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        assert got[1]
        return
    cur = con.execute(ORACLES[name])
    want = table([d[0] for d in cur.description], cur.fetchall())
    assert got == want
