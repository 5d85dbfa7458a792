"""Every registered query with SQL, on small tables, against DuckDB."""

import datetime
import glob
import os

import duckdb
import pytest

from quillspark import plans

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_equals_sql(spark, con, name):
    df = plans.QUERIES[name](spark, FOLDER)
    columns = ", ".join(f'"{c}"' for c in df.columns)
    want = con.sql(f"SELECT {columns} FROM ({plans.ORACLE_SQL[name]})").fetchall()
    got = [tuple(map(plain, r)) for r in df.collect()]
    assert sorted(got, key=str) == sorted([tuple(map(plain, r)) for r in want], key=str)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_others_run(spark, name):
    assert plans.QUERIES[name](spark, FOLDER).count() > 0
