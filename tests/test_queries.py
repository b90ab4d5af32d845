"""Every query that has SQL, outside the llm subpackage, against DuckDB over the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as driver
from siltstone.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def told(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(told(x) for x in v) + "]"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert sorted("|".join(told(r[c]) for c in cols) for r in df.collect()) == sorted("|".join(told(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_has_stable_columns(spark):
    assert driver.entry(spark).columns == driver.entry(spark).columns
    assert set(driver.oracle_sql()) <= set(driver.queries())
