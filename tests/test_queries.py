"""Every query against DuckDB on the same tables; those without SQL have to run."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from millrace import plans


def values(columns, rows):
    text = lambda v: f"{v:.5f}" if isinstance(v, float) and not math.isnan(v) else str(getattr(v, "replace", lambda **_: v)(tzinfo=None)) if hasattr(v, "tzinfo") else repr(v)
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, sf_dir, duck, name):
    df = plans.queries()[name](spark, sf_dir)
    rows = df.collect()
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert values(df.columns, rows) == values(want.columns, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
