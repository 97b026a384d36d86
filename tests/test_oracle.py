"""Every registered query against its DuckDB oracle, on the smallest scale."""

import datetime as dt
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from report_fixtures import BASE_TABLES


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return v


def _canon(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(entry.report_queries()) == set(entry.report_sql())


@pytest.mark.parametrize("key", sorted(entry.report_queries()))
def test_query_matches_oracle(spark, sf_dir, duck, key):
    sdf = entry.report_queries()[key](spark, sf_dir)
    rel = duck.sql(entry.report_sql()[key])
    assert sorted(sdf.columns) == sorted(rel.columns)
    assert _canon(sdf.columns, sdf.collect()) == _canon(rel.columns, rel.fetchall())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["Item", "Department", "Net Attendance", "Net Value"]
    assert df.count() > 0
