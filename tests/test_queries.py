"""Every registered query with SQL gives DuckDB's rows."""

import datetime
import decimal
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tallyloom.plans import registry


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rel = duck.sql(registry.ORACLES[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["n_name", "s_suppkey", "rank", "rate", "status"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scans_prune_columns_and_push_filters(spark, sf):
    plan = registry.QUERIES["anti_unseen"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,100000.0)" in plan and "o_comment" not in plan
