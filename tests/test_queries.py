"""Every registered query that has SQL, against DuckDB on the smallest tables: columns and rows."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from factloom.plans import queries as core
from factloom.plans import queries_more  # noqa: F401


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    return v if v is None or isinstance(v, (int, bool)) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_against_sql(spark, sf, duck, name):
    df = core.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rel = duck.sql(core.ORACLE_SQL[name])
    assert cols == sorted(rel.columns)
    mine = sorted(str(tuple(plain(v) for v in r)) for r in df.select(cols).collect())
    theirs = sorted(str(tuple(plain(v) for v in r)) for r in rel.select(*(f'"{c}"' for c in cols)).fetchall())
    assert mine == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan(spark, sf):
    plan = core.QUERIES["s02_incremental_scan"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_id), GreaterThan(event_id,5000)]" in plan and "ReadSchema: struct<event_id:bigint,event_type:string>" in plan


def test_patterns_scan_one_predicate(spark, sf):
    """A constant predicate prunes the other branches of the triples."""
    from factloom.operators.patterns import one_pattern
    from factloom.plans.triples import triples

    plan = one_pattern(triples(spark, sf), "?t track:hasTrackId ?id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
