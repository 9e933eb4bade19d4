"""Driver contract: entry smoke check, registry consistency, and every
registered query against its DuckDB oracle on the sf0.001 tables."""

import datetime as dt
import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import types as T

import __spark_entry__ as E
from support import SF_SMALL
from wayfare.plans.catalog import all_queries

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["route_no", "efficiency_score"]
    assert df.count() > 0


def test_registry_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100
    for name, spec in all_queries().items():
        assert spec.doc, name


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return v


def _bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(n for n in E.oracle_sql() if n in all_queries()))
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    spec = all_queries()[name]
    doubles = {f.name for f in sdf.schema.fields if isinstance(f.dataType, T.DoubleType)}
    assert doubles == set(spec.doubles), f"declared doubles {spec.doubles} vs {sorted(doubles)}"
    srows = [tuple(r) for r in sdf.collect()]
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert _bag(sdf.columns, srows) == _bag(dcols, res.fetchall())
