"""Every registered query runs at sf0.001; queries with an oracle match it
in DuckDB (row count, column names, rounded value multiset)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from helpers import SF

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=lambda t: tuple((x is None, str(x)) for x in t))


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["fid", "part", "error_type"]
    assert df.count() >= 0


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols, rows = df.columns, [tuple(r) for r in df.collect()]
    spark.catalog.clearCache()      # queries persist their shared intermediates
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(dcols)
    assert _rows(cols, rows) == _rows(dcols, res.fetchall())
