"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["c_custkey", "state", "n_results", "any_unknown"] and out.count() > 0


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_sql(spark, duck, name):
    a = entry.queries()[name](spark, SF)
    r = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in r.description]
    assert sorted(a.columns) == sorted(columns)
    names = sorted(columns)
    mine = sorted(repr([plain(x[n]) for n in names]) for x in a.collect())
    theirs = sorted(repr([plain(dict(zip(columns, x))[n]) for n in names]) for x in r.fetchall())
    assert mine == theirs
