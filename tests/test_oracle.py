"""Every registered query against its SQL twin, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_points

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = entry_points.queries()
ORACLES = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def normal(value):
    if isinstance(value, float):
        return repr(value + 0.0) if value else "0.0"
    return repr(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(name, spark, duck):
    df = QUERIES[name](spark, SF_DIR)
    rows = df.collect()
    columns = sorted(df.columns)
    if name not in ORACLES:
        assert rows
        return
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert columns == sorted(names)
    expected = sorted(tuple(normal(row[names.index(c)]) for c in columns) for row in result.fetchall())
    assert sorted(tuple(normal(row[c]) for c in columns) for row in rows) == expected


def test_entry_runs(spark):
    df = entry_points.entry(spark)
    assert {"rule", "round", "distance"} == set(df.columns)
