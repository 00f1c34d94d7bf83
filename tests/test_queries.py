"""Every query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from imgrel.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    return f"{value:.6f}" if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = sorted(tuple(plain(row[c]) for c in columns) for row in df.collect())
    assert found
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    order = [rel.columns.index(c) for c in columns]
    assert found == sorted(tuple(plain(row[k]) for k in order) for row in rel.fetchall())


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
