"""Every reference-domain query against its SQL, run by DuckDB over the same tables."""

import glob
import math
import os

import duckdb
import pytest

from helixgraph.plans import catalogue, registry  # noqa: F401

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "null" if math.isnan(value) else repr(value)
    return "null" if value is None else str(value)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    rows = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(rows.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in rows.collect())
    if name not in registry.ORACLE_SQL:
        assert got
        return
    result = duck.sql(registry.ORACLE_SQL[name])
    where = {c: i for i, c in enumerate(result.columns)}
    assert sorted(where) == columns
    expected = sorted(tuple(plain(r[where[c]]) for c in columns) for r in result.fetchall())
    assert got == expected
