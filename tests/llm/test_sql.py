"""The operators that SQL can express against their SQL, over the smallest tables."""

import duckdb
import pytest

from helixgraph.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    rows = queries.QUERIES[name](spark, FOLDER)
    result = connection.sql(queries.ORACLE_SQL[name])
    assert sorted(result.columns) == sorted(rows.columns)
    assert sorted(tuple(r) for r in rows.select(*result.columns).collect()) == sorted(result.fetchall())
