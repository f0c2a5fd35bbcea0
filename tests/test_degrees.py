"""Degrees and edge counts over odd tables against their SQL, and what their plans repeat."""

import re

import duckdb
import pytest

from helixgraph.operators.pattern import Edge, Graph
from helixgraph.plans import catalogue, registry  # noqa: F401 (the catalogue registers the queries)

FOLDER = "/root/testdata/sf0.001"
TABLES = ("customer", "lineitem", "nation", "orders", "part", "region", "supplier")


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Properties of more than 63 values and null ones, line items without a protein, a gene or an order."""
    folder = str(tmp_path_factory.mktemp("odd"))
    changed = {
        "part": "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type || ' ' || p_partkey % 150 END AS p_type, CASE WHEN p_partkey % 5 > 0 THEN p_size * 3 + p_partkey % 3 END AS p_size",
        "lineitem": "CASE WHEN l_orderkey % 9 > 0 THEN l_suppkey END AS l_suppkey, CASE WHEN l_linenumber <> 5 THEN l_partkey END AS l_partkey, CASE WHEN l_linenumber <> 6 THEN l_orderkey END AS l_orderkey",
    }
    connection = duckdb.connect()
    for t in TABLES:
        rows = f"* REPLACE ({changed[t]})" if t in changed else "*"
        connection.execute(f"COPY (SELECT {rows} FROM '{FOLDER}/{t}.parquet') TO '{folder}/{t}.parquet'")
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return folder, connection


@pytest.mark.parametrize("name", ["graph_degrees", "graph_edge_counts", "graph_isolated"])
def test_odd_tables(spark, odd, name):
    folder, connection = odd
    rows = registry.QUERIES[name](spark, folder)
    said = connection.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in said.description]
    assert sorted(map(tuple, rows.select(*columns).collect()), key=str) == sorted(said.fetchall(), key=str)


@pytest.mark.parametrize("name", ["graph_degrees", "graph_edge_counts"])
def test_line_items_meet_parts_once(spark, name):
    """The four types of proteins' properties share one join, which is behind them, and no join follows the count."""
    plan = registry.QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.findall(r"Join Inner, \(src#\d+L? = id", plan)
    assert "Join LeftOuter" not in plan


def test_ids_null_shared_and_of_two_types(spark):
    nodes = {"A": spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d")], "id long, name string"), "B": spark.createDataFrame([("1", "x"), ("y", "y")], "id string, name string")}
    edges = {
        "T": Edge(spark.createDataFrame([(1, 1), (1, None), (None, 2), (None, None), (7, 1)], "src long, dst long"), "A", "A"),
        "U": Edge(spark.createDataFrame([(1, 1), (2, 1), (None, 5)], "src int, dst long"), "A", "B"),
    }
    out = sorted(map(tuple, Graph(nodes, edges).degrees().collect()), key=str)
    assert out == sorted([("A", "1", 4), ("A", "1", 4), ("A", "2", 2), ("A", None, 0), ("B", "1", 2), ("B", "y", 0)], key=str)
