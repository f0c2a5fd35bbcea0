"""Property graphs from node and edge files, and as stored tables in buckets, so that hops move no edges.

Every edge type is stored twice, in buckets by its source and by its target; nodes are in buckets by id. All tables of a graph
have the same number of buckets, so a hop joins them where they lie. The catalogue says what a graph holds without a scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pattern import Edge, Graph

#: Properties of edges that files may have, and their types.
PROPERTIES = {"risk_score": "double", "evidence_score": "double", "causal_score": "double", "mr_score": "double", "pvalue": "double", "beta": "double", "link_score": "double", "score": "double", "snp_count": "int"}


def _read(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated file with a header, columns in any order, all as text; empty cells are null."""
    return spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(path)


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Nodes (id, name) of a file with ID and, maybe, name; a node without a name goes by its id. Each id once, with the least
    of its names; rows without an id are none."""
    rows = _read(spark, path)
    name = F.col("name") if "name" in rows.columns else F.lit(None).cast("string")
    return rows.filter("ID IS NOT NULL").groupBy(F.col("ID").alias("id")).agg(F.min(name).alias("name")).withColumn("name", F.coalesce("name", "id"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges (src, dst, properties) of a file with START_ID, END_ID and any of PROPERTIES; a cell that is no number is null.
    Rows that lack an end are none; equal rows are edges of their own."""
    rows = _read(spark, path)
    found = [F.col(c).try_cast(t).alias(c) for c, t in PROPERTIES.items() if c in rows.columns]
    return rows.filter("START_ID IS NOT NULL AND END_ID IS NOT NULL").select(F.col("START_ID").alias("src"), F.col("END_ID").alias("dst"), *found)


def read_graph(spark: SparkSession, nodes: dict[str, str], edges: dict[str, tuple[str, str, str]]) -> Graph:
    """A graph from files: label to path, and type to (path, source label, target label). Edges whose ends are no nodes of
    their labels are left out."""
    tables = {label: read_nodes(spark, path) for label, path in nodes.items()}
    kept = {}
    for kind, (path, source, target) in edges.items():
        rows = read_edges(spark, path)
        for end, label in (("src", source), ("dst", target)):
            ids = tables[label].select(F.col("id").alias(end))
            rows = rows.join(ids, end, "left_semi")
        kept[kind] = Edge(rows.select("src", "dst", *(c for c in rows.columns if c not in ("src", "dst"))), source, target)
    return Graph(tables, kept)


def _save(df: DataFrame, table: str, key: str, buckets: int) -> int:
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("overwrite").format("parquet").saveAsTable(table)
    return df.sparkSession.table(table).count()  # from the files' footers


#: Rows that a bucket should hold about: a task sorts one bucket, whatever the size of the table.
BUCKET_ROWS = 1_000_000


def buckets_for(rows: int, least: int = 8) -> int:
    """How many buckets a graph whose largest table has so many rows should have."""
    return max(least, -(-rows // BUCKET_ROWS))


def store(graph: Graph, name: str, buckets: int) -> None:
    """Write a graph's tables; the catalogue comes last, so a graph without one isn't whole and storing it again replaces it.
    ``buckets``: see ``buckets_for``. A node or an end that holds a large share of all edges makes
    one bucket large: joins on it are split by AQE only where they shuffle."""
    spark, found = next(iter(graph.nodes.values())).sparkSession, []
    spark.sql(f"DROP TABLE IF EXISTS {name}_catalogue")
    for label, table in graph.nodes.items():
        found.append(("node", label, None, None, table.columns, _save(table, f"{name}_node_{label}", "id", buckets)))
    for kind, edge in graph.edges.items():
        n = _save(edge.table, f"{name}_out_{kind}", "src", buckets)
        _save(spark.table(f"{name}_out_{kind}"), f"{name}_in_{kind}", "dst", buckets)
        found.append(("edge", kind, edge.source, edge.target, edge.table.columns, n))
    rows = spark.createDataFrame(found, "kind string, name string, source string, target string, columns array<string>, n long")
    rows.coalesce(1).write.mode("overwrite").format("parquet").saveAsTable(f"{name}_catalogue")


def catalogue(spark: SparkSession, name: str) -> DataFrame:
    """(kind, name, source, target, columns, n): a row for each label and each type."""
    return spark.table(f"{name}_catalogue")


def opened(spark: SparkSession, name: str) -> Graph:
    """A stored graph; hops against an edge's direction read the table that lies by its target."""
    rows = catalogue(spark, name).collect()  # a row for each label and type
    nodes = {r["name"]: spark.table(f"{name}_node_{r['name']}") for r in rows if r["kind"] == "node"}
    edges = {r["name"]: Edge(spark.table(f"{name}_out_{r['name']}"), r["source"], r["target"], spark.table(f"{name}_in_{r['name']}")) for r in rows if r["kind"] == "edge"}
    return Graph(nodes, edges)


def dropped(spark: SparkSession, name: str) -> None:
    """Remove a stored graph, its catalogue first."""
    rows = catalogue(spark, name).collect()
    tables = [f"{name}_catalogue"]
    for r in rows:
        tables += [f"{name}_node_{r['name']}"] if r["kind"] == "node" else [f"{name}_out_{r['name']}", f"{name}_in_{r['name']}"]
    for table in tables:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
