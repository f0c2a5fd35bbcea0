"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rounds after which the search fails loudly; each round at least halves the depth of a tree, so this is never met.
MOST_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: each node's neighbours are linked to the least of them.

    The large star moves the greater neighbours of a node, the small star the node itself and its lesser ones.
    """
    if large:
        directed = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        directed = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    # written before the join, so that Spark can split the rows of a node with many neighbours
    least = materialize(directed.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    met = directed.join(least, "u")
    moved = met.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else met.select(F.col("v").alias("a"), F.col("m").alias("b"))
    own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return moved.union(own).filter("a <> b").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b); component is the least node reachable.

    Only counts and one sum come to the driver. Each round is written to the shared folder, so lineage stays short.
    Self-links and repeated links do no harm; nodes that are in no link are not returned.
    """
    edges = materialize(edges.filter("a <> b").select("a", "b").distinct(), name)
    seen = None
    for _ in range(MOST_ROUNDS):
        edges = materialize(_star(_star(edges, True), False), name)
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots).distinct()
