"""Rounded scores at the edges: as the SQL rounds, and the same in any order of the rows."""

import duckdb
from pyspark.sql import functions as F

from helixgraph.operators import variants as V

EDGES = [0.10007049999999999, 0.1250005, 0.1250015, 0.1250025, 0.5, -0.1250015, 0.0]


def test_edges_as_in_sql(spark):
    rows = spark.createDataFrame([(x,) for x in EDGES], "x double")
    expected = [duckdb.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchall()[0][0] for x in EDGES]
    assert [r[0] for r in rows.select(V.rounded("x", 6)).collect()] == expected
    assert [r[0] for r in rows.select(F.round("x", 6)).collect()] != expected


def test_means_in_any_order(spark):
    values = [0.1, 0.2, 0.3]
    rows = [(0, i, x) for i, x in enumerate(values)] + [(1, i, x) for i, x in enumerate(reversed(values))]
    data = spark.createDataFrame(rows, "g int, i int, x double").repartition(1).sortWithinPartitions("g", "i")
    plain = {r[0] for r in data.groupBy("g").agg(F.avg("x")).select("avg(x)").collect()}
    exact = {r[0] for r in data.groupBy("g").agg(V.exact_mean("x").alias("m")).select("m").collect()}
    assert len(plain) == 2 and exact == {0.6 / 3}


def test_shared_scores_keep_beta_whole(spark):
    """Means of beta aren't rounded, scores are as the SQL rounds them."""
    from unittest.mock import patch

    from helixgraph.plans import genetic_queries as Q

    rows = [(1, "A", 0.10007049999999999, 0.5, 0.1 / 3), (1, "R", 0.10007049999999999, 0.5, 0.2 / 3)]
    data = spark.createDataFrame(rows, "gene long, disease string, extended_score double, evidence_score double, beta double")
    with patch.object(Q, "extended", lambda s: data):
        (row,) = Q.gene_shared_scores(None).collect()
    score = duckdb.execute("SELECT round(?::DOUBLE, 6)", [0.10007049999999999]).fetchall()[0][0]
    assert (row["score"], row["beta"]) == (score, (0.1 / 3 + 0.2 / 3) / 2)
