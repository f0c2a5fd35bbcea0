"""No table of many rows is sent to all executors, and so none passes whole through the driver."""

import pytest

from helixgraph.operators import gold
from helixgraph.operators.gold import Task
from helixgraph.operators.pattern import Edge, Graph
from helixgraph.plans import gold_queries
from helixgraph.sources import session, star

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def none_sent(monkeypatch):
    """No row may be sent; what is written on the way is looked at too."""

    def written(df):
        plans.append(plan(df))
        return session.written(df)

    plans = []
    monkeypatch.setattr(session, "SENT", 0, raising=False)
    monkeypatch.setattr(gold, "written", written)
    return plans


def test_reasons_send_no_table(spark, none_sent):
    judged = gold_queries._judged(star.Star(spark, FOLDER))
    assert "Broadcast" not in plan(judged)
    levels = [p for p in none_sent if "_level" in p]
    assert len(levels) > 15 and all("Broadcast" not in p for p in levels)


@pytest.mark.parametrize("edges", ["INCREASES_RISK_OF", "PUTATIVE_CAUSAL_EFFECT", "HAS_PROCESS", "EXPRESSED_IN"])
def test_views_send_no_table(spark, none_sent, edges):
    assert "Broadcast" not in plan(star.Star(spark, FOLDER).graph.edges[edges].table)


def test_paths_whose_labels_differ(spark, none_sent):
    """Edges are only taken to end at nodes of their own labels where paths follow these."""
    nodes = {k: spark.createDataFrame([(i, f"{k}{i}") for i in ids], "id long, name string") for k, ids in (("A", (1, 2)), ("B", (2, 3)), ("C", (1, 3)))}
    edges = {"E": Edge(spark.createDataFrame([(1, 2), (2, 3), (4, 2), (1, 9), (3, 3)], "src long, dst long"), "A", "B"), "F": Edge(spark.createDataFrame([(2, 1), (3, 9), (2, 3)], "src long, dst long"), "B", "C")}
    tasks = [
        Task("ONE", "A", "x", (("E", "out"),), "n1_name"), Task("OTHER", "C", "x", (("E", "out"),), "n1_id"), Task("BOTH", "B", "x", (("E", "both"),), "n1_id"),
        Task("TWO", "A", "x", (("E", "out"), ("F", "out")), "n2_id", end="y"), Task("NEAR", "A", "x", (("E", "out"), ("F", "out")), "n1_id", form="near"), Task("FAR", "A", "x", (("E", "out"), ("F", "out")), "n2_name", most=3, form="far"),
    ]
    asked = spark.createDataFrame([(f"{t.id}{x}{y}", t.id, {"x": x, "y": y}) for t in tasks for x in "12349" for y in "139"], "question string, task_id string, parameters map<string,string>")
    expected = {r["question"]: r["reason"] for r in gold.validate(Graph(nodes, edges), tasks, asked).collect()}
    assert {r["question"]: r["reason"] for r in gold.reasons(Graph(nodes, edges), tasks, asked).collect()} == expected
    assert set(expected.values()) == {"ok", "no_results"}


def test_shares_send_no_table(spark, none_sent):
    shares = gold_queries.gold_validation(spark, FOLDER)
    assert "Broadcast" not in plan(shares)
    assert {r["split"] for r in shares.collect()} == {"dev", "test"}
