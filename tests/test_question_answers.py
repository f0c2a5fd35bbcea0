"""Answers over two hops by sets of bits against plain joins."""

import random

from helixgraph.plans.question_queries import scored


def test_each_answer_comes_once(spark):
    draw = random.Random(4)
    edges = [(t, p, None if a == 7 else f"a{a}", 0.5 if t == "K" or a % 3 else a / 100) for t in ("K", "L") for p in range(9) for a in draw.sample(range(200), 70)] * 2
    asked = [(f"q{i}", draw.choice("KLM"), draw.randrange(11)) for i in range(40)]
    asked = [(i, k, q) for i, k, p in asked for q in {p, (p * 7 + 1) % 11, 3}]
    found = scored(spark.createDataFrame(asked, "id string, type string, protein int"), spark.createDataFrame(edges, "type string, protein int, answer string, score double"))
    expected = {(i, a, s) for i, k, p in asked for t, q, a, s in edges if (t, q) == (k, p)}
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == expected and len(rows) == len(expected) > 1000


def test_paths_do_not_move(spark):
    """A thousand proteins of a question with the same hundred answers: a hundred rows are made of them."""
    asked = spark.createDataFrame([("q", "K", p) for p in range(1000)], "id string, type string, protein int")
    edges = spark.range(100_000).selectExpr("'K' AS type", "CAST(id % 1000 AS INT) AS protein", "CAST(id DIV 1000 AS STRING) AS answer", "0.5D AS score")
    found = scored(asked, edges)
    assert found.count() == 100
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_or" in plan
