"""Tasks whose paths aren't rows answer as those whose paths are."""

from dataclasses import replace

import pytest

from helixgraph.operators import gold
from helixgraph.operators.gold import Task, falling
from helixgraph.operators.pattern import Edge, Graph

PARAMETERS = "question string, task_id string, parameters map<string,string>"


@pytest.fixture(scope="module")
def graph(spark):
    nodes = {
        "A": spark.createDataFrame([(i,) for i in range(12)], "id long"),
        "B": spark.createDataFrame([(i,) for i in range(9)], "id long"),
        "C": spark.createDataFrame([(i, None if i % 40 == 7 else f"c{i % 90}") for i in range(100)], "id long, name string"),
    }
    near = [(a, (a * b + b) % 10) for a in range(11) for b in range(5)]  # pairs come twice, some ends are no nodes
    far = [(b, (b * 31 + k * k) % 103, None if k % 9 == 0 else float(k % 4)) for b in range(9) for k in range(25)]
    return Graph(nodes, {"E": Edge(spark.createDataFrame(near, "src long, dst long"), "A", "B"), "F": Edge(spark.createDataFrame(far, "src long, dst long, score double"), "B", "C")})


def told(spark, graph, task, least):
    asked = spark.createDataFrame([(f"q{i}", task.id, {"a": i}) for i in [*map(str, range(least, 14)), "x", "3"]] + [("none", task.id, None)], PARAMETERS)
    return sorted((r["question"], r["answer"] or "", r["matches"]) for r in gold.answers(graph, [task], asked).collect())


@pytest.mark.parametrize("form, answer, by", [("near", "n1_id", "0D"), ("far", "n2_name", "0D"), ("apart", "concat(n1_id, ' ', n2_name)", falling("e2_score"))])
@pytest.mark.parametrize("most", [1, 40])
def test_forms(spark, graph, form, answer, by, most):
    plain = Task("T", "A", "a", (("E", "out"), ("F", "out")), answer, by=by, most=most)
    expected = told(spark, graph, plain, 0)
    assert len(expected) > 8
    assert told(spark, graph, replace(plain, form=form), 0) == expected


def test_more_sources_than_values(spark):
    nodes = {"A": spark.createDataFrame([(i,) for i in range(200)], "id long"), "B": spark.createDataFrame([(0,), (1,)], "id long"), "C": spark.createDataFrame([(i, None if i == 5 else f"n{i}") for i in range(150)], "id long, name string")}
    edges = {"E": Edge(spark.createDataFrame([(a, a % 2) for a in range(200)] + [(7, 0)], "src long, dst long"), "A", "B"), "F": Edge(spark.createDataFrame([(c % 2, c) for c in range(150)], "src long, dst long"), "B", "C")}
    plain = Task("T", "A", "a", (("E", "out"), ("F", "out")), "n2_name", most=5)
    asked = spark.createDataFrame([(f"q{i}", "T", {"a": str(i)}) for i in range(200)], PARAMETERS)
    both = [sorted(map(tuple, gold.answers(Graph(nodes, edges), [t], asked).collect())) for t in (plain, replace(plain, form="far"))]
    assert both[0] == both[1] and len(both[0]) == 200


def test_forms_that_do_not_fit(spark, graph):
    asked = spark.createDataFrame([("q", "T", {"a": "1"})], PARAMETERS)
    with pytest.raises(ValueError):
        gold.answers(graph, [Task("T", "A", "a", (("E", "out"), ("F", "out")), "n2_name", count=True, form="far")], asked)
