"""Gold answers of stored questions by hand, wrong questions included."""

import pytest

from helixgraph.operators import gold
from helixgraph.operators.gold import Task, falling
from helixgraph.operators.pattern import Edge, Graph

TASKS = [
    Task("T-BEST", "G", "gene", (("R", "out"),), "n1_name", by=falling("e1_score")),
    Task("T-HIGH", "G", "gene", (("R", "out"),), "n1_name", where="e1_score > 0.3", most=2),
    Task("T-COUNT", "D", "disease", (("R", "in"),), "n1_id", count=True),
    Task("T-SCORE", "G", "gene", (("R", "out"),), "e1_score", end="disease"),
    Task("T-SHARED", "D", "disease", (("R", "in"), ("R", "out")), "n1_id", end="other", most=5),
]


@pytest.fixture(scope="module")
def graph(spark):
    nodes = {"G": spark.createDataFrame([(1, "g1"), (2, "g2"), (3, "g3")], "id long, name string"), "D": spark.createDataFrame([("a", "A"), ("b", "B"), ("c", None)], "id string, name string")}
    edges = {"R": Edge(spark.createDataFrame([(1, "a", 0.5), (1, "b", None), (2, "a", 0.4), (2, "b", 0.9), (2, "c", 0.95)], "src long, dst string, score double"), "G", "D")}
    return Graph(nodes, edges)


def judged(spark, graph, rows):
    asked = spark.createDataFrame(rows, "question string, task_id string, parameters map<string,string>, answer string")
    return {r["question"]: (r["answer"], r["reason"]) for r in gold.validate(graph, TASKS, asked.drop("answer")).collect()}


def test_answers_and_reasons(spark, graph):
    rows = [
        ("q1", "T-BEST", {"gene": "1"}, None),  # a null score is the highest
        ("q2", "T-BEST", {"gene": "2"}, None),  # its best disease has no name
        ("q3", "T-BEST", {"gene": "3"}, None),
        ("q4", "T-BEST", {"gene": "x"}, None),
        ("q5", "T-HIGH", {"gene": "2"}, None),
        ("q6", "T-COUNT", {"disease": "a"}, None),
        ("q7", "T-COUNT", {"disease": "zz"}, None),
        ("q8", "T-SCORE", {"gene": "2", "disease": "b"}, None),
        ("q9", "T-SCORE", {"gene": "1", "disease": "b"}, None),
        ("q10", "T-SCORE", {"gene": "1"}, None),
        ("q11", "T-SHARED", {"disease": "a", "other": "b"}, None),
        ("q12", "T-SHARED", {"disease": "a", "other": "a"}, None),  # one edge isn't there and back
        ("q13", "NONE", {}, None),
        ("q14", "T-COUNT", None, None),
    ]
    got = judged(spark, graph, rows)
    assert got == {
        "q1": ("B", "ok"), "q2": (None, "null_answer"), "q3": (None, "no_results"), "q4": (None, "no_results"), "q5": ("A,B", "ok"), "q6": ("2", "ok"), "q7": ("0", "ok"), "q8": ("0.9", "ok"),
        "q9": (None, "null_answer"), "q10": (None, "missing_parameter"), "q11": ("1,2", "ok"), "q12": (None, "no_results"), "q13": (None, "unknown_task"), "q14": (None, "missing_parameter"),
    }


def test_shares_and_no_questions(spark, graph):
    schema = "question string, task_id string, parameters map<string,string>, split string"
    asked = spark.createDataFrame([("q1", "T-COUNT", {"disease": "a"}, "dev"), ("q2", "T-BEST", {"gene": "3"}, "dev"), ("q3", "NONE", {}, "test")], schema)
    out = {(r["split"], r["task_id"]): (r["questions"], r["valid"], r["pct"]) for r in gold.shares(gold.validate(graph, TASKS, asked), ["split", "task_id"]).collect()}
    assert out["dev", None] == (2, 1, 50.0) and out["dev", "T-COUNT"] == (1, 1, 100.0) and out["test", None] == (1, 0, 0.0)
    assert gold.validate(graph, TASKS, asked.limit(0)).collect() == []


def test_tasks_of_a_shape_share_their_joins(spark, graph):
    asked = spark.createDataFrame([("q", "T-BEST", {"gene": "1"})], "question string, task_id string, parameters map<string,string>")
    one = gold._matched(graph, TASKS[:1], asked)._jdf.queryExecution().optimizedPlan().toString().count("Join")
    two = gold._matched(graph, TASKS[:2], asked)._jdf.queryExecution().optimizedPlan().toString().count("Join")
    assert one == two


def test_reasons_need_no_answers(spark, graph):
    """The same verdicts, and no row that lists or orders a question's values."""
    texts = Graph(
        {"A": spark.createDataFrame([(i, "x") for i in range(1, 8)], "id long, name string"), "B": spark.createDataFrame([(1, ""), (2, "b"), (3, None), (4, "d")], "id long, name string")},
        {
            "E": Edge(spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.5), (2, 2, 0.5), (3, 3, 0.9), (3, 2, 0.1), (4, 3, 0.2), (4, 2, 0.2), (5, 1, 0.1), (5, 4, 0.7), (6, 9, 0.7)], "src long, dst long, score double"), "A", "B"),
            "F": Edge(spark.createDataFrame([(2, 1, 0.3), (2, 2, None), (3, 3, 0.3), (4, 7, 0.1)], "src long, dst long, score double"), "B", "B"),
        },
    )
    far = (("E", "out"), ("F", "out"))
    tasks = [
        Task("LIST", "A", "a", far[:1], "n1_name", most=5), Task("ANY", "A", "a", far[:1], "n1_name"), Task("BEST", "A", "a", far[:1], "n1_name", by=falling("e1_score")),
        Task("SOME", "A", "a", far[:1], "n1_name", where="e1_score > 0.4", most=3), Task("N", "A", "a", far[:1], "n1_id", count=True), Task("PAIR", "A", "a", far[:1], "n1_name", end="b"),
        Task("NEAR", "A", "a", far, "n1_name", form="near"), Task("FAR", "A", "a", far, "n2_name", most=2, form="far"), Task("WHOLE", "A", "a", far, "n2_name", by=falling("e2_score")),
        Task("APART", "A", "a", far, "concat(n1_id, n2_name)", by=falling("e2_score"), most=2, form="apart"), Task("FIRST", "A", "a", far, "concat(n1_id, n2_name)", by=falling("e2_score"), form="apart"),
    ]
    rows = [(f"{t}{a}-{b}", t, {"a": a, "b": b}) for t in [*(t.id for t in tasks), "NONE"] for a in ["1", "2", "3", "4", "5", "6", "7", "04", "x"] for b in ("1", "2", "3", "9")]
    rows += [(f"{t.id}?", t.id, {"b": "1"}) for t in tasks] + [(f"{t.id}!", t.id, None) for t in tasks] + [("PAIR~", "PAIR", {"a": "1"})]
    asked = spark.createDataFrame(rows, "question string, task_id string, parameters map<string,string>")
    expected = {r["question"]: (r["reason"], r["valid"]) for r in gold.validate(texts, tasks, asked).collect()}
    found = gold.reasons(texts, tasks, asked)
    assert {r["question"]: (r["reason"], r["valid"]) for r in found.collect()} == expected and len(expected) == len(rows)
    assert {x for x, _ in expected.values()} == {"ok", "null_answer", "no_results", "missing_parameter", "unknown_task"}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "collect_list" not in plan
