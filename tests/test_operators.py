"""Edge cases of the operators on small literal tables."""

import json

import pytest
from pyspark.sql import functions as F

from helixgraph.functions import text as X
from helixgraph.operators import benchmarks, metrics, variants
from helixgraph.operators.pattern import Edge, Graph, desc_like_graph
from helixgraph.sources import readers


@pytest.fixture(scope="module")
def graph(spark):
    nodes = {"A": spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "id long, name string"), "B": spark.createDataFrame([(10, "x")], "id long, name string")}
    edges = {
        "T": Edge(spark.createDataFrame([(1, 2, 0.5), (2, 3, None), (3, 3, 0.9), (1, 2, 0.1)], "src long, dst long, score double"), "A", "A"),
        "U": Edge(spark.createDataFrame([(1, 10)], "src long, dst long"), "A", "B"),
    }
    return Graph(nodes, edges)


def test_hops(graph):
    assert graph.match("A", "a").hop("a", "T", "e", "b").rows.count() == 4  # parallel edges count
    both = graph.match("A", "a").hop("a", "T", "e", "b", "both").rows
    assert both.count() == 7  # the self-loop once
    left = graph.match("A", "a").hop("a", "T", "e", "b", optional=True, condition="e_score > 0.8").rows
    assert left.count() == 4 and left.filter("b_id IS NOT NULL").count() == 1
    assert graph.match("A", "a").exists("a", "T").rows.count() == 3
    assert [r["a_id"] for r in graph.match("A", "a").exists("a", "T", negate=True).rows.collect()] == [4]
    first = graph.match("A", "a").hop("a", "T", "e", "b")
    assert first.hop("b", "T", "f", "c").rows.count() == 3 and first.again().hop("b", "T", "f", "c").rows.count() == 4


def test_degrees_and_null_order(graph, spark):
    degrees = {(r["label"], r["id"]): r["degree"] for r in graph.degrees().collect()}
    assert degrees == {("A", "1"): 3, ("A", "2"): 3, ("A", "3"): 2, ("A", "4"): 0, ("B", "10"): 1}
    rows = graph.edges["T"].table.orderBy(desc_like_graph("score")).collect()
    assert rows[0]["score"] is None and rows[1]["score"] == 0.9


def test_variant_rules(spark):
    df = spark.createDataFrame([("r1", 1e-9, 0.001, 0.1, 9.0, -1.0, 0.4), ("r2", 5e-8, 0.5, 0.0, 7.3, -1.0, -1.0), ("r3", 0.0, None, -1.0, 20.0, 0.2, 0.4)], "rsid string, p double, maf double, beta double, neglog10p double, s double, f double")
    assert [r["rsid"] for r in variants.significant(df).collect()] == ["r1", "r3"]
    assert [r["rsid"] for r in variants.usual_frequency(df).collect()] == ["r1", "r2"]
    assert variants.usual_frequency(df.drop("maf")).count() == 3
    scored = {r["rsid"]: r for r in variants.scored(df, ["s", "f"]).collect()}
    assert scored["r1"]["causal_score"] == 0.4 and scored["r1"]["n_valid"] == 1
    assert scored["r2"]["causal_score"] == 0 and scored["r2"]["n_valid"] == 0
    assert scored["r3"]["evidence_score"] == 1.0 and abs(scored["r3"]["risk_score"] - (0.3 + 0.7 * 0.3)) < 1e-12
    constant = variants.min_max(spark.createDataFrame([(3.0,), (3.0,)], "x double"), "x", "y")
    assert {r["y"] for r in constant.collect()} == {0.0}
    aliased = variants.with_aliases(spark.createDataFrame([(1, 2)], "x_id long, bp long"), {"x_id": "rsid", "position": "bp"})
    assert aliased.columns == ["x_id", "bp", "rsid"]


def test_range_join_finds_all_pairs(spark):
    points = [(1, p) for p in (0, 95, 100, 150, 260, 400)]
    spans = [("g1", 1, 100, 150), ("g2", 1, 140, 300), ("g3", 2, 0, 500)]
    p = spark.createDataFrame(points, "chr int, bp long")
    s = spark.createDataFrame(spans, "gene string, chr int, start long, end long")
    for window in (7, 50, 1000):
        got = sorted((r["bp"], r["gene"], r["distance_to_gene"]) for r in variants.near_genes(p, s, window).collect())
        expected = sorted((b, g, max(a - b, b - e, 0)) for c, b in points for g, d, a, e in spans if c == d and max(a - b, b - e, 0) <= window)
        assert got == expected


def test_text_functions(spark):
    rows = [("THE ANSWER IS C", "know"), ("", None), ("I am not sure. 85% yes", "1) one, 2) two,,"), ("Probably B.", "x\ny")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(X.parse_choice_prefix(F.col("a")).alias("p"), X.parse_choice(F.col("a")).alias("c"), X.parse_yes_no(F.col("b")).alias("y"), X.abstains(F.col("a")).alias("ab"), X.confidence(F.col("a")).alias("cf"), X.parse_list(F.col("b")).alias("l"), X.words(F.col("b")).alias("w")).collect()
    assert [r["p"] for r in got] == ["A", "A", "A", "A"]
    assert [r["c"] for r in got] == ["C", None, None, "B"]
    assert got[0]["y"] == "no" and got[1]["w"] == []
    assert [r["ab"] for r in got] == [False, True, False, False]
    assert [r["cf"] for r in got] == [0.75, 0.5, 0.4, 0.7]
    assert got[2]["l"] == ["one", "two"] and got[3]["l"] == ["x", "y"]
    assert X.lcs_f1([], ["a"]) == 0 and X.lcs_f1(list("abcd"), list("axcd")) == 0.75


def test_metrics(spark):
    df = spark.createDataFrame([("g", 1, 1), ("g", 1, 1), ("h", 0, 1), ("h", None, 1)], "k string, t int, p int")
    got = {r["k"]: r for r in metrics.class_metrics(df, ["k"], "t", "p").collect()}
    assert got["g"]["f1_macro"] == 1.0 and got["h"]["f1_macro"] == 0.0
    one = metrics.summary(spark.createDataFrame([("a", 0.5)], "k string, x double"), ["k"], "x").first()
    assert one["n"] == 1 and one["std"] is None
    ece = metrics.expected_calibration_error(spark.createDataFrame([(True, 100), (False, 0)], "c boolean, p int"), "c", "p").first()
    assert ece["ece"] == 0.0 and ece["bins"] == 2


def test_readers(spark, tmp_path):
    question = {"question": "q", "task_id": "S", "parameters": {"gene": "G"}, "options": ["a", "b"]}
    (tmp_path / "list.json").write_text(json.dumps([question, {"question": "r"}]))
    (tmp_path / "object.json").write_text(json.dumps({"questions": [question]}))
    assert readers.read_questions(spark, str(tmp_path / "*.json")).count() == 3
    (tmp_path / "v.tsv").write_text("\t".join(f.name for f in readers.VARIANT_SCHEMA.fields) + "\n1\t5\trs1\t0.1\tA\tC\t0.2\t0.1\t1e-9\t-1\t0.5\tm1\trs1\n")
    assert readers.read_members(spark, str(tmp_path / "v.tsv"), ["m1"]).first()["bp"] == 5
    assert readers.read_members(spark, str(tmp_path / "v.tsv"), ["m2"]).count() == 0
    (tmp_path / "cache.json").write_text(json.dumps({"G1": {"start": 1}, "G2": {"start": 2}}))
    from pyspark.sql import types as T

    cache = readers.cache_from_json(spark, str(tmp_path / "cache.json"), "gene", T.StructType().add("start", "long"))
    hits, misses = readers.read_through(spark.createDataFrame([("G1",), ("G3",)], "gene string"), cache, "gene")
    assert [r["start"] for r in hits.collect()] == [1] and [r["gene"] for r in misses.collect()] == ["G3"]
    results = spark.createDataFrame([("m", 1), ("n", 2)], "model string, q long")
    assert readers.missing_results(results, str(tmp_path / "out"), ["model", "q"]).count() == 2
    readers.append_results(results.filter("q = 1"), str(tmp_path / "out"))
    assert [r["q"] for r in readers.missing_results(results, str(tmp_path / "out"), ["model", "q"]).collect()] == [2]
    readers.write_delimited(spark.createDataFrame([(["a", "b"],)], "x array<string>"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["x"] == "a;b"
    readers.write_summary(results, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    nodes = spark.createDataFrame([("a<", "seed")], "id string, node_type string")
    edges = spark.createDataFrame([("a<", "b", 0.5)], "source string, target string, weight double")
    assert 'id="a&lt;"' in readers.graphml_elements(nodes, edges).first()["value"]


def test_questions(spark):
    templates = spark.createDataFrame([("t", "Is {gene} bad for {disease}?")], "task_id string, template string")
    samples = spark.createDataFrame([("t", 1, "d"), ("none", 2, "d")], "task_id string, gene long, disease string")
    assert [r["question"] for r in benchmarks.generate(templates, samples, ["gene", "disease"]).collect()] == ["Is 1 bad for d?"]
    answers = spark.createDataFrame([(1, None)], "gene long, answer string")
    checked = {r["gene"]: r["reason"] for r in benchmarks.validate(samples, answers, ["gene"], "answer").collect()}
    assert checked == {1: "null_answer", 2: "no_rows"}


def test_answers_and_datasets(spark):
    from helixgraph.functions import answers as A
    from helixgraph.sources import datasets

    assert A.find_query("Action: query_kg[MATCH (a)-[:T]->(b) RETURN collect(b)[0..3]]\nx") == "MATCH (a)-[:T]->(b) RETURN collect(b)[0..3]"
    assert A.find_query("Cypher: ```cypher\nMATCH (n) RETURN n```") == "MATCH (n) RETURN n"
    assert A.find_query("say MATCH (n) RETURN n LIMIT 5 and so on") == "MATCH (n) RETURN n LIMIT 5"
    assert A.find_query("nothing") is None and A.find_query(None) is None
    shaped = spark.createDataFrame([("GO:1", "name", "1"), ("tumour", None, "7"), (None, "n", "2")], "v string, n string, i string").select(A.shape_answer(F.col("v"), F.col("n"), F.col("i")).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in shaped] == [("GO:1", "name"), ("7", "tumour"), ("2", "n")]
    mcq = datasets.numbered(spark.createDataFrame([("q", "a", "b", "c", "d", 2)], "question string, opa string, opb string, opc string, opd string, cop int"), "x").first()
    assert mcq["answer"] == "C" and mcq["options"] == ["a", "b", "c", "d"]
    yes = datasets.decisions(spark.createDataFrame([("q", "Maybe"), ("r", "yes")], "question string, final_decision string"), "y").collect()
    assert [r["answer"] for r in yes] == ["no", "yes"]
    both = spark.createDataFrame([("q", {"B": "y", "A": "x"}, "B")], "question string, options map<string,string>, answer_idx string")
    assert datasets.keyed(both, "z").first()["options"] == ["x", "y"]
    many = spark.createDataFrame([(f"q{i}", "a" if i < 8 else "b") for i in range(10)], "question string, k string")
    assert datasets.balanced(many, "k", 2, 6).groupBy("k").count().collect() and datasets.balanced(many, "k", 2, 6).count() == 6
    text = spark.range(1).select(A.prompt(F.lit("why?"), F.array(F.lit("x"), F.lit("y")), "zero").alias("t")).first()["t"]
    assert text == "Question: why?\nA. x\nB. y\nAnswer with one letter."


def test_question_rules(spark):
    """Expected values by hand, from the rules' own words."""
    from helixgraph.functions import questions as P

    rows = [
        ("Which proteins are interacting with P68133?", "one-hop", "protein_interaction", "Protein", ["P68133"], None, "entity"),
        ("What diseases are associated with protein Q9NYB9-2?", "one-hop", "protein_disease", "Disease", ["Q9NYB9-2"], None, "entity"),
        ("Proteins P11111 and P22222 both act in which pathway?", "conjunction", "protein_pathway", "Pathway", ["P11111", "P22222"], None, "entity"),
        ("Is the molecular function of the protein translated from gene BRCA1 known?", "multi-hop", "protein_molecular_function", "Molecular_function", [], "BRCA1", "boolean"),
        ("The function that the gene tp53 has", "one-hop", "gene_molecular_function", "Molecular_function", [], "TP53", "entity"),
        ("How many genes are there?", "one-hop", "unknown", "Gene", [], None, "count"),
        ("List all the tissues", "one-hop", "unknown", "Tissue", [], None, "list"),
        ("", "one-hop", "unknown", "unknown", [], None, "unknown"),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "q string")
    q = F.col("q")
    got = df.select("q", P.kind(q), P.relation(q).alias("r"), P.target(P.relation(q), q), P.proteins(q), P.gene(q), P.answer_class(q)).collect()
    assert [tuple(r) for r in got] == rows
    one = spark.createDataFrame([("WHAT does GO:0008150 say of rs7412 in APOE AND TP53?",)], "q string").select(P.go_terms(q), P.rsids(q), P.gene_symbols(q)).first()
    assert list(one) == [["GO:0008150"], ["rs7412"], ["GO", "APOE", "TP53"]]


def test_abstention_and_confidence_rules(spark):
    rows = [
        ("It is not available.", True, 0.75),
        ("N/A", True, 0.75),
        ("Not sure, unclear.", False, 0.4),  # "clearly" isn't in it; "not sure" is
        ("Clearly BRCA1", False, 0.9),
        ("50% of cases", False, 0.75),  # no stated confidence
        ("BRCA1. Confidence: 85%", False, 0.85),
        ("confidence 0.3, certainly", False, 0.3),
        ("confidence: 1", False, 1.0),
        ("Unlikely, I think", False, 0.7),
        ("", True, 0.5),
        (None, True, 0.5),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "c string")
    assert [tuple(r) for r in df.select("c", X.abstains(F.col("c")), X.confidence(F.col("c"))).collect()] == rows


def test_queries_in_responses():
    from helixgraph.functions.answers import find_query

    assert find_query('x {"cypher": "MATCH (n {k: \\"v\\"}) RETURN n"} y') == 'MATCH (n {k: "v"}) RETURN n'
    assert find_query('{"a": [{"b": {"cypher": "MATCH (n)\\nRETURN n"}}]}') == "MATCH (n) RETURN n"
    assert find_query('{broken "cypher": MATCH (n) RETURN n LIMIT 3}') == "MATCH (n) RETURN n LIMIT 3"
    assert find_query("CYPHER: MATCH (n)\nRETURN n\nThought: done") == "MATCH (n) RETURN n"
    assert find_query("action: query_kg[MATCH (n {t: ']'}) RETURN n[0]] tail]") == "MATCH (n {t: ']'}) RETURN n[0]"
    assert find_query("Action: query_kg[MATCH (n RETURN") == "MATCH (n RETURN"  # open brackets: as a bare statement
    assert find_query("```cypher\nMATCH (n) RETURN n\n``` then MATCH") == "MATCH (n) RETURN n"
    assert find_query("rematch and return") is None and find_query("") is None


def test_entities_of_answers(spark):
    from helixgraph.functions import answers as A

    rows = [("The proteins are tumour protein (TP53), P04637 and the insulin or tumour protein",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "c string").select(A.entities(F.col("c"))).collect()]
    assert got == [["tumour protein", "TP53", "P04637", "the insulin"], [], []]
    words = spark.createDataFrame([(["a.", "B", ""], ["A", "c"]), ([], ["a"]), (["x"], [])], "p array<string>, g array<string>")
    assert [r[0] for r in words.select(A.partial_match(F.col("p"), F.col("g"))).collect()] == [0.5, 0.0, 0.0]
    assert [r[0] for r in words.select(A.open_recall(F.col("p"), F.col("g"))).collect()] == [0.0, 0.0, 0.0]


def test_streams_restart_and_stay_empty(spark, tmp_path):
    from helixgraph.streaming import ingest

    schema = "rsid string, gene long, bp long, beta double, p double, maf double, neglog10p double"
    new = lambda name, rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
    new("a", [("r1", 1, 1, 0.5, 1e-9, 0.1, 9.0), ("r2", 1, 2, 0.5, 1e-9, 0.1, 9.0)])
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    folder = str(tmp_path / "best")
    assert ingest.best_variants(stream(), folder).count() == 2
    new("b", [("r1", 2, 1, 0.5, 1e-12, 0.1, 12.0)])
    out = {r["rsid"]: r["gene"] for r in ingest.best_variants(stream(), folder).collect()}  # as after a restart
    assert out == {"r1": 2, "r2": 1}
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none"))
    assert ingest.best_variants(spark.readStream.schema(schema).parquet(str(tmp_path / "none"))).count() == 0
