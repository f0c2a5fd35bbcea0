"""The grammar's machines, and held-out accuracy on the given labels."""

import random

from helixgraph.llm import queries, toxicity
from helixgraph.llm.common import documents


def kinds(text):
    matcher = toxicity.Model({"idiot": 2.0}, {"moro": 3.0}).matcher()
    f = matcher.features(text)
    return {k for k, v in zip(toxicity.KINDS, f) if v}


def test_composition_scores_clauses():
    assert kinds("what an idiot") == {"insult"}
    assert kinds("you absolute idiot") == {"targeted"}
    assert kinds("this is not an idiot") == {"negated"}
    assert kinds("not so. An idiot") == {"insult"} and kinds("not so, an idiot") == {"insult"}  # the clause ends the negation
    assert kinds("not one two three four idiot") == {"insult"}  # out of reach
    assert kinds("such idiot moron") == {"strong_insult"} and kinds("such an idiot") == {"insult"}
    assert kinds("idiot, moron") == {"insult"}
    assert kinds("the idiot you are") == {"insult", "targeted"}
    assert kinds("she said what an idiot") == {"reported"}
    assert kinds("she said he is not an idiot") == {"negated"}
    assert kinds("he said: what an idiot") == kinds("he said, what an idiot") == kinds('he said, "well, well, idiot"') == {"reported"}
    assert kinds('he said "well", now, idiot') == {"insult"}  # the quotation has ended
    assert kinds("he said it, and so on, idiot") == {"insult"} and kinds("he said it. Idiot") == {"insult"}
    assert kinds("fires kill") == {"violence"} and kinds("I will soon kill") == {"threat"}
    assert kinds("I will kill you") == {"threat", "direct_threat"} and kinds("you they kill") == {"threat"}
    assert kinds("I will not kill you") == {"negated"} and kinds("she said I will kill you") == {"reported"}
    assert kinds("morons everywhere") == {"insult"} and kinds("sidiotic") == set()
    assert kinds("") == set() and kinds(", \" : idiot") == {"insult"}


def test_composition_equals_the_machines_in_turn():
    """The composed machine says of random words what the five say one after another."""
    rules = (toxicity.insults, toxicity.threats, toxicity.negation, toxicity.reported, toxicity.targets)
    r = random.Random(1)
    for _ in range(400):
        words = r.choices(toxicity.INPUTS, k=r.randint(1, 25))
        want = words
        for rule in rules:
            state, out = ("none", 0), []
            for w in want:
                name, left, o = rule(*state, w)
                state = (name, left)
                out.append(o)
            want = out
        state, got = 0, []
        for w in words:
            state, o = toxicity.grammar().arcs[state, w]
            got.append(o)
        assert got == want


def test_machine_is_total():
    machine = toxicity.grammar()
    states = {s for s, _ in machine.arcs}
    assert {s for s, _ in machine.arcs.values()} <= states


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs = documents(spark, folder)
    scored = queries.op3_toxicity_grammar(spark, folder)
    assert scored.count() == docs.count()
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = scored.join(labels, "doc_id").filter("held_out").selectExpr("avg(cast(predicted = toxic as double)) AS accuracy", "min(score) AS lo", "max(score) AS hi").first()
    assert held["accuracy"] >= 0.97 and 0 <= held["lo"] <= held["hi"] <= 1


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 5.0), (2, "", 5.0), (3, "idiot " * 50_000, 5.0), (None, "x", 5.0), (3, "idiot", 5.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, none)
    out = toxicity.score(docs, model).collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 for r in out)
    one_class = toxicity.train(docs, spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int"))
    assert not one_class.words
    assert toxicity.score(docs.limit(0), model).collect() == []
    kept = toxicity.keep_clean(docs, toxicity.Model({"idiot": 5.0}, {}, [-3.0, 9.0, 9.0] + [0.0] * 7))
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2]
