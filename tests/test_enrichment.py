"""Hypergeometric tails against whole-number arithmetic, adjustment against its definition, over several runs of the order."""

import math
import random
from fractions import Fraction

from pyspark.sql import functions as F

from helixgraph.operators import enrichment as E


def tail(k, term, drawn, universe):
    ways = sum(math.comb(term, i) * math.comb(universe - term, drawn - i) for i in range(k, min(term, drawn) + 1))
    return float(Fraction(ways, math.comb(universe, drawn)))


def test_stirling_error(spark):
    rows = spark.range(1, 40).select("id", E.stirling_error(F.col("id")).alias("x")).collect()
    for r in rows:
        n = r["id"]
        assert abs(r["x"] - (math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi))) < 1e-13


def test_upper_tail(spark):
    rng = random.Random(3)
    cases = [(0, 5, 5, 10), (5, 5, 5, 10), (6, 5, 5, 10), (3, 0, 4, 9), (0, 0, 0, 0), (2, 9, 9, 10), (8, 9, 9, 10), (9, 9, 9, 10), (40, 300, 900, 20000), (200, 300, 900, 20000)]
    for _ in range(300):
        n = rng.randint(1, 2000)
        a, b = rng.randint(0, n), rng.randint(0, n)
        cases.append((rng.randint(0, min(a, b) + 1), a, b, n))
    df = spark.createDataFrame(cases, "k long, a long, b long, n long").withColumn("p", E.upper_tail(*map(F.col, "kabn")))
    for r in df.collect():
        assert math.isclose(r["p"], tail(r["k"], r["a"], r["b"], r["n"]), rel_tol=1e-11, abs_tol=1e-300), r
    odd = spark.createDataFrame([(1, 5, 5, 4), (None, 1, 1, 9), (-1, 1, 1, 9)], "k long, a long, b long, n long")
    assert [r["p"] for r in odd.select(E.upper_tail(*map(F.col, "kabn")).alias("p")).collect()] == [None] * 3


def test_adjusted(spark):
    rng = random.Random(5)
    rows = [("x", f"t{i:03}", rng.choice([0.001, 0.01, 0.2, rng.random()])) for i in range(300)] + [("y", "only", 0.04), ("y", "none", None)]
    got = {(r["library"], r["term_name"]): r["adjusted"] for r in E.adjusted(spark.createDataFrame(rows, "library string, term_name string, p double"), "library").collect()}
    assert len(got) == len(rows) and got["y", "only"] == 0.04 and got["y", "none"] is None
    order = sorted((p, t) for lib, t, p in rows if lib == "x")
    least = 1.0
    for i in range(len(order), 0, -1):
        least = min(least, order[i - 1][0] * len(order) / i)
        assert math.isclose(got["x", order[i - 1][1]], least, rel_tol=1e-12)


def test_enrich_edges(spark):
    genes = spark.createDataFrame([(f"g{i}",) for i in range(10)] + [(None,), ("g1",)], "gene string")
    terms = spark.createDataFrame([("L", "A", "g1"), ("L", "A", "g1"), ("L", "A", "g2"), ("L", "B", "g9"), ("L", "C", "strange"), ("L", "A", None)], "library string, term_name string, gene string")
    asked = spark.createDataFrame([("g1",), ("g2",), ("g2",), ("nowhere",)], "gene string")
    got = {r["term_name"]: r for r in E.enrich(terms, asked, genes).collect()}
    assert set(got) == {"A", "B"} and (got["A"]["term"], got["A"]["hits"], got["A"]["drawn"], got["A"]["universe"]) == (2, 2, 2, 10)
    assert math.isclose(got["A"]["p"], 1 / 45) and got["B"]["p"] == 1.0 and math.isclose(got["A"]["adjusted"], 2 / 45)
    assert E.enrich(terms.limit(0), asked, genes).count() == 0
