"""Nearest neighbours: exact scores, recall, ties, unusable vectors."""

import numpy as np
from pyspark.sql import functions as F

from helixgraph.llm import quantise


def exact(vectors, query, k):
    d = sorted((float(np.sqrt(((np.array(v, np.float32).astype(float) - np.array(vectors[query], np.float32).astype(float)) ** 2).sum())), i) for i, v in vectors.items() if i != query)
    return d[:k]


def run(spark, rows, k=10):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = {}
    for r in quantise.search(df, F.col("vec_id") % 100 == 0, k).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_and_scores(spark):
    r = np.random.default_rng(0)
    vectors = {i: r.normal(size=24).astype(np.float32).tolist() for i in range(1500)}
    got = run(spark, [(i, v, 0) for i, v in vectors.items()])
    hits = 0
    for q in got:
        want = exact(vectors, q, 10)
        hits += len({i for _, i in want} & {i for _, i in got[q]})
        assert all(abs(s - dict((b, a) for a, b in exact(vectors, q, 1500))[i]) < 1e-9 for s, i in got[q])
    assert len(got) == 15 and hits >= 0.95 * 150


def test_copies_ties_and_unusable_vectors(spark):
    base, nan, inf = [1.0, 2.0, 3.0], float("nan"), float("inf")
    rows = [(i, base, 0) for i in range(300)] + [(1000 + i, [float(i), 1.0, 0.5], 0) for i in range(1, 6)]
    rows += [(2000, None, 0), (2001, [0.0, 0.0, 0.0], 0), (2002, [1.0, None, 2.0], 0), (2003, [nan, 1.0, 1.0], 0), (2100, [inf, 1.0, 1.0], 0), (None, base, 0), (2004, [1.0], 0)]
    got = run(spark, rows)
    assert set(got) == {0, 100, 200}
    assert got[0] == [(0.0, i) for i in range(1, 11)] and got[100] == [(0.0, i) for i in range(10)]
    few = run(spark, [(0, base, 0), (1, [1.0, 2.0, 4.0], 0), (2, [1.0, 2.0, 2.0], 0)])
    assert few == {0: [(1.0, 1), (1.0, 2)]}
    assert run(spark, []) == {} and run(spark, [(1, base, 0)]) == {}


def test_recall_with_few_candidates(spark):
    """Candidates are 2 % of the rows."""
    r = np.random.default_rng(1)
    x = (r.normal(size=(60, 32))[r.integers(0, 60, 5000)] + 0.6 * r.normal(size=(5000, 32))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {}
    for row in quantise.search(df, F.col("vec_id") % 100 == 0, 10, candidates=100).collect():
        got.setdefault(row["query_id"], set()).add(row["vec_id"])
    hits = 0
    for q in got:
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert len(got) == 50 and hits >= 0.9 * 500


def test_repeated_ids_and_blocks(spark, monkeypatch):
    """An id counts once, with its least vector; many small blocks of queries, few and many shares of codes."""
    rows = [(5, [3.0, 3.0], 0), (5, [1.0, 1.0], 0), (5, [1.0, 1.0], 0), (0, [1.0, 2.0], 0), (0, [1.0, 2.0], 0), (7, [1.0, 4.0], 0)]
    assert run(spark, rows) == {0: [(1.0, 5), (2.0, 7)]}
    monkeypatch.setattr(quantise, "QUERY_BLOCK", 3)
    monkeypatch.setattr(quantise, "SEGMENT", 7)
    r = np.random.default_rng(2)
    vectors = {i: r.normal(size=4).astype(np.float32).tolist() for i in range(0, 4000, 10)}
    rows = [(i, v, 0) for i, v in vectors.items()]
    for most in (1 << 20, 20):
        monkeypatch.setattr(quantise, "SHARE", most)
        got = run(spark, rows, 3)
        assert len(got) == 40 and all([i for _, i in got[q]] == [i for _, i in exact(vectors, q, 3)] for q in got)


def test_names_that_clash(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], 1, 2, 3) for i in range(1, 102)], "vec_id long, embedding array<float>, class int, h int, place int")
    out = quantise.search(df, F.col("vec_id") == 100, 2).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(out)] == [(1, 99, 1.0), (2, 101, 1.0)]


def test_codes_are_dealt_once_whatever_the_number_of_blocks(spark):
    codes = spark.range(50).selectExpr("id AS segment", "cast('c' AS binary) AS classes", "cast(repeat('c', 1000) AS binary) AS codes", "cast('n' AS binary) AS norms")
    moved = {}
    for blocks in (4, 400):
        packed = spark.range(blocks).selectExpr("cast(id AS int) AS block", "array(named_struct('class', id, 'vector', array(1.0f))) AS asked")
        dealt = quantise._dealt(codes, packed, 5, 2)
        moved[blocks] = dealt.selectExpr("sum(length(codes))").first()[0]
        pairs = dealt.filter("block >= 0").groupBy("share", "block").count()
        assert pairs.count() == 5 * blocks and pairs.filter("count > 1").isEmpty()
    assert moved[4] == moved[400] == 2 * 50 * 1000
