"""An edge is taken once in a match; walks against enumeration."""

import itertools
import random

import pytest

from helixgraph.operators.pattern import Edge, Graph, numbered, reach_counts


def graph(spark, pairs):
    nodes = spark.createDataFrame([(i, f"n{i}") for i in sorted({x for p in pairs for x in p})], "id long, name string")
    edges = spark.createDataFrame([(a, b, i % 2) for i, (a, b) in enumerate(pairs)], "src long, dst long, w int")
    return Graph({"N": nodes}, {"E": Edge(numbered(edges), "N", "N")})


def walks(pairs, hops, both):
    steps = [(i, a, b) for i, (a, b) in enumerate(pairs)]
    if both:
        steps += [(i, b, a) for i, a, b in steps if a != b]
    found = []
    for path in itertools.product(steps, repeat=hops):
        if all(x[2] == y[1] for x, y in zip(path, path[1:])) and len({s[0] for s in path}) == hops:
            found.append((path[0][1], *(s[2] for s in path)))
    return sorted(found)


PAIRS = {
    "opposite": [(1, 2), (2, 1)],
    "parallel": [(1, 2), (1, 2), (2, 3)],
    "loops": [(1, 1), (1, 2), (2, 2), (2, 2)],
    "many": [(random.Random(5).randint(1, 5), x % 5 + 1) for x in range(11)],
}


@pytest.mark.parametrize("both", [False, True])
@pytest.mark.parametrize("name", sorted(PAIRS))
def test_walks(spark, name, both):
    g, direction = graph(spark, PAIRS[name]), "both" if both else "out"
    p = g.match("N", "a").hop("a", "E", "e", "b", direction).hop("b", "E", "f", "c", direction)
    assert sorted(tuple(r) for r in p.select("a_id", "b_id", "c_id").collect()) == walks(PAIRS[name], 2, both)
    p = p.hop("c", "E", "g", "d", direction)
    assert sorted(tuple(r) for r in p.select("a_id", "b_id", "c_id", "d_id").collect()) == walks(PAIRS[name], 3, both)


def test_a_further_match_may_take_the_edge_again(spark):
    g = graph(spark, [(1, 2)])
    once = g.match("N", "a").hop("a", "E", "e", "b", "both")
    assert once.hop("b", "E", "f", "c", "both").rows.count() == 0
    assert once.again().hop("b", "E", "f", "c", "both").rows.count() == 2
    kept = once.hop("b", "E", "f", "c", "both", optional=True)
    assert sorted(tuple(r) for r in kept.select("a_id", "c_id").collect()) == [(1, None), (2, None)]
    ring = graph(spark, [(1, 2), (2, 1)]).match("N", "a").hop("a", "E", "e", "b").hop("b", "E", "f", "a")
    assert ring.rows.count() == 2


def test_reach_counts(spark):
    draw = random.Random(8)
    first = [(draw.randint(1, 6), draw.randint(1, 9)) for _ in range(30)]
    second = [(draw.randint(1, 9), f"t{draw.randint(1, 200)}") for _ in range(400)]
    numbers = [(f"t{i}", i * 5 if i % 2 else (1 << 33) + i) for i in range(1, 201)]
    out = reach_counts(spark.createDataFrame(first, "src long, dst long"), spark.createDataFrame(second, "src long, dst string"), spark.createDataFrame(numbers, "dst string, number long"))
    expected = {s: len({t for a, m in first if a == s for b, t in second if b == m}) for s, _ in first}
    assert {r["src"]: r["n"] for r in out.collect()} == expected
