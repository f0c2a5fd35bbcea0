"""Distinct values over two hops as bits, and buckets that grow in number with the rows."""

from helixgraph.operators.pattern import reached
from helixgraph.sources.graph_store import buckets_for


def plain(first, second, most):
    out = {}
    for s, d in first:
        out.setdefault(s, set()).update(v for m, v in second if m == d)
    rows = {s: (len(v), sorted(x for x in v if x is not None)) for s, v in out.items() if v}
    return {s: (n, len(known), ",".join(known[:most])) for s, (n, known) in rows.items()}


def test_either_side_as_bits(spark):
    for sources, values in ((300, 140), (20, 500)):  # values as bits, then sources
        first = [(a, a * b % 11) for a in range(sources) for b in range(1, 4)]
        second = [(m, None if v % 130 == 7 else f"v{v}") for m in range(10) for v in range(m, values, 3)]
        rows = reached(spark.createDataFrame(first, "src long, dst long"), spark.createDataFrame(second, "src long, value string"), 5).collect()
        assert {r["src"]: (r["matches"], r["known"], r["found"]) for r in rows} == plain(first, second, 5)


def test_buckets(spark):
    assert buckets_for(0) == buckets_for(8_000_000) == 8
    assert buckets_for(36_000_001) == 37
