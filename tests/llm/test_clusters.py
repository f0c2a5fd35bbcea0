"""Clusters over bit planes against plain integer arithmetic."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixgraph.llm import clusters


def mark():
    return F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)


def brute(rows, k, rounds):
    kept = [(i, [math.floor(256 * x) if abs(x) < 1e300 else x.as_integer_ratio()[0] * 256 for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest())[:k]
    centroids = [v for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for n in range(len(centroids)):
            own = [v for (_, v), (_, m) in zip(kept, found) if m == n]
            if own:
                centroids[n] = [sum(c) // len(own) for c in zip(*own)]
    return sorted((i if i is not None else -1, n, d if d < 1 << 63 else None) for (i, _), (d, n) in zip(kept, assign())), centroids


def run(spark, rows, k, rounds, more=""):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found, centroids = clusters.cluster(df, "vec_id", "embedding", mark(), k, rounds)
    got = sorted((-1 if r["vec_id"] is None else r["vec_id"], r["cluster"], r["distance"]) for r in found.collect())
    return got, centroids


def vectors(n, scale, seed):
    draw = random.Random(seed)
    return [(i, [draw.gauss(0, scale) for _ in range(64)]) for i in range(n)]


@pytest.mark.parametrize("scale", [0.2, 1000.0, 1e15])
def test_equals_integer_arithmetic(spark, scale):
    rows = vectors(90, scale, 5)
    assert run(spark, rows, 7, 3) == brute(rows, 7, 3)


def test_left_out_ties_and_repeats(spark):
    same = [0.5] * 64
    rows = [*vectors(12, 0.1, 1), (50, same), (51, same), (51, same), (None, same), (60, None), (61, []), (62, [1.0] * 63), (63, [1.0] * 65), (64, [None] + [1.0] * 63), (65, [float("nan")] + [1.0] * 63), (66, [float("inf")] + [1.0] * 63), (67, [0.0] * 64)]
    got, centroids = run(spark, rows, 5, 4)
    assert (got, centroids) == brute(rows, 5, 4)
    assert len(got) == 17


def test_mixed_sizes_of_numbers(spark):
    rows = [*vectors(20, 0.1, 2), *((100 + i, v) for i, v in vectors(6, 1e12, 3)), (200, [1e305] * 64), (201, [-1e305] + [0.25] * 63)]
    got, centroids = run(spark, rows, 6, 3)
    assert (got, centroids) == brute(rows, 6, 3)


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = vectors(3, 0.1, 4)
    assert run(spark, rows, 40, 5) == brute(rows, 40, 5)
    assert run(spark, [], 40, 5) == ([], [])


def test_clashing_columns_and_inertia(spark):
    rows = vectors(30, 0.3, 6)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, cluster string, planes int")
    out = clusters.with_inertia(*clusters.cluster(df, "vec_id", "embedding", mark(), 4, 2)).collect()
    narrow = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    expected, centroids = brute(narrow, 4, 2)
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in out) == expected
    assert {r["inertia"] for r in out} == {sum(d for _, _, d in expected)}
    for r in out:
        assert r["cluster_inertia"] == sum(d for _, c, d in expected if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()


def test_dot_products_of_planes():
    draw = random.Random(9)
    a = [[draw.randint(-(1 << 70), 1 << 70) for _ in range(64)] for _ in range(3)]
    b = [[draw.randint(-300, 300) for _ in range(64)] for _ in range(4)]
    found = clusters.dot(clusters.pack(np.array(a, dtype=object)), clusters.pack(np.array(b)))
    assert found.tolist() == [[sum(x * y for x, y in zip(v, w)) for w in b] for v in a]
