"""Runs killed at every step and repeated equal one run."""

import pytest
from pyspark.errors import PySparkException

from helixgraph.sources import results


def rows(spark, *pairs):
    return spark.createDataFrame(pairs, "model string, q long")


def seen(spark, path):
    return sorted((tuple(r) for r in results.read_runs(spark, path).select("run", "model", "q").collect()), key=str)


def test_killed_and_repeated(spark, tmp_path):
    path = str(tmp_path)
    first = rows(spark, ("m", 1), ("m", 1), ("n", 2))  # repeated rows are rows of their own
    with pytest.raises(PySparkException):  # killed while tasks write
        results.write_run(first.selectExpr("model", "if(q = 2, raise_error('lost'), q) AS q"), path, "01")
    results.stage(first, path, "01")  # killed before the manifest
    assert not results.committed(spark, path, "01") and seen(spark, path) == []
    assert results.write_run(first, path, "01") and not results.write_run(first, path, "01")
    once = [("01", "m", 1), ("01", "m", 1), ("01", "n", 2)]
    assert seen(spark, path) == once
    results.stage(rows(spark, ("x", 9)), path, "01")  # a replacement killed before its manifest
    assert seen(spark, path) == once
    assert results.write_run(rows(spark, ("z", 3)), path, "01", replace=True)
    assert results.write_run(rows(spark, ("k", 4)), path, "02")
    assert seen(spark, path) == [("01", "z", 3), ("02", "k", 4)]


def test_remaining_and_edges(spark, tmp_path):
    path = str(tmp_path)
    wanted = rows(spark, ("m", 1), ("n", 2), (None, 3))
    assert results.remaining(wanted, path, ["model", "q"]).count() == 3
    results.stage(wanted, path, "a")
    assert results.remaining(wanted, path, ["model", "q"]).count() == 3
    assert results.write_run(wanted.filter("q <> 2"), path, "a") and results.write_run(wanted.limit(0), path, "b")
    assert [r["q"] for r in results.remaining(wanted, path, ["model", "q"]).collect()] == [2]
    assert results.committed(spark, path, "b") and len(seen(spark, path)) == 2
    with pytest.raises(ValueError):
        results.write_run(wanted.selectExpr("q", "model AS Run"), path, "c")
    with pytest.raises(FileNotFoundError):
        results.read_runs(spark, f"{path}/nowhere")
    assert results.write_run(wanted.limit(0), f"{path}/first", "empty")  # a first run without rows
