"""Hilbert sharding: the curve, balance, gapless slots and pruning."""

import zlib

import numpy as np
import pytest

from helixgraph.llm import hilbert, queries


def test_curve_visits_neighbours():
    for dimensions, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions, indexing="ij"), -1).reshape(-1, dimensions)
        index = hilbert.curve_index(grid, bits)
        assert sorted(index.tolist()) == list(range(len(grid)))
        steps = np.abs(np.diff(grid[np.argsort(index)], axis=0)).sum(1)
        assert (steps == 1).all()


def recursive_curve(bits):
    """Points of the plane's Hilbert curve in order, by four smaller curves, the first and last of them turned over."""
    if not bits:
        return [(0, 0)]
    half, small = 1 << (bits - 1), recursive_curve(bits - 1)
    first = [(y, x) for x, y in small]
    last = [(2 * half - 1 - y, half - 1 - x) for x, y in small]
    return first + [(x, y + half) for x, y in small] + [(x + half, y + half) for x, y in small] + last


def test_plane_curve_equals_the_recursive_one():
    for bits in (1, 2, 3, 5):
        points = recursive_curve(bits)
        index = hilbert.curve_index(np.array(points), bits).tolist()
        mirrored = hilbert.curve_index(np.array([(y, x) for x, y in points]), bits).tolist()
        assert list(range(len(points))) in (index, mirrored)


def test_shards(spark, tmp_path):
    rows = [(i, "x" * (i % 50), ["en", "de", None][i % 3], f"s{i % 7}") for i in range(500)] + [(None, None, None, None), (3, "same", "en", "s1"), (3, "same", "en", "s1")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op7_hilbert_shards(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r)
    counts = [len(v) for v in by.values()]
    assert sorted(by) == list(range(16)) and max(counts) - min(counts) <= 1
    last = -1
    for k in sorted(by):
        v = sorted(by[k], key=lambda r: r["slot"])
        assert [r["slot"] for r in v] == list(range(len(v)))
        assert [r["curve_index"] for r in v] == sorted(r["curve_index"] for r in v) and v[0]["curve_index"] >= last
        last = v[-1]["curve_index"]
    sizes = sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in out)
    expected = sorted((-1 if d is None or d == 0 else d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _, _ in rows)
    assert sizes == expected


def test_few_rows(spark, tmp_path):
    for n in (0, 1, 5):
        path = tmp_path / str(n)
        spark.createDataFrame([(i, "t", "en", "s") for i in range(n)], "doc_id long, text string, lang string, source string").write.parquet(str(path / "documents.parquet"))
        out = queries.op7_hilbert_shards(spark, str(path)).collect()
        assert len(out) == n and len({(r["shard"], r["slot"]) for r in out}) == n
        assert all(r["slot"] == 0 for r in out)


DIMENSIONS = ["lang", "source", "size"]


def layouts(spark, keys, folder):
    """The same rows in 16 files along the curve, sorted by size, and in an order without meaning."""
    hilbert.write_shards(hilbert.shard(keys, "doc_id", DIMENSIONS, []), f"{folder}/curve", DIMENSIONS)
    for name, order in (("sorted", "size, doc_id"), ("random", "xxhash64(doc_id)")):
        placed = keys.selectExpr("*", f"cast(ntile(16) OVER (ORDER BY {order}) - 1 AS int) AS shard", f"row_number() OVER (ORDER BY {order}) AS slot")
        hilbert.write_shards(placed, f"{folder}/{name}", DIMENSIONS)


def test_files_are_pruned_and_rows_are_whole(spark, tmp_path):
    rows = [(i, ["en", "de", "fr", None][i * 7 % 4], f"s{i * 11 % 8}", (i * i * 37) % 4001) for i in range(4000)] + [(None, None, None, None)]
    keys = spark.createDataFrame(rows, "doc_id long, lang string, source string, size long")
    layouts(spark, keys, tmp_path)
    files = {"curve": 0, "sorted": 0, "random": 0}
    questions = [{"lang": (l, l), "source": (s, s), "size": b} for l in ("en", "de") for s in ("s1", "s4") for b in ((1, 60), (100, 400), (3000, 4000))]
    for name in files:
        for bounds in questions:
            files[name] += len(hilbert.touched(spark, f"{tmp_path}/{name}", bounds))
    for bounds in questions[:4]:
        got = sorted(r["doc_id"] for r in hilbert.read_where(spark, f"{tmp_path}/curve", bounds).collect())
        assert got == sorted(d for d, l, s, z in rows if l == bounds["lang"][0] and s == bounds["source"][0] and bounds["size"][0] <= z <= bounds["size"][1])
    assert 2 * files["curve"] < files["random"] and files["curve"] < files["sorted"], files
    with pytest.raises(ValueError, match="no order"):
        hilbert.touched(spark, f"{tmp_path}/curve", {"lang": ("a", "b")})
    assert hilbert.read_where(spark, f"{tmp_path}/curve", {"lang": ("nowhere", "nowhere")}).count() == 0


def test_clashing_columns_and_long_texts(spark):
    rows = [(1, "x" * 300_000, 5, 1, 2, 3), (2, "", 5, 1, 2, 3), (1, "x" * 300_000, 5, 1, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size long, d0 int, index int, run int")
    out = hilbert.shard(df, "doc_id", ["text", "size"], ["text"], 2).collect()
    assert sorted((r["shard"], r["slot"]) for r in out) == [(0, 0), (0, 1), (1, 0)] and {r["d0"] for r in out} == {1}
