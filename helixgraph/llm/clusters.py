"""Centroid clustering over bit planes: a plane holds one bit of each of a vector's 64 integer components as one uint64, and
weighted popcounts of the AND of two planes add up to exact dot products and squared distances."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

#: Components of a vector, and so bits of a plane.
WIDTH = 64
#: Vectors whose distances are computed at a time.
CHUNK = 2048
#: Planes of two sides up to which sums of weighted counts surely fit 64 bits; wider ones use integers without a limit.
PLANES_64 = 27
#: Bits of the parts into which sums are cut, so that parts from many tasks add up within 64 bits.
LIMB = 32


def pack(values: np.ndarray) -> np.ndarray:
    """(vectors, planes) of uint64: plane i has bit j set if component j has bit i in two's complement; the last plane is the
    sign's and counts negative. ``values`` holds 64-bit or unbounded integers."""
    high = int(np.maximum(values, ~values).max()).bit_length()
    planes = np.empty((len(values), high + 1), dtype=np.uint64)
    for i in range(high + 1):
        bits = ((values >> i) & 1).astype(np.uint8)
        planes[:, i] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return planes


def weights(planes: int) -> list[int]:
    return [1 << i for i in range(planes - 1)] + [-(1 << (planes - 1))]


def dot(a: np.ndarray, b: np.ndarray, each: bool = False) -> np.ndarray:
    """Exact dot products of every vector of a with every one of b, or (each) of the vectors at the same place."""
    n, m = a.shape[1], b.shape[1]
    b = b if each else b[None]
    if max(n, m) <= PLANES_64:
        total = 0
        for i, x in enumerate(weights(n)):
            part = 0
            for j, y in enumerate(weights(m)):
                part = part + np.bitwise_count((a[:, i] if each else a[:, i, None]) & b[..., j]).astype(np.int64) * y
            total = total + part * x
        return total
    # counts of equal weight together, then one sum of unbounded integers
    signs = np.sign(np.array(weights(m), dtype=object)).astype(np.int64)
    counts = np.zeros((*np.broadcast_shapes(a.shape[:1] if each else (len(a), 1), b.shape[:-1]), n + m - 1), dtype=np.int64)
    for i in range(n):
        met = np.bitwise_count((a[:, i, None] if each else a[:, i, None, None]) & b).astype(np.int64) * signs
        counts[..., i : i + m] += -met if i == n - 1 else met
    return (counts.astype(object) * np.array([1 << d for d in range(n + m - 1)], dtype=object)).sum(axis=-1)


def distances(a: np.ndarray, b: np.ndarray, norms_a: np.ndarray, norms_b: np.ndarray) -> np.ndarray:
    """Exact squared distances, from norms and dot products."""
    return norms_a[:, None] - 2 * dot(a, b) + norms_b[None, :]


def nearest(planes: np.ndarray, centroids: np.ndarray, norms_c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, the smaller number on ties, and its squared distance."""
    found = distances(planes, centroids, dot(planes, planes, each=True), norms_c)
    best = found.argmin(axis=1)
    return best, found[np.arange(len(best)), best]


def quantised(raw: list) -> list[int]:
    """floor(256 x) of each component, exactly, for numbers of any size."""
    out = []
    for x in raw:
        scaled = x * 256.0
        if math.isfinite(scaled):
            out.append(math.floor(scaled))
        else:
            n, d = float(x).as_integer_ratio()
            out.append((n * 256) // d)
    return out


def packed(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(_id, planes): the vectors with exactly 64 components, none null or not finite, as planes in little-endian bytes."""
    whole = F.col(vector).cast("array<double>")
    usable = F.coalesce((F.size(vector) == WIDTH) & F.forall(whole, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))), F.lit(False))
    rows = df.filter(usable).select(F.col(id_column).alias("_id"), whole.alias("_vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            raw = batch.column(1).flatten().to_numpy().reshape(-1, WIDTH)
            if np.abs(raw).max() < 2.0**40:
                values = np.floor(raw * 256.0).astype(np.int64)
                sizes = np.frexp(np.maximum(values, ~values).max(axis=1).astype(np.float64))[1]
                out = [b""] * len(raw)
                for size in np.unique(sizes):
                    at = np.flatnonzero(sizes == size)
                    for k, planes in zip(at, pack(values[at]).astype("<u8")):
                        out[k] = planes.tobytes()
            else:
                out = [pack(np.array([quantised(row)], dtype=object)).astype("<u8").tobytes() for row in raw.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["_id", "planes"])

    return rows.mapInArrow(run, T.StructType([rows.schema["_id"], T.StructField("planes", T.BinaryType())]))


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, planes) of the batch's vectors, those of the same number of planes together, at most CHUNK at a time."""
    raw = batch.column(1).to_pylist()
    sizes = np.array([len(x) for x in raw])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        for start in range(0, len(at), CHUNK):
            some = at[start : start + CHUNK]
            yield some, np.frombuffer(b"".join(raw[k] for k in some), dtype="<u8").reshape(len(some), size // 8)


def _sums(rows: DataFrame, centroids: np.ndarray, norms: np.ndarray) -> DataFrame:
    """(cluster, component, limb, value): parts of the componentwise sums of the vectors nearest to each centroid; component
    -1 has their number. A task adds up how many of its vectors have each bit of each plane set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, counts, members = len(centroids), {}, np.zeros(len(centroids), dtype=np.int64)
        for batch in batches:
            for _, planes in _by_width(batch):
                best, _ = nearest(planes, centroids, norms)
                order = np.argsort(best, kind="stable")
                own, starts = np.unique(best[order], return_index=True)
                bits = np.unpackbits(planes[order].view(np.uint8).reshape(len(best), -1, 8), axis=2, bitorder="little")
                n = planes.shape[1]
                held = counts.setdefault(n, np.zeros((k, n, WIDTH), dtype=np.int64))
                held[own] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
                members += np.bincount(best, minlength=k)
        out = [(c, -1, 0, int(m)) for c, m in enumerate(members) if m]
        total = sum((held.astype(object) * np.array(weights(n), dtype=object)[None, :, None]).sum(axis=1) for n, held in counts.items())
        for c in np.flatnonzero(members):
            for j, value in enumerate(total[c]):
                limb = 0
                while value not in (0, -1):
                    out.append((int(c), j, limb, value & ((1 << LIMB) - 1)))
                    value, limb = value >> LIMB, limb + 1
                if value:
                    out.append((int(c), j, limb, -1))
        types = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out)) or [[]] * 4, types)], ["cluster", "component", "limb", "value"])

    return rows.mapInArrow(run, "cluster int, component int, limb int, value long").groupBy("cluster", "component", "limb").agg(F.sum("value").alias("value"))


def _moved(centroids: list[list[int]], sums: list) -> list[list[int]]:
    """The centroids after a round: floors of the means; those without vectors stay."""
    count, total = {}, {}
    for cluster, component, limb, value in sums:
        if component < 0:
            count[cluster] = value
        else:
            total[cluster, component] = total.get((cluster, component), 0) + (value << (LIMB * limb))
    return [[total.get((c, j), 0) // count[c] for j in range(WIDTH)] if c in count else old for c, old in enumerate(centroids)]


def cluster(df: DataFrame, id_column: str, vector: str, start: Column, k: int = 40, rounds: int = 5) -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance) of every usable vector after ``rounds`` rounds, and the final centroids as lists of integers.

    Vectors take part that have exactly 64 components, none null or not finite; a component x counts as floor(256 x). The
    first centroids are the k vectors that ``start`` (of the id column, which is named _id there) puts first, in this order;
    rows that agree in it go by their planes. Fewer vectors than k make as many clusters, none an empty result. Each round
    assigns every vector to the nearest centroid by squared Euclidean distance, the smaller number on ties, and replaces
    every centroid that has vectors by the floors of their means. All arithmetic is exact; a distance beyond 64 bits is null.
    Repeated rows and ids are vectors of their own, null ids too.

    Between rounds only the centroids pass the driver: k x 64 sums. Planes are written once and read by each round; a lost
    executor costs the reading of its part.
    """
    rows = materialize(packed(df, id_column, vector), "planes")
    first = rows.orderBy(start, "planes").limit(k).collect()
    centroids = [_unpacked(r["planes"]) for r in first]
    for _ in range(rounds if centroids else 0):
        planes = pack(np.array(centroids, dtype=object))
        sums = _sums(rows, planes, dot(planes, planes, each=True)).collect()  # k * 64 sums in a few parts each
        centroids = _moved(centroids, [tuple(r) for r in sums])

    last = pack(np.array(centroids, dtype=object)) if centroids else np.empty((0, 1), dtype=np.uint64)
    norms = dot(last, last, each=True)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            best, far = np.zeros(batch.num_rows, dtype=np.int32), np.zeros(batch.num_rows, dtype=object)
            for at, own in _by_width(batch):
                best[at], far[at] = nearest(own, last, norms)
            held = [int(x) if x < 1 << 63 else None for x in far]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best), pa.array(held, pa.int64())], ["_id", "cluster", "distance"])

    kind = rows.schema["_id"].dataType.simpleString()
    found = rows.mapInArrow(assign, f"_id {kind}, cluster int, distance long")
    return found.withColumnRenamed("_id", id_column), centroids


def _unpacked(planes: bytes) -> list[int]:
    own = np.frombuffer(planes, dtype="<u8")
    bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return [int(x) for x in (bits.astype(object) * np.array(weights(len(own)), dtype=object)[:, None]).sum(axis=0)]


def with_inertia(found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Adds the distances' sums of the row's cluster and of all rows (null if a distance in them is, or beyond 64 bits) and the
    SHA-256 of its centroid's components, as decimal integers joined by commas."""
    kept = materialize(found, "clusters")
    whole = F.when(F.count("*") == F.count("distance"), F.try_sum(F.col("distance").cast("decimal(38,0)")))
    own = {r["cluster"]: None if r["own"] is None else int(r["own"]) for r in kept.groupBy("cluster").agg(whole.alias("own")).collect()}  # a row for each centroid
    every = None if None in own.values() else sum(own.values())
    fits = lambda n: n if n is not None and n < 1 << 63 else None
    rows = [(c, fits(n), fits(every), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, n in own.items()]
    sums = kept.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return kept.join(F.broadcast(sums), "cluster")
