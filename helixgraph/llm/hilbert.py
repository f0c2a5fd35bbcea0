"""Sharding along a Hilbert curve over quantised metadata dimensions.

Rows near each other in several dimensions get near places on the curve, so runs cut from it have narrow ranges in
every dimension and readers can skip whole files. The order is total (curve index, id, then the row's digests), ranks
come from a range partitioning with counts for each run, and a shard is a run of ranks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import global_rank

#: Bits of each dimension.
BITS = 10


def curve_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points (rows of unsigned coordinates), by Skilling's transpose."""
    x = axes.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations of the cells from the largest down
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def quantise(value: Column, kind: T.DataType, bits: int) -> Column:
    """A coordinate of ``bits`` bits; null is 0.

    Strings take bits of their hash: equal values share a cell, which is what file pruning by equality needs. Numbers
    take a logarithmic scale (32 steps for each doubling, zero and less in cell 0), which needs no pass over the data.
    """
    top = (1 << bits) - 1
    if isinstance(kind, (T.StringType, T.BinaryType, T.BooleanType)):
        cell = F.shiftrightunsigned(F.xxhash64(value), 64 - bits)
    else:
        number = value.cast("double")
        cell = F.when(number > 0, F.least(F.lit(top), F.floor(F.log2(number + 1) * 32))).otherwise(0)
    return F.coalesce(cell.cast("long"), F.lit(0))


def hilbert_column(df: DataFrame, dimensions: list[str], bits: int = BITS) -> Column:
    """The curve index of the row over the columns named (at most 62 bits in all)."""
    if len(dimensions) * bits > 62:
        raise ValueError("the index has more than 62 bits")

    @F.pandas_udf("long")
    def index(cells: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for c in cells:
            yield pd.Series(curve_index(c.to_numpy(), bits))

    return index(F.struct(*(quantise(F.col(d), df.schema[d].dataType, bits).alias(f"d{i}") for i, d in enumerate(dimensions))))


def shard(df: DataFrame, id_column: str, dimensions: list[str], ties: list[str], shards: int = 16, bits: int = BITS) -> DataFrame:
    """Add _curve, shard and slot: runs of the curve whose row counts differ by one at most (the law ``rows``).

    Rows on one curve cell follow the id and then the columns ``ties``; rows equal in all of these are interchangeable.
    Null dimensions and ids sort first. An empty table gives an empty result.
    """
    keyed = df.withColumn("_curve", hilbert_column(df, dimensions, bits))
    ranked = global_rank(keyed, ["_curve", id_column, *ties], "_rank", "hilbert")
    total = ranked.agg(F.count("*").alias("_total"))  # one row
    start = F.expr(f"(shard * _total + {shards - 1}) div {shards}")  # the first rank of the shard
    return (
        ranked.join(F.broadcast(total))
        .withColumn("shard", F.expr(f"cast(_rank * {shards} div _total as int)"))
        .withColumn("slot", F.col("_rank") - start)
        .drop("_rank", "_total")
    )


def write_shards(sharded: DataFrame, path: str, dimensions: list[str], shards: int = 16, bits: int = BITS) -> None:
    """Write what ``shard`` gives, a file for each shard, in the order of slots, and beside them each file's ranges of cells.

    ``<path>/rows/shard=.../`` holds the rows, ``<path>/ranges`` a row for each shard. Shards without rows have no file.
    """
    if any(c.lower().startswith("cell_") for c in sharded.columns):
        raise ValueError("columns must not begin with cell_")
    laid = sharded.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")
    laid.write.mode("overwrite").partitionBy("shard").parquet(f"{path}/rows")
    kinds = {d: sharded.schema[d].dataType for d in dimensions}
    cells = sharded.select("shard", *(quantise(F.col(d), k, bits).alias(f"cell_{d}") for d, k in kinds.items()))
    ends = [f(f"cell_{d}").alias(f"{name}_{d}") for d in dimensions for name, f in (("least", F.min), ("most", F.max))]
    cells.groupBy("shard").agg(F.count("*").alias("n"), *ends).coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")


def touched(spark: SparkSession, path: str, bounds: dict[str, tuple], bits: int = BITS) -> list[int]:
    """The shards whose cells meet all bounds, each (least, most) of a dimension; strings by equality, so both ends are the
    same. Cells keep the order of numbers, so no row within the bounds is in another shard; null rows meet no bound."""
    ranges, rows = spark.read.parquet(f"{path}/ranges"), spark.read.parquet(f"{path}/rows")
    for d, (least, most) in bounds.items():
        kind = rows.schema[d].dataType
        if isinstance(kind, (T.StringType, T.BinaryType, T.BooleanType)) and least != most:
            raise ValueError(f"{d} has no order on the curve")
        low, high = (quantise(F.lit(v).cast(kind), kind, bits) for v in (least, most))
        ranges = ranges.filter((F.col(f"most_{d}") >= low) & (F.col(f"least_{d}") <= high))
    return sorted(r["shard"] for r in ranges.select("shard").collect())  # a row for each shard


def read_where(spark: SparkSession, path: str, bounds: dict[str, tuple], bits: int = BITS) -> DataFrame:
    """The rows within all bounds, both ends included; files that can't hold any aren't opened."""
    rows = spark.read.parquet(f"{path}/rows").filter(F.col("shard").isin(touched(spark, path, bounds, bits)))
    for d, (least, most) in bounds.items():
        rows = rows.filter(F.col(d).between(least, most))
    return rows
