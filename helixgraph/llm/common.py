"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The table ``documents`` with the columns named, or doc_id and text."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one for a local session that sets none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^,]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="helixgraph-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again.

    This cuts the lineage: a lost executor costs a read of the file, not the work behind it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once what was made of it is written itself."""
    for frame in frames:
        spark = frame.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(frame.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def global_rank(df: DataFrame, order: list[str], rank: str = "rank", name: str = "ranked") -> DataFrame:
    """Add the row's place (from 0) in the order given, over all rows, without a sort in one task.

    A range partitioning gives each partition a run of the order; the counts of the runs (a row for each
    partition) give the offsets. ``order`` should identify rows; rows that agree in it take any order. One value of
    the leading column may hold most rows as long as the later columns split it.
    """
    spark = df.sparkSession
    n = max(1, partitions(spark))
    runs = materialize(
        df.repartitionByRange(n, *(F.col(c).asc_nulls_first() for c in order)).withColumn("_run", F.spark_partition_id()),
        name,
    )
    counts = {r["_run"]: r["n"] for r in runs.groupBy("_run").agg(F.count("*").alias("n")).collect()}
    starts, total = {}, 0
    for run in sorted(counts):
        starts[run] = total
        total += counts[run]
    window = Window.partitionBy("_run").orderBy(*(F.col(c).asc_nulls_first() for c in order))
    offsets = spark.createDataFrame([(k, v) for k, v in starts.items()] or [(-1, 0)], "_run int, _start long")
    return (
        runs.join(F.broadcast(offsets), "_run")
        .withColumn(rank, F.row_number().over(window).cast("long") - 1 + F.col("_start"))
        .drop("_run", "_start")
    )


def text_bytes(text: pa.Array) -> pa.Array:
    """UTF-8 bytes of a string column, null as empty."""
    return text.cast(pa.large_string()).fill_null("").cast(pa.large_binary())


def pieces(batch: pa.RecordBatch, column: str, limit: int):
    """Slices of the batch whose column holds about ``limit`` bytes, one row at least, so that a task's memory is
    bounded by the limit and its longest value."""
    lengths = batch.column(column).cast(pa.large_string() if pa.types.is_string(batch.column(column).type) else pa.large_binary())
    sizes = pa.compute.binary_length(lengths).fill_null(0).to_pylist()
    start = used = 0
    for i, n in enumerate(sizes):
        if i > start and used + n > limit:
            yield batch.slice(start, i - start)
            start, used = i, 0
        used += n
    if len(sizes) > start:
        yield batch.slice(start)
