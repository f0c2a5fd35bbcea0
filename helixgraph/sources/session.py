"""What a session needs to run the package's functions in Python workers, and tables that are written once and read again."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]


def ship_package(spark: SparkSession) -> None:
    """Send the package to the workers, once for each context: a driver can't tell what its workers can import."""
    context = spark.sparkContext
    if getattr(context, "_helixgraph_shipped", False):
        return
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='helixgraph-')}/helixgraph", "zip", ROOT, "helixgraph")
    context.addPyFile(archive)
    context._helixgraph_shipped = True


def work_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; a local session that sets none gets its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="helixgraph-")
    return f"{base.rstrip('/')}/work-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder, read again: for tables that several steps use."""
    folder = work_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: Rows to a partition of what is dealt out by its rows.
ROWS = 250_000


def dealt(table: DataFrame, *keys: str) -> DataFrame:
    """A written table in as many partitions as its rows ask for, by keys: so that a task's memory doesn't grow with the table."""
    return table.repartition(max(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // ROWS)), *keys)


#: Rows that a join may send whole to all executors, by way of the driver.
SENT = 500_000


def shuffled(df: DataFrame, rows: int) -> DataFrame:
    """df as a side of joins that is never sent to all executors if its ``rows`` are many. Left to itself Spark goes by the size
    of files, and keys compress so well that a few megabytes hold millions of rows, all of which would pass through the driver."""
    return df.hint("merge") if rows > SENT else df


def joinable(df: DataFrame, rows: int) -> DataFrame:
    """df as a side of joins: sent to all executors if its ``rows`` are few, else never."""
    return shuffled(df, rows) if rows > SENT else F.broadcast(df)


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds each row's place, from 1, in an order of all rows, without sorting them in one task: a range partitioning deals
    out runs of the order, a row for each run says where it begins. The order should identify rows."""
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    runs = written(df.repartitionByRange(n, *order).withColumn("_run", F.spark_partition_id()))
    starts, total = [], 0
    for r in sorted(runs.groupBy("_run").agg(F.count("*").alias("n")).collect()):  # a row for each partition
        starts.append((r["_run"], total))
        total += r["n"]
    offsets = spark.createDataFrame(starts, "_run int, _start long")
    place = F.row_number().over(Window.partitionBy("_run").orderBy(*order)) + F.col("_start")
    return runs.join(F.broadcast(offsets), "_run").withColumn(name, place.cast("long")).drop("_run", "_start")


def running_min(df: DataFrame, by: str, order: list[Column], value: str, name: str) -> DataFrame:
    """Adds the least value from each row to the end of its group, in an order of all rows, without holding a group in one
    task: within runs of a range partitioning by a window, beyond them by one row for each run and group. ``by`` may be null."""
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    runs = written(df.repartitionByRange(n, F.col(by), *order).withColumn("_run", F.spark_partition_id()))
    least = runs.groupBy(by, "_run").agg(F.min(value).alias("_least"))
    later = Window.partitionBy(by).orderBy("_run").rowsBetween(1, Window.unboundedFollowing)
    carry = least.select(F.col(by).alias("_by"), F.col("_run").alias("_r"), F.min("_least").over(later).alias("_later"))
    onward = Window.partitionBy("_run", by).orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    joined = runs.join(carry, runs[by].eqNullSafe(F.col("_by")) & (runs["_run"] == F.col("_r")))
    return joined.withColumn(name, F.least(F.min(value).over(onward), F.col("_later"))).drop("_run", "_by", "_r", "_later")
