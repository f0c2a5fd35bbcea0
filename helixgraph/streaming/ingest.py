"""Structured Streaming over arriving files: the batch rules, applied as files come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import variants as V
from ..sources.session import work_folder


def file_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """A table of the folder as a stream of files."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet*").parquet(folder)


def call_windows(calls: DataFrame, width: str = "1 day", delay: str = "7 days") -> DataFrame:
    """Calls and tokens by window and model, with a watermark for late rows; works on batches and streams alike."""
    return (
        calls.withWatermark("ts", delay)
        .groupBy(F.window("ts", width).alias("w"), "model")
        .agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))
        .select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "model", "calls", "tokens")
    )


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions that are whole, in their order: those whose writers left their mark."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(f.getPath().getParent().getName()[2:]) for f in found or [])


def run_complete(stream: DataFrame, schema: T.StructType, folder: str | None = None) -> DataFrame:
    """Run a streaming aggregate over all that has arrived; the last complete result, as a table. Without a row it is
    empty. With a folder of its own the next run goes on from where this one ended."""
    spark = stream.sparkSession
    folder = folder or work_folder(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/v={number}")

    query = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    versions = _versions(spark, folder)
    return spark.read.schema(schema).parquet(f"{folder}/v={versions[-1]}") if versions else spark.createDataFrame([], schema)


#: Buckets by variant that a batch rewrites only where it has rows.
BUCKETS = 64


def best_variants(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """The best significant row of each variant, kept up to date batch by batch.

    The table is bucketed by variant: a batch merges its best rows with the last version of the buckets that it touches and
    writes these anew, under its own number, so that untouched ones stay and a batch that is run again after a failure
    writes the same. Which versions there are is read from storage, so a restart (with the same folder) goes on from the
    rows of the runs before. A stream without rows gives an empty table.
    """
    spark = stream.sparkSession
    folder = folder or work_folder(spark)
    order = [F.desc("neglog10p"), F.col("bp"), F.col("gene"), F.col("beta")]
    schema = stream.schema
    stored = T.StructType([*schema.fields]).add("bucket", "integer")

    def latest(before: int) -> DataFrame:
        """The last version of each bucket among those before a batch."""
        whole = [v for v in _versions(spark, folder) if v < before]
        if not whole:
            return spark.createDataFrame([], stored)
        versioned = T.StructType([*stored.fields, T.StructField("v", T.LongType())])
        rows = spark.read.schema(versioned).option("basePath", folder).parquet(*(f"{folder}/v={v}" for v in whole))
        last = rows.groupBy("bucket").agg(F.max("v").alias("last"))  # a row for each bucket
        return rows.join(F.broadcast(last), "bucket").filter("v = last").select(*stored.names)

    def merge(batch: DataFrame, number: int) -> None:
        fresh = V.keep_best(V.raises_risk(V.usual_frequency(V.significant(batch))), ["rsid"], order)
        fresh = fresh.withColumn("bucket", F.pmod(F.xxhash64("rsid"), F.lit(BUCKETS)).cast("int"))
        touched = fresh.select("bucket").distinct()
        old = latest(number).join(F.broadcast(touched), "bucket", "left_semi").select(*stored.names)
        merged = V.keep_best(fresh.select(*stored.names).unionByName(old), ["rsid"], order)
        merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/v={number}")

    query = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(merge).start()
    query.awaitTermination()
    return latest(1 << 62).select(*schema.names)
