"""Results that are written exactly once: a run's rows count only once its manifest is there.

``<path>/rows/run=.../attempt=...`` holds what attempts wrote, ``<path>/runs/run=...`` names the attempt that counts. A run
killed at any point has no manifest and its rows aren't read; its repetition writes a new attempt. A run that has a manifest
isn't written again unless it is replaced, and readers see either the old attempt or the new one.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "attempt string, n long, at timestamp, run string"


def _manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row a committed run; of two manifests of one run, as a replacement leaves when it is killed, the later counts."""
    try:
        found = spark.read.schema(MANIFEST).parquet(f"{path}/runs")
    except AnalysisException as error:  # no run is committed yet
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)
    return found.groupBy("run").agg(F.max_by(F.struct("attempt", "n", "at"), F.struct("at", "attempt")).alias("m")).select("run", "m.*")


def committed(spark: SparkSession, path: str, run: str) -> bool:
    return not _manifests(spark, path).filter(F.col("run") == run).isEmpty()


def stage(df: DataFrame, path: str, run: str) -> str:
    """Write a run's rows as a new attempt that doesn't count yet; returns the attempt."""
    if {"run", "attempt"} & {c.lower() for c in df.columns}:
        raise ValueError("results must have no columns run and attempt")
    attempt = f"a.{uuid.uuid4().hex}"
    df.withColumns({"run": F.lit(f"r.{run}"), "attempt": F.lit(attempt)}).write.mode("append").partitionBy("run", "attempt").parquet(f"{path}/rows")
    return attempt


def commit(spark: SparkSession, path: str, run: str, attempt: str, rows: int) -> None:
    """Let an attempt count: one row, in one file, that appears at once."""
    row = spark.createDataFrame([(attempt, rows)], "attempt string, n long").withColumns({"at": F.current_timestamp(), "run": F.lit(run)})
    row.coalesce(1).write.mode("append").partitionBy("run").parquet(f"{path}/runs")


def write_run(df: DataFrame, path: str, run: str, replace: bool = False) -> bool:
    """Write the rows of a run once: false if the run was there and isn't to be replaced. Empty results are a run too.
    One writer a run at a time; runs of other names may be written beside it."""
    spark = df.sparkSession
    if not replace and committed(spark, path, run):
        return False
    attempt = stage(df, path, run)
    mine = (F.col("run") == run) & (F.col("attempt") == attempt)
    rows = _rows(spark, path)
    commit(spark, path, run, attempt, rows.filter(mine).count() if rows else 0)
    return True


def _rows(spark: SparkSession, path: str) -> DataFrame | None:
    try:  # the folders' names begin with a letter, so that a run named 01 isn't read as a number
        return spark.read.option("mergeSchema", True).parquet(f"{path}/rows").withColumn("run", F.substr("run", F.lit(3)))
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all committed runs, with their run; what killed attempts left is pruned with its folders."""
    rows = _rows(spark, path)
    if rows is None:
        raise FileNotFoundError(f"no results under {path}")
    return rows.join(_manifests(spark, path).select("run", "attempt"), ["run", "attempt"]).drop("attempt")


def remaining(wanted: DataFrame, path: str, key: list[str]) -> DataFrame:
    """What of ``wanted`` no committed run holds; null keys are equal to each other."""
    rows = _rows(wanted.sparkSession, path)
    if rows is None:
        return wanted
    done = read_runs(wanted.sparkSession, path).select(*(F.col(k).alias(f"_done_{k}") for k in key)).distinct()
    same = [wanted[k].eqNullSafe(done[f"_done_{k}"]) for k in key]
    return wanted.join(done, same, "left_anti")
