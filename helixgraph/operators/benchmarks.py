"""Construction and validation of question sets from templates and graph samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_pool(df: DataFrame, score: str, least: float, keys: list[str], k: int, strata: list[str], seed: int = 42) -> DataFrame:
    """k rows of each stratum beyond a score, in a random order that depends on the keys and the seed alone."""
    mark = F.md5(F.concat_ws("-", *(F.col(c).cast("string") for c in keys), F.lit(str(seed))))
    order = Window.partitionBy(*strata).orderBy(mark, *keys)
    return df.filter(F.col(score) > least).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")


def fill(template: Column, values: dict[str, Column]) -> Column:
    """The template with {name} replaced by each value."""
    return reduce(lambda text, item: F.replace(text, F.lit("{" + item[0] + "}"), item[1].cast("string")), values.items(), template)


def generate(templates: DataFrame, samples: DataFrame, values: list[str]) -> DataFrame:
    """(task_id, values, question): every template with every sample of its task, joined on the task."""
    return samples.join(F.broadcast(templates), "task_id").select("task_id", *values, fill(F.col("template"), {v: F.col(v) for v in values}).alias("question"))


def validate(questions: DataFrame, answers: DataFrame, key: list[str], answer: str) -> DataFrame:
    """Questions with a ``valid`` flag and a reason: no row, null answers only, or ok. One join for all questions."""
    found = answers.groupBy(*key).agg(F.count("*").alias("_rows"), F.count(answer).alias("_known"))
    reason = F.when(F.col("_rows").isNull(), "no_rows").when(F.col("_known") == 0, "null_answer").otherwise("ok")
    return questions.join(found, key, "left").withColumn("reason", reason).withColumn("valid", F.col("reason") == "ok").drop("_rows", "_known")
