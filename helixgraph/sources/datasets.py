"""Question-answering data sets of different shapes in one schema: question, options, answer, answer_type, source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import letter


def _common(df: DataFrame, question: Column, options: Column, answer: Column, kind: str, source: str) -> DataFrame:
    return df.select(question.alias("question"), options.alias("options"), answer.alias("answer"), F.lit(kind).alias("answer_type"), F.lit(source).alias("source"))


def decisions(df: DataFrame, source: str) -> DataFrame:
    """Yes/no questions (question, final_decision); maybe counts as no."""
    decision = F.lower("final_decision")
    return _common(df, F.col("question"), F.lit(None).cast("array<string>"), F.when(decision == "maybe", "no").otherwise(decision), "yes_no", source)


def numbered(df: DataFrame, source: str) -> DataFrame:
    """Multiple choice (question, opa, opb, opc, opd, cop), the right one by number."""
    return _common(df, F.col("question"), F.array("opa", "opb", "opc", "opd"), letter(F.col("cop")), "mcq", source)


def listed(df: DataFrame, source: str) -> DataFrame:
    """Multiple choice (question, choices, answer), the right one by its place in the list."""
    return _common(df, F.col("question"), F.col("choices"), letter(F.col("answer")), "mcq", source)


def keyed(df: DataFrame, source: str) -> DataFrame:
    """Multiple choice (question, options map of letters, answer_idx)."""
    return _common(df, F.col("question"), F.transform(F.array_sort(F.map_keys("options")), lambda k: F.col("options")[k]), F.col("answer_idx"), "mcq", source)


def context(contexts: Column, most: int = 2000) -> Column:
    """Nested contexts joined and cut."""
    return F.substring(F.array_join(contexts, " "), 1, most)


def balanced(df: DataFrame, by: str, each: int, total: int, seed: int = 42) -> DataFrame:
    """``each`` rows of each group in a repeatable random order, then others up to ``total``."""
    from pyspark.sql import Window

    mark = F.md5(F.concat(F.col("question"), F.lit(str(seed))))
    placed = df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(mark, "question")))
    first = placed.filter(F.col("_n") <= each)
    rest = placed.filter(F.col("_n") > each).orderBy("_n", by).limit(max(0, total))
    return first.unionByName(rest).orderBy(F.col("_n") > each, "_n", by).limit(total).drop("_n")
