"""Evaluation aggregates: classification metrics, summaries and calibration, each one pass over the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def class_metrics(df: DataFrame, groups: list[str], truth: str, predicted: str) -> DataFrame:
    """Macro, weighted and micro averages of precision, recall and F1 by group.

    Labels are those met as truth or as prediction; a ratio without cases is 0. Rows are counted by their pair of labels
    first, so what is spread over labels is small.
    """
    pairs = df.groupBy(*groups, F.col(truth).alias("_t"), F.col(predicted).alias("_p")).agg(F.count("*").alias("_n"))
    hit = F.col("_t").eqNullSafe(F.col("_p"))
    spread = pairs.withColumn("_label", F.explode(F.when(hit, F.array("_t")).otherwise(F.array("_t", "_p"))))
    is_t, is_p = F.col("_label").eqNullSafe(F.col("_t")), F.col("_label").eqNullSafe(F.col("_p"))
    counts = spread.groupBy(*groups, "_label").agg(*(F.sum(F.when(c, F.col("_n")).otherwise(0)).alias(k) for k, c in (("tp", is_t & is_p), ("fp", ~is_t & is_p), ("fn", is_t & ~is_p))))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    f1 = _share(2.0 * tp, 2 * tp + fp + fn)
    return counts.groupBy(*groups).agg(
        F.round(F.avg(_share(tp, tp + fp)), 9).alias("precision_macro"),
        F.round(F.avg(_share(tp, tp + fn)), 9).alias("recall_macro"),
        F.round(F.avg(f1), 9).alias("f1_macro"),
        F.round(F.sum(f1 * (tp + fn)) / F.sum(tp + fn), 9).alias("f1_weighted"),
        F.round(F.sum("tp") / (F.sum("tp") + F.sum("fp")), 9).alias("f1_micro"),
    )


def summary(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Count, mean, sample deviation and the 95 % interval of the mean within 0..1; one row has no deviation."""
    mean, std, n = F.avg(value), F.stddev_samp(value), F.count(value)
    margin = 1.96 * std / F.sqrt(n)
    return df.groupBy(*groups).agg(
        n.alias("n"),
        F.round(mean, 9).alias("mean"),
        F.round(std, 9).alias("std"),
        F.round(F.greatest(F.lit(0.0), mean - margin), 9).alias("ci_low"),
        F.round(F.least(F.lit(1.0), mean + margin), 9).alias("ci_high"),
    )


def expected_calibration_error(df: DataFrame, correct: str, percent: str, bins: int = 10) -> DataFrame:
    """The mean gap between confidence (in whole percents) and accuracy over equal bins, weighted by their rows."""
    width = 100 // bins
    bin_ = F.least(F.floor(F.col(percent) / width), F.lit(bins - 1))
    per = df.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col(correct).cast("double")).alias("hits"), (F.sum(percent) / 100).alias("conf"))
    return per.agg(F.round(F.sum(F.abs(F.col("hits") - F.col("conf"))) / F.sum("n"), 9).alias("ece"), F.count("*").alias("bins"))
