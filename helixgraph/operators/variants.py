"""Genetic evidence: from variants with study statistics to ranked genes. Every step is a function of DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K


def with_aliases(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Add the target column of each alias that the table has only under its other name."""
    return df.withColumns({target: F.col(source) for source, target in aliases.items() if source in df.columns and target not in df.columns})


def ensure_columns(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Add the columns that are missing."""
    return df.withColumns({k: v for k, v in defaults.items() if k not in df.columns})


def significant(df: DataFrame) -> DataFrame:
    return df.filter(F.col("p") < K.GENOME_WIDE)


def usual_frequency(df: DataFrame) -> DataFrame:
    """Minor allele frequencies within bounds, if the table has them."""
    return df.filter(F.col("maf").between(K.MAF_LEAST, K.MAF_MOST)) if "maf" in df.columns else df


def raises_risk(df: DataFrame) -> DataFrame:
    return df.filter(F.col("beta") > 0)


def valid(column: str) -> Column:
    """A posterior probability, null where the method failed (a negative value)."""
    return F.when(F.col(column) >= 0, F.col(column))


def scored(df: DataFrame, methods: list[str]) -> DataFrame:
    """Add evidence_score, causal_score (mean of the valid methods, 0 without any), n_valid and risk_score."""
    array = F.array(*(valid(m) for m in methods))
    known = F.filter(array, lambda x: x.isNotNull())
    n = F.size(known)
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + x)
    evidence = F.least(F.col("neglog10p") / 10, F.lit(1.0))
    causal = F.when(n > 0, total / n).otherwise(0.0)
    return df.withColumns({"evidence_score": evidence, "causal_score": causal, "n_valid": n}).withColumn("risk_score", F.col("evidence_score") * K.EVIDENCE_WEIGHT + F.col("causal_score") * K.CAUSAL_WEIGHT)


def keep_best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; the order should end in columns that tell rows apart."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def rounded(column: Column | str, digits: int) -> Column:
    """A number rounded as a product with a power of ten, halves away from zero: so do SQL engines that round in binary. A
    rounding of the decimal text (``F.round``) differs from it where the product meets a half and the text doesn't."""
    scale = 10.0**digits
    return F.round((F.col(column) if isinstance(column, str) else column) * scale, 0) / scale


def exact_mean(column: str) -> Column:
    """The mean of an exact sum, so that it doesn't depend on the order of the rows, rounded or not."""
    return F.sum(F.col(column).cast("decimal(28,18)")).cast("double") / F.count(column)


def looked_up(table: dict[str, float], key: Column) -> Column:
    """The value of a key in a fixed table, 0 if it isn't there."""
    entries = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*entries), key), F.lit(0.0))


def extended(df: DataFrame) -> DataFrame:
    """Add extended_score, the weighted sum of the components; a null component makes it null."""
    w = K.EXTENDED_WEIGHTS
    return df.withColumn("extended_score", F.col("risk_score") * w["risk"] + F.col("effect_score") * w["effect"] + F.col("clinical_score") * w["clinical"] + F.col("consequence_score") * w["consequence"] + F.col("evidence_score") * w["evidence"])


def inside_first(mapped: DataFrame, keys: list[str]) -> DataFrame:
    """Mappings of a variant by distance are dropped if it lies inside a gene."""
    least = F.min("distance").over(Window.partitionBy(*keys))
    return mapped.withColumn("_least", least).filter((F.col("_least") > 0) | (F.col("distance") == 0)).drop("_least")


def near_genes(points: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """Points (chr, bp, ...) with the genes (chr, start, end, ...) within ``window`` of them, and the distance (0 inside).

    An equi-join on chromosome and bin: genes take all bins that they and the window touch, points take one.
    """
    bins = F.sequence(F.floor((F.col("start") - window) / window), F.floor((F.col("end") + window) / window))
    binned = spans.withColumn("_bin", F.explode(bins)).withColumnRenamed("chr", "_chr")
    placed = points.withColumn("_bin", F.floor(F.col("bp") / window)).withColumnRenamed("_bin", "_pbin")
    distance = F.greatest(F.col("start") - F.col("bp"), F.col("bp") - F.col("end"), F.lit(0)).cast("long")
    joined = placed.join(binned, (F.col("chr") == F.col("_chr")) & (F.col("_pbin") == F.col("_bin")))
    return joined.withColumn("distance_to_gene", distance).filter(F.col("distance_to_gene") <= window).drop("_chr", "_bin", "_pbin")


def min_max(df: DataFrame, column: str, out: str) -> DataFrame:
    """Add the column scaled to 0..1 over the whole table; a constant column gives 0. The range is one broadcast row."""
    bounds = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return df.crossJoin(F.broadcast(bounds)).withColumn(out, scaled).drop("_lo", "_hi")


def gene_scores(df: DataFrame, score: str) -> DataFrame:
    """Per gene: best and mean score, counts, best variant, and the score with a bonus for many significant variants."""
    genes = df.groupBy("gene").agg(
        F.max(score).alias("gene_score"),
        F.count("*").alias("snp_count"),
        F.count_if(F.col("p") < K.GENOME_WIDE).alias("n_sig"),
        F.max("neglog10p").alias("best_neglog10p"),
        F.min_by("rsid", F.struct(-F.col(score), "rsid")).alias("best_snp"),
    )
    most = genes.agg(F.max("n_sig").alias("_most"))
    bonus = F.when(F.col("_most") > 0, F.log1p("n_sig") / F.log1p("_most")).otherwise(0.0)
    return genes.crossJoin(F.broadcast(most)).withColumn("bonus_score", F.col("gene_score") + (1 - F.col("gene_score")) * K.COUNT_BONUS * bonus).drop("_most")
