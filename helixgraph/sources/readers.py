"""Readers and writers: delimited tables with declared schemas, question files, caches, summaries, graphs, checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import documents

#: Columns of variant files.
VARIANT_SCHEMA = T.StructType(
    [
        T.StructField(n, t)
        for n, t in [
            ("chr", T.IntegerType()),
            ("bp", T.LongType()),
            ("rsid", T.StringType()),
            ("maf", T.DoubleType()),
            ("ea", T.StringType()),
            ("nea", T.StringType()),
            ("beta", T.DoubleType()),
            ("se", T.DoubleType()),
            ("p", T.DoubleType()),
            ("susie", T.DoubleType()),
            ("finemap", T.DoubleType()),
            ("meta_id", T.StringType()),
            ("lead_snp", T.StringType()),
        ]
    ]
)
#: A question document; keys that a row lacks are null.
QUESTION_SCHEMA = T.StructType(
    [
        T.StructField("question", T.StringType()),
        T.StructField("cypher", T.StringType()),
        T.StructField("task_id", T.StringType()),
        T.StructField("taxonomy", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("answer_key", T.StringType()),
        T.StructField("reasoning_type", T.StringType()),
        T.StructField("options", T.ArrayType(T.StringType())),
        T.StructField("correct_answer", T.StringType()),
        T.StructField("parameters", T.MapType(T.StringType(), T.StringType())),
        T.StructField("category", T.StringType()),
    ]
)


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, separator: str = "\t", columns: list[str] | None = None) -> DataFrame:
    """A delimited file with a header, read with a declared schema; only the columns asked for are parsed."""
    rows = spark.read.schema(schema).option("header", True).option("sep", separator).option("enforceSchema", False).csv(path)
    return rows.select(*columns) if columns else rows


def read_members(spark: SparkSession, path: str, ids: list[str], schema: T.StructType = VARIANT_SCHEMA) -> DataFrame:
    """The variants of the studies named: the membership test is pushed to the scan."""
    return read_delimited(spark, path, schema).filter(F.col("meta_id").isin(ids))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Question files that hold a JSON list, or an object with the list under ``questions``."""
    return documents.typed(documents.question_records(spark, path), QUESTION_SCHEMA)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_through(keys: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """What a cache holds of the keys, and the keys that it lacks (for a fetcher to fill in)."""
    wanted = keys.select(key).distinct()
    return wanted.join(cache, key), wanted.join(cache.select(key), key, "left_anti")


def cache_from_json(spark: SparkSession, path: str, key: str, record: T.StructType) -> DataFrame:
    """A JSON object keyed by id as a table of the key and the record's columns."""
    rows = documents.cache_records(spark, path, key)
    return rows.select(key, *(F.try_variant_get("record", f"$['{f.name}']", f.dataType.simpleString()).alias(f.name) for f in record.fields))


def named_records(rows: Column, names: list[str]) -> Column:
    """Arrays of positional values (as enrichment services send them) as an array of named records."""
    return F.transform(rows, lambda r: F.struct(*(F.try_element_at(r, F.lit(i + 1)).alias(n) for i, n in enumerate(names))))


def top_partners(edges: DataFrame, least_score: int, most: int) -> DataFrame:
    """The best partners of each protein beyond a score."""
    from pyspark.sql import Window

    order = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    return edges.filter(F.col("score") >= least_score).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")


def write_delimited(df: DataFrame, path: str, separator: str = ",") -> None:
    """A delimited table with a header; arrays are joined by semicolons."""
    flat = [F.array_join(f.name, ";").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema.fields]
    df.select(*flat).write.mode("overwrite").option("header", True).option("sep", separator).csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    """Aggregates as JSON lines, one row each."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as two tables."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def graphml_elements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A graph's nodes and undirected edges as GraphML elements, one a row, for a text sink."""
    def clean(c: str) -> Column:
        return F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))

    node = nodes.select(F.format_string('<node id="%s"><data key="node_type">%s</data></node>', clean("id"), clean("node_type")).alias("value"))
    edge = edges.select(F.format_string('<edge source="%s" target="%s"><data key="weight">%s</data></edge>', clean("source"), clean("target"), clean("weight")).alias("value"))
    return node.unionByName(edge)


def append_results(df: DataFrame, path: str, by: str = "model") -> None:
    """Append results partitioned by a column, so that a run resumes with what is missing."""
    df.write.mode("append").partitionBy(by).parquet(path)


def missing_results(wanted: DataFrame, path: str, key: list[str]) -> DataFrame:
    """What of ``wanted`` isn't written yet."""
    spark = wanted.sparkSession
    try:
        done = spark.read.parquet(path)
    except Exception as error:  # nothing is written yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return wanted
    return wanted.join(done.select(*key).distinct(), key, "left_anti")
