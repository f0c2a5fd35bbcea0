"""JSON documents of any size, their records as rows and as VARIANT values, so that keys may vary from row to row.

A document is read in pieces that end at closing braces, by Spark's own splits: no task holds a file, only one record at a
time. What a piece is (inside a string or not, how deep) follows from sums over the pieces before it: within its split by a
window, across the splits of a file by one row for each split. JSON has no raw escape before a brace, so a piece never begins
within an escape.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import written

SPLIT = ["file", "split"]
STRING = r'"(?:[^"\\]|\\.)*+"'
#: What may stand before a record: the rest of the list or object before it, members without braces, and a key of its own.
LEAD = rf'(?s)^\s*+[\[{{]?+(?:[\s,\[\]]|{STRING}\s*+:\s*+(?:{STRING}|\[(?:[^\[\]{{}}"]|{STRING})*+\]|[-+.\w]++)\s*+(?=[,\]]))*+(?:({STRING})\s*+:\s*+\[?+\s*+)?+(?=\{{)'


def _depth(text: Column) -> Column:
    """Opening less closing brackets of a text that begins outside strings and has no escapes."""
    bare = F.regexp_replace(text, r'"[^"]*+("|$)', "")
    return F.length(F.translate(bare, "]}", "")) - F.length(F.translate(bare, "[{", ""))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The pieces, each with its quotes and its depth, begun outside a string (d0) and within one (d1)."""
    raw = spark.read.option("lineSep", "}").text(path)
    rows = raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"), "value"
    )
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    rows = rows.withColumn("_plain", plain).withColumn("quotes", F.length("_plain") - F.length(F.replace("_plain", F.lit('"'), F.lit(""))))
    closed = F.col("quotes") % 2  # the brace that ends a piece counts where no string is open there
    d0 = _depth(F.col("_plain")) + closed - 1
    d1 = _depth(F.regexp_replace("_plain", r'^[^"]*+("|$)', "")) - closed
    return rows.withColumn("d0", d0).withColumn("d1", d1).drop("_plain")


def json_objects(spark: SparkSession, path: str, depth: int = 1, keyed_lists: bool = False) -> DataFrame:
    """The objects at a depth of JSON documents, as rows (file, n, key, text, complete).

    ``depth`` counts the brackets around a record; in a document that is itself a list it is 1. ``n`` orders the records of
    a file. ``key`` is the record's own key in an object or, with ``keyed_lists``, that of the list which holds it (null in
    a list without a name). ``complete`` is false for all records of a file that ends amid its brackets. Empty files and
    empty lists have no rows; repeated records are rows of their own; white space and line ends may stand anywhere.
    """
    pieces = written(_pieces(spark, path))
    within = Window.partitionBy(*SPLIT).orderBy("place")
    state = pieces.drop("value").withColumn("_q", (F.sum("quotes").over(within) - F.col("quotes")) % 2)
    state = state.withColumn("_as", F.when(F.col("_q") == 0, F.col("d0")).otherwise(F.col("d1"))).withColumn("_other", F.col("d0") + F.col("d1") - F.col("_as"))
    first = pieces.filter(F.trim(F.regexp_replace("value", r"\s+", " ")) != "")
    kinds = first.groupBy("file").agg(F.min_by(F.regexp_extract("value", r"^\s*(.)", 1), F.struct("split", "place")).alias("_kind"))

    files = Window.partitionBy("file").orderBy("split")
    earlier = files.rowsBetween(Window.unboundedPreceding, -1)
    totals = state.groupBy(*SPLIT).agg(F.sum("quotes").alias("_quotes"), F.sum("_as").alias("_out"), F.sum("_other").alias("_in"))
    totals = totals.withColumn("_open", F.coalesce(F.sum("_quotes").over(earlier), F.lit(0)) % 2)
    totals = totals.withColumn("_here", F.when(F.col("_open") == 0, F.col("_out")).otherwise(F.col("_in")))
    totals = totals.withColumn("_deep", F.coalesce(F.sum("_here").over(earlier), F.lit(0)))
    whole = Window.partitionBy("file")
    ends = (F.sum("_here").over(whole) <= 0) & (F.sum("_quotes").over(whole) % 2 == 0)
    starts = totals.withColumn("complete", ends).join(kinds, "file").select(*SPLIT, "_open", "_deep", "complete", "_kind")

    base = F.when(F.col("_kind") == "[", 1).otherwise(depth)
    mine = F.when(F.col("_open") == 0, F.col("_as")).otherwise(F.col("_other"))
    placed = state.join(starts, SPLIT).withColumn("_after", F.col("_deep") + F.sum(mine).over(within))
    outside = (F.col("_open") + F.col("_q") + F.col("quotes")) % 2 == 0
    placed = placed.withColumn("_end", F.when(outside & (F.col("_after") <= base), 1).otherwise(0)).withColumn("_kept", (F.col("_end") == 1) & (F.col("_after") == base))
    placed = written(placed.select(*SPLIT, "place", "_end", "_kept", "complete", "_kind"))
    counts = placed.groupBy(*SPLIT).agg(F.sum("_end").alias("_ends"))
    counts = counts.select(*SPLIT, F.coalesce(F.sum("_ends").over(earlier), F.lit(0)).alias("_before"))
    numbered = placed.join(counts, SPLIT).withColumn("n", F.col("_before") + F.sum("_end").over(within) - F.col("_end"))

    parts = numbered.join(pieces.select(*SPLIT, "place", "value"), [*SPLIT, "place"])
    grouped = parts.groupBy("file", "n").agg(
        F.array_sort(F.collect_list(F.struct("split", "place", "value"))).alias("_parts"), F.bool_or("_kept").alias("_kept"), F.first("complete").alias("complete"), F.first("_kind").alias("_kind")
    )
    text = F.concat(F.array_join(F.transform("_parts", lambda p: p["value"]), "}"), F.lit("}"))
    rows = grouped.filter("_kept").select("file", "n", text.alias("_text"), "complete", "_kind")
    named = F.variant_get(F.parse_json(F.nullif(F.regexp_extract("_text", LEAD, 1), F.lit(""))), "$", "string")
    rows = rows.withColumn("key", named).withColumn("text", F.regexp_replace("_text", LEAD, "")).drop("_text")
    if keyed_lists:  # the names of a document's lists are few: they go along by file
        lists = rows.filter("key IS NOT NULL").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("_lists"))
        held = F.filter("_lists", lambda o: o["n"] <= F.col("n"))
        rows = rows.join(lists, "file", "left").withColumn("key", F.when(F.col("_kind") == "{", F.try_element_at(held, F.lit(-1))["key"]))
    return rows.select("file", "n", "key", "text", "complete")


def _value(rows: DataFrame) -> Column:
    """A record as VARIANT; a file cut short is an error, not fewer rows."""
    cut = F.raise_error(F.concat(F.lit("file ends amid its brackets: "), F.col("file"))).cast("variant")
    return F.when(F.col("complete"), F.parse_json("text")).otherwise(cut)


def question_records(spark: SparkSession, path: str) -> DataFrame:
    """Question files, lists or objects with a list under ``questions``, as (file, n, record VARIANT): no key is lost."""
    rows = json_objects(spark, path, 2, keyed_lists=True)
    return rows.filter("key IS NULL OR key = 'questions'").select("file", "n", _value(rows).alias("record"))


def cache_records(spark: SparkSession, path: str, key: str) -> DataFrame:
    """An object keyed by id, of any size, as (key, record VARIANT)."""
    rows = json_objects(spark, path, 1)
    return rows.select(F.col("key").alias(key), _value(rows).alias("record"))


def typed(records: DataFrame, schema: T.StructType) -> DataFrame:
    """The record's fields by a schema; what a record lacks, or holds in another form, is null."""
    return records.select(*(F.try_variant_get("record", f"$['{f.name}']", f.dataType.simpleString()).alias(f.name) for f in schema.fields))


def keys_of(records: DataFrame, *carry: str) -> DataFrame:
    """One row for each key of each record: the columns carried, key, value (VARIANT)."""
    spark = records.sparkSession
    return records.lateralJoin(spark.tvf.variant_explode(F.col("record").outer())).select(*carry, "key", "value")


def schema_of(records: DataFrame) -> str:
    """The one schema that holds all records, as text."""
    return records.agg(F.schema_of_variant_agg("record")).first()[0]


def write_json_lists(df: DataFrame, path: str, name: str | None = None) -> None:
    """Each partition as one JSON document: a list of its rows, or an object with that list under a name. Null columns are
    left out of a record. Spark's commit keeps the files of finished tasks only, each once; an empty partition is an empty
    list."""
    opening = f'{{"{name}": [' if name else "["
    closing = "]}" if name else "]"

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"value": [opening]})
        started = False
        for batch in batches:
            texts = batch.column(0).to_pylist()
            if texts:
                yield pa.RecordBatch.from_pydict({"value": [("," if started or i else "") + t for i, t in enumerate(texts)]})
                started = True
        yield pa.RecordBatch.from_pydict({"value": [closing]})

    df.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(framed, "value string").write.mode("overwrite").text(path)
