"""A corpus pipeline in stages; each is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixgraph.llm import packing, queries, simhash, suffix, toxicity
from helixgraph.llm.common import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar scores below one half."""
    return toxicity.keep_clean(docs, queries.toxicity_model(docs, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group alike in five-word shingles by 0.8 or more."""
    return simhash.keep_one(docs, "doc_id", "text", words=5, similarity=0.8)


#: Words of the strings whose repeats go: every passage of over 50 words holds one, even if a word at its edge differs.
REPEATED_WORDS = 50


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings of 50 words that also start elsewhere; emptied documents stay as empty ones. Texts that
    hold no such string are as they were."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    cut = suffix.remove_repeats(docs, "doc_id", "text", length=REPEATED_WORDS, unit="words", carry=rest)
    changed = {"text": F.col("kept").cast("string")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length(changed["text"]).cast(docs.schema["n_chars"].dataType)
    return cut.withColumns(changed).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences of at most 1024 ids."""
    return packing.pack(queries.tokenized(docs), ["doc_id", "piece", "ids_crc32"], queries.CAPACITY)


#: (name, function of (spark, docs, sf_dir)).
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack_sequences),
]

#: SQL can express neither the automaton scores nor the packing; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
