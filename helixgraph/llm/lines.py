"""Substring dedup by unit hashing: repeated paragraphs and lines go, all but the earliest; offsets are those of the original
text. Sentences are an option."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, pieces

CHUNK = 4 << 20
#: What ends a unit, by level, over UTF-8: blank lines, a line feed, or a full stop with white space after it. Each level's
#: units are made of whole units of the next.
ENDS = {
    "paragraph": re.compile(rb"\n(?:[\x20\x09\x0B-\x0D]*\n)+"),
    "line": re.compile(rb"\n"),
    "sentence": re.compile(rb"\n|[.!?]+[\x20\x09]+|(?:\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f)+[\x20\x09]*"),
}


def units(raw: bytes, level: str) -> list[tuple[int, int]]:
    """Byte spans of the units, each with what ends it; they cover the text."""
    out, at = [], 0
    for m in ENDS[level].finditer(raw):
        out.append((at, m.end()))
        at = m.end()
    return out + [(at, len(raw))] * (at < len(raw))


def normal_form(unit: bytes) -> bytes:
    """Small letters and single spaces; the form whose digest is compared."""
    return b" ".join(unit.decode().lower().encode().split())


def unit_digests(df: DataFrame, level: str) -> DataFrame:
    """(high, low, id, digest, start, end): a row for each unit that isn't blank, with its 128-bit digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for whole in batches:
            for batch in pieces(whole, "_text", CHUNK):
                where, marks, start, end = [], [], [], []
                for i, text in enumerate(batch.column("_text").to_pylist()):
                    raw = (text or "").encode()
                    for a, b in units(raw, level):
                        if form := normal_form(raw[a:b]):
                            where.append(i)
                            marks.append(digest(form))
                            start.append(a)
                            end.append(b)
                index, marks = pa.array(where, pa.int64()), pa.py_buffer(b"".join(marks))
                both = pa.Array.from_buffers(pa.int64(), 2 * len(where), [None, marks]).to_numpy().reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), batch.column("_id").take(index), batch.column("_digest").take(index), pa.array(start, pa.int32()), pa.array(end, pa.int32())], schema.names)

    schema = T.StructType().add("high", "long").add("low", "long").add("_id", df.schema["_id"].dataType).add("_digest", "long").add("start", "integer").add("end", "integer")
    return df.select("_id", "_digest", "_text").mapInArrow(run, schema)


def _repeated(found: DataFrame) -> DataFrame:
    """(_id, _digest, start, end), written: the units of whose group there is an earlier one."""
    place = F.struct(F.col("_id").isNotNull().alias("known"), "_id", "_digest", "start")
    # written before the join, so that Spark can split a frequent unit's rows
    groups = materialize(found.groupBy("high", "low").agg(F.count("*").alias("n"), F.min(place).alias("kept")).filter("n > 1"), "groups")
    first = F.col("_id").eqNullSafe(F.col("kept._id")) & (F.col("_digest") == F.col("kept._digest")) & (F.col("start") == F.col("kept.start"))
    gone = materialize(found.join(groups, ["high", "low"]).filter(~first).select("_id", "_digest", "start", "end"), "repeated")
    discard(groups)
    return gone


def _by_row(gone: DataFrame) -> DataFrame:
    """The spans of each row; columns (_i, _d, gone)."""
    return gone.groupBy(F.col("_id").alias("_i"), F.col("_digest").alias("_d")).agg(F.collect_set(F.struct("start", "end")).alias("gone"))


def remove_repeated_units(df: DataFrame, id_column: str, text_column: str, levels: tuple[str, ...] = ("paragraph", "line")) -> DataFrame:
    """(id, n_bytes, n_units, n_removed, n_spans, longest_words, removed, kept_units, kept) for every row.

    Units of a level ("paragraph", "line" or "sentence") whose normal forms agree anywhere are one group, however short they
    are; the earliest by (id, digest of the row, offset) stays and the rest are cut out with what ends them. Levels go in
    turn, coarse ones first; units inside a removed one take no part in the next. Blank units stay. ``removed`` and
    ``kept_units`` (units of the last level) are [start, end) byte offsets in the original text, ``kept`` the remaining
    text, ``n_removed`` its lost bytes, ``n_spans`` the runs of what was removed, ``longest_words`` the words of the longest,
    n_units all units of the last level. Null texts count as empty. Repeated rows share one place in the order, so they lose
    the same units. A null id comes first. An empty table gives an empty result.
    """
    rows = df.select(F.col(id_column).alias("_id"), F.xxhash64(id_column, text_column).alias("_digest"), F.col(text_column).alias("_text"))
    same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_digest") == F.col("_d"))
    parts: list[DataFrame] = []
    for level in levels:
        found = materialize(unit_digests(rows, level), "units")
        left = found
        for before in parts:
            covered = F.coalesce(F.exists("gone", lambda g: (g["start"] <= F.col("start")) & (F.col("end") <= g["end"])), F.lit(False))
            left = left.join(_by_row(before), same, "left").filter(~covered).select(*found.columns)
        left = materialize(left, "units") if parts else found
        parts.append(_repeated(left))
        discard(*({found, left}))
    gone = parts[0]
    for part in parts[1:]:
        gone = gone.unionByName(part)
    level = levels[-1]
    joined = rows.join(_by_row(gone), same, "left").select("_id", "_text", "gone")
    span = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer"))
    schema = T.StructType().add("_id", rows.schema["_id"].dataType)
    for c in ("n_bytes", "n_units", "n_removed", "n_spans", "longest_words"):
        schema = schema.add(c, "long")
    schema = schema.add("removed", span).add("kept_units", span).add("kept", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow_span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for whole in batches:
            for batch in pieces(whole, "_text", CHUNK):
                out = []
                for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    raw = (text or "").encode()
                    runs: list[list[int]] = []
                    for g in sorted(gone or [], key=lambda g: g["start"]):
                        if runs and runs[-1][1] == g["start"]:
                            runs[-1][1] = g["end"]
                        else:
                            runs.append([g["start"], g["end"]])
                    every, at = units(raw, level), 0
                    stay = []
                    for a, b in every:
                        while at < len(runs) and runs[at][1] <= a:
                            at += 1
                        if at == len(runs) or b <= runs[at][0]:
                            stay.append((a, b))
                    kept = b"".join(raw[a:b] for a, b in stay)
                    longest = max((len(raw[a:b].split()) for a, b in runs), default=0)
                    out.append((len(raw), len(every), len(raw) - len(kept), len(runs), longest, [{"start": a, "end": b} for a, b in runs], [{"start": a, "end": b} for a, b in stay], kept.decode()))
                types = [pa.int64()] * 5 + [arrow_span, arrow_span, pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 8, types))], schema.names)

    return joined.mapInArrow(run, schema).withColumnRenamed("_id", id_column)
