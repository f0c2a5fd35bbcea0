"""Approximate nearest neighbours by additive quantisation.

A vector is a sum of one full-dimensional codeword from each codebook; codes come from a beam search over residuals and
the norm of the sum is stored beside them. A query's table of inner products with all codewords scores every code by
lookups: |q - x|^2 = |q|^2 - 2 sum of table entries + stored norm. The best codes are then ranked by exact distances.

Codebooks are fitted on at most SAMPLE distinct vectors (those whose ids have the least hashes); every vector is
indexed. Equal vectors form one class, found once and expanded to its smallest ids, so that copies cost no accuracy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, partitions

#: Vectors on which codebooks are fitted; codebooks and their words; beams kept; candidates ranked exactly.
SAMPLE, BOOKS, WORDS, BEAM, CANDIDATES = 16_384, 24, 256, 4, 400
#: Queries of a block, about; vectors of a segment; vectors whose codes a task holds, about (36 bytes each).
QUERY_BLOCK, SEGMENT, SHARE = 256, 1024, 1 << 21


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Codebooks (books, words, dimensions): k-means of successive residuals, then one joint least-squares refit."""
    random = np.random.default_rng(seed)
    words = min(words, len(x))
    out, rest, codes = [], x.astype(np.float32), []
    for _ in range(books):
        c = rest[random.choice(len(rest), words, replace=False)].copy()
        for _ in range(rounds):
            near = (-2 * rest @ c.T + (c * c).sum(1)).argmin(1)
            n = np.bincount(near, minlength=words)
            for d in range(c.shape[1]):
                total = np.bincount(near, rest[:, d], words)
                c[:, d] = np.where(n > 0, total / np.maximum(n, 1), c[:, d])
        near = (-2 * rest @ c.T + (c * c).sum(1)).argmin(1)
        rest = rest - c[near]
        out.append(c)
        codes.append(near)
    books_ = np.stack(out)
    for m in range(books):  # each book in turn takes the means of what the others leave
        without = x - sum(books_[j][codes[j]] for j in range(books) if j != m)
        n = np.bincount(codes[m], minlength=words)
        for d in range(x.shape[1]):
            books_[m][:, d] = np.where(n > 0, np.bincount(codes[m], without[:, d], words) / np.maximum(n, 1), books_[m][:, d])
    return books_.astype(np.float32)


def encode(x: np.ndarray, codebooks: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, books) by beam search, and the squared norms of the sums."""
    n, (books, words, _) = len(x), codebooks.shape
    rest = x[:, None, :].astype(np.float32)  # rows, beams, dimensions
    codes = np.zeros((n, 1, 0), np.uint8)
    for m in range(books):
        c = codebooks[m]
        score = (rest * rest).sum(2)[:, :, None] - 2 * rest @ c.T + (c * c).sum(1)
        flat = score.reshape(n, -1)
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
        b, w = best // words, best % words
        rows = np.arange(n)[:, None]
        rest = rest[rows, b] - c[w]
        codes = np.concatenate([codes[rows, b], w[:, :, None].astype(np.uint8)], 2)
    final = (rest * rest).sum(2).argmin(1)
    codes = codes[np.arange(n), final]
    total = sum(codebooks[m][codes[:, m]] for m in range(books))
    return codes, (total * total).sum(1)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not zero."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(vector, lambda v: v != 0), F.lit(False))


def _distance(a: str, b: str) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))


def _best(score: np.ndarray, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n least scores of each row, in no order, with their classes."""
    if score.shape[1] <= n:
        return score, which
    best = np.argpartition(score, n - 1, axis=1)[:, :n]
    return np.take_along_axis(score, best, 1), np.take_along_axis(which, best, 1)


def _index(rows: DataFrame, codebooks) -> DataFrame:
    """(segment, classes, codes, norms): the codes of ``rows`` (class, vector), packed, SEGMENT of them a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SEGMENT):
                part = batch.slice(i, SEGMENT)
                x = part.column("vector").flatten().to_numpy().astype(np.float32).reshape(part.num_rows, -1)
                names = part.column("class").to_numpy()
                codes, norm = encode(x, codebooks.value)
                columns = [pa.array([names[0]]), *(pa.array([v.tobytes()], pa.binary()) for v in (names, codes, norm.astype(np.float32)))]
                yield pa.RecordBatch.from_arrays(columns, ["segment", "classes", "codes", "norms"])

    return rows.select("class", "vector").mapInArrow(run, "segment long, classes binary, codes binary, norms binary")


def _dealt(codes: DataFrame, packed: DataFrame, shares: int, parts: int) -> DataFrame:
    """Segments of codes and blocks of queries, so that each share of the codes meets each block in one task: the codes go
    to ``parts`` tasks each, however many blocks there are, and the blocks, which are small, to one task of each share.
    Within a task the codes come first."""
    dealt = F.pmod(F.xxhash64("segment"), F.lit(shares)).cast("int").alias("share")
    held = codes.select(dealt, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(-1).alias("block"), F.lit(None).cast(packed.schema["asked"].dataType).alias("asked"), "classes", "codes", "norms")
    none = [F.lit(None).cast("binary").alias(c) for c in ("classes", "codes", "norms")]
    asked = packed.select(F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.pmod("block", F.lit(parts)).alias("part"), "block", "asked", *none)
    place = F.col("share") * parts + F.col("part")
    return held.unionByName(asked).withColumn("place", place.cast("int")).repartitionById(shares * parts, F.col("place")).sortWithinPartitions("place", "block")


def _scan(dealt: DataFrame, codebooks, candidates: int) -> DataFrame:
    """(query_class, scores, classes): the best codes of each query in each share, by table lookups. A task holds its share
    of the codes, one block's lookup table and that block's best codes so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, held = codebooks.value, []
        for row in (batch.slice(i, 1) for batch in batches for i in range(batch.num_rows)):
            if row.column("block")[0].as_py() < 0:
                members, norm = (np.frombuffer(row.column(c)[0].as_py(), t) for c, t in (("classes", np.int64), ("norms", np.float32)))
                held.append((members, norm, np.frombuffer(row.column("codes")[0].as_py(), np.uint8).reshape(len(norm), -1)))
                continue
            if not held:  # a share may be empty
                continue
            asked = row.column("asked")[0].values
            names = asked.field("class").to_numpy()
            q = asked.field("vector").flatten().to_numpy().astype(np.float32).reshape(len(names), -1)
            table = -2 * np.einsum("qd,mwd->mwq", q, books)
            score, which = np.zeros((len(names), 0), np.float32), np.zeros((len(names), 0), np.int64)
            for members, norm, code in held:
                s = np.repeat(norm[:, None], len(names), 1)
                for m in range(len(books)):
                    s += table[m][code[:, m]]
                score, which = _best(np.concatenate([score, s.T], 1), np.concatenate([which, np.tile(members, (len(names), 1))], 1), candidates)
            columns = [pa.array([v[i].tobytes() for i in range(len(names))], pa.binary()) for v in (score, which)]
            yield pa.RecordBatch.from_arrays([pa.array(names), *columns], ["query_class", "scores", "classes"])

    return dealt.select("block", "asked", "classes", "codes", "norms").mapInArrow(run, "query_class long, scores binary, classes binary")


def _merged(found: DataFrame, candidates: int) -> DataFrame:
    """(query_class, class): each query's best codes of all tasks. Its lists come one after the other and are merged into
    one as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, score, which = None, None, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(which.shape[1], query)), pa.array(which[0])], ["query_class", "class"])

        for batch in batches:
            for q, s, w in zip(*(c.to_pylist() for c in batch.columns)):
                s, w = np.frombuffer(s, np.float32)[None, :], np.frombuffer(w, np.int64)[None, :]
                if q == query:
                    score, which = _best(np.concatenate([score, s], 1), np.concatenate([which, w], 1), candidates)
                    continue
                if query is not None:
                    yield told()
                query, score, which = q, s, w
        if query is not None:
            yield told()

    dealt = found.repartition(partitions(found.sparkSession), "query_class").sortWithinPartitions("query_class")
    return dealt.mapInArrow(run, "query_class long, class long")


def _one_row_an_id(rows: DataFrame) -> DataFrame:
    """Rows (vec_id, vector, asked) with each id once: the least vector of those of an id counts, and it is asked for if
    one of them is. Only ids go through a shuffle where none repeats."""
    again = materialize(rows.groupBy("vec_id").agg(F.count("*").alias("n")).filter("n > 1").select("vec_id"), "repeated")
    if again.isEmpty():
        return rows
    merged = rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("vector").alias("vector"), F.bool_or("asked").alias("asked"))
    return rows.join(again, "vec_id", "left_anti").select("vec_id", "vector", "asked").unionByName(merged)


def search(vectors: DataFrame, queries: Column, k: int = 10, candidates: int = CANDIDATES, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row that ``queries`` selects, among all other rows.

    Nearness is the Euclidean distance in double precision on the original vectors, ties to the smaller id. Unusable
    vectors (see ``usable``) and null ids take no part, nor do vectors whose dimension isn't the most frequent one (the
    larger on ties). Of repeated ids the row with the least vector counts (see ``_one_row_an_id``). Other columns may have
    any names. Fewer rows give fewer neighbours; an empty table gives none.

    All queries are answered in one plan: blocks of queries meet shares of the codes, each pair once, which is a scan of all
    codes for each block, as the method asks. A share stays with its task while the blocks pass it, so the codes are shuffled
    about once; the blocks are replicated by share, and each share gives its candidates of each query.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(F.col(id_column).isNotNull() & usable(F.col(vector_column))).select(F.col(id_column).alias("vec_id"), F.col(vector_column).alias("vector"), queries.alias("asked"))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if size is None:
        return empty
    # equal vectors are told by 128 bits; the smallest id among them names their class
    rows = _one_row_an_id(rows.filter(F.size("vector") == size["d"])).withColumns({"h": F.xxhash64("vector"), "g": F.xxhash64(F.lit(1), "vector")})
    place = F.row_number().over(Window.partitionBy("h", "g").orderBy("vec_id"))
    # the k + 1 smallest ids of each class; the limit is applied before the shuffle too
    members = rows.withColumn("place", place).filter(F.col("place") <= k + 1).drop("asked")
    members = materialize(members.withColumn("class", F.min("vec_id").over(Window.partitionBy("h", "g"))), "members")
    index = members.filter("place = 1").select("class", "vector", "h", "g")
    sample = index.orderBy(F.xxhash64("class"), "class").limit(SAMPLE).select("vector").toPandas()["vector"]
    codebooks = spark.sparkContext.broadcast(fit(np.stack(sample.to_list()).astype(np.float32)))
    codes = materialize(_index(index.repartition(partitions(spark), "class"), codebooks), "codes")
    asked = rows.filter("asked").select(F.col("vec_id").alias("query_id"), "h", "g").join(index.select("h", "g", F.col("class").alias("query_class")), ["h", "g"])
    asked = materialize(asked.select("query_id", "query_class"), "asked")
    distinct = asked.select("query_class").distinct().join(index.select(F.col("class").alias("query_class"), "vector"), "query_class")
    n = asked.select("query_class").distinct().count()
    if not n:
        return empty
    blocks = -(-n // QUERY_BLOCK)
    packed = distinct.groupBy(F.pmod(F.xxhash64("query_class"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct(F.col("query_class").alias("class"), "vector")).alias("asked"))
    packed = materialize(packed, "queries")
    size_of = codes.agg(F.count("*").alias("segments"), F.sum(F.length("norms") / 4).alias("n")).first()
    shares = min(size_of["segments"], max(-(-int(size_of["n"]) // SHARE), -(-partitions(spark) // blocks)))
    dealt = _dealt(codes, packed, shares, min(blocks, -(-partitions(spark) // shares)))
    found = materialize(_merged(_scan(dealt, codebooks, candidates), candidates), "candidates")
    exact = (
        found.join(index.select("class", F.col("vector").alias("x")), "class")
        .join(distinct.select("query_class", F.col("vector").alias("y")), "query_class")
        .select("query_class", "class", _distance("x", "y").alias("score"))
    )
    nearest = Window.partitionBy("query_class").orderBy("score", "vec_id")
    # k + 1 candidate rows of a class of queries hold the k of each query, which only leaves out itself
    expanded = exact.join(members.select("class", "vec_id"), "class").withColumn("place", F.row_number().over(nearest)).filter(F.col("place") <= k + 1)
    final = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        asked.join(expanded.select("query_class", "vec_id", "score"), "query_class")
        .filter("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(final))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
