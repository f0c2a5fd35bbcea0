"""SimHash near-duplicates with bit-sliced Hamming comparison.

Fingerprints are taken once for each text; equal fingerprints collapse to one node before any comparison. Two
fingerprints within the radius agree on at least one of radius + 1 bit blocks, so nodes meet in buckets of equal
blocks. In a bucket, bit planes are stored vertically (one word holds one bit of 64 fingerprints); a carry-save counter
updates 64 distances with a few word operations a plane, and a block of lanes is abandoned once all of them exceed the
radius. Buckets beyond TILE nodes are dealt out as pairs of tiles, so that no task holds a whole large bucket.

``similar`` takes buckets and radius as a filter of candidates only: the texts travel with the nodes of a bucket, and a
link is made where the sets of word shingles are in fact as alike as asked.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions, pieces
from .graph import components

#: Fingerprints of a tile; larger buckets are compared tile by tile.
TILE = 4096
#: Bytes of text of a tile, about, and of texts that a task gathers before it compares them.
TILE_BYTES = 16 << 20
#: Words of 64 lanes that are compared, and abandoned, together.
BLOCK_WORDS = 64
CHUNK = 4 << 20


def fingerprint(text: bytes, words: int, seed: int) -> int:
    """The SimHash of word shingles, repeats included; of the whole sequence if it is shorter; 0 without words."""
    parts = text.lower().split()  # A-Z only, and the six white-space bytes
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return digest(b" ".join(parts), seed)
    joined = b" ".join(parts)
    ends = np.flatnonzero(np.frombuffer(joined + b" ", np.uint8) == 32)
    starts = [0, *(ends[: len(parts) - words] + 1).tolist()]
    h = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist())], ">u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        counts += np.unpackbits(h[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(h)).tobytes(), "big")


def fingerprints(df: DataFrame, id_column: str, text_column: str, words: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp long) for every row; null texts count as empty, whose fingerprint is 0. fp holds the bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "_text", CHUNK):
                fps = [fingerprint((t or "").encode(), words, seed) for t in batch.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["_id", "fp"])

    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    return rows.mapInArrow(run, f"_id {kind}, fp long").withColumnRenamed("_id", id_column)


def shingles(text: bytes, words: int) -> np.ndarray:
    """The set of word shingles as ascending 64-bit digests; texts with fewer words than a shingle have one, all their
    words."""
    parts = text.lower().split()
    joined = b" ".join(parts)
    digest = xxhash.xxh3_64_intdigest
    if len(parts) <= words:
        return np.array([digest(joined)], np.uint64)
    ends = np.flatnonzero(np.frombuffer(joined + b" ", np.uint8) == 32)
    starts = [0, *(ends[: len(parts) - words] + 1).tolist()]
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts, ends[words - 1 :].tolist())], np.uint64))


@functools.cache
def _multipliers(n: int) -> np.ndarray:
    """n odd numbers without a pattern: those of a progression would leave min-hashes, and bands with them, dependent."""
    return np.array([xxhash.xxh3_64_intdigest(f"min-hash {k}") | 1 for k in range(n)], np.uint64)


def sketch(text: bytes, words: int, bits: int, bands: int, rows: int) -> tuple[str, bytes, list[int]]:
    """Of the set of word shingles: the digest of the normalised text, a SimHash of ``bits`` bits, and min-hash band keys."""
    joined = b" ".join(text.lower().split())
    h = shingles(text, words)
    mark = []
    for k in range(bits // 64):
        x = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x632BE5AB)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        counts = np.zeros(64, np.int64)
        for i in range(0, len(x), 1 << 15):
            counts += np.unpackbits(x[i : i + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        mark.append(np.packbits(2 * counts > len(x)))
    least = np.full(bands * rows, ~np.uint64(0))
    for i in range(0, len(h), 1 << 12):
        np.minimum(least, np.multiply.outer(_multipliers(bands * rows), h[i : i + (1 << 12)]).min(axis=1), out=least)
    least = least.tolist()
    keys = [xxhash.xxh3_64_intdigest(repr(least[b * rows : (b + 1) * rows])) for b in range(bands)]
    return xxhash.xxh3_128_hexdigest(joined), np.concatenate(mark).tobytes(), keys


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of rows of 64-bit words: row p holds bit p of every row of values, 64 of them a word."""
    n = -len(values) % 64
    v = np.concatenate([values, np.zeros((n, values.shape[1]), np.uint64)]).astype(">u8")
    bits = np.unpackbits(v.view(np.uint8).reshape(len(v), -1), axis=1)
    return np.packbits(np.ascontiguousarray(bits.T), axis=1).view(np.uint64)


def within(differing: Iterator[np.ndarray] | list[np.ndarray], shape, radius: int) -> np.ndarray:
    """Words whose bit is 1 where at most ``radius`` of the planes are 1: carry-save counters that stick at overflow.

    Counting stops as soon as every lane of the block exceeds the radius.
    """
    size = max(1, radius.bit_length())
    counter = [np.zeros(shape, np.uint64) for _ in range(size)]
    over = np.zeros(shape, np.uint64)
    for p, plane in enumerate(differing):
        carry = plane
        for j in range(size):
            carry, counter[j] = counter[j] & carry, counter[j] ^ carry
        over |= carry
        if p % 8 == 7 and bool((over | _above(counter, radius) == ~np.uint64(0)).all()):
            return np.zeros(shape, np.uint64)
    return ~(over | _above(counter, radius))


def _above(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Words whose bit is 1 where the counter's value exceeds the radius."""
    above, equal = np.zeros_like(counter[0]), ~np.zeros_like(counter[0])
    for j in range(len(counter) - 1, -1, -1):
        if radius >> j & 1:
            equal &= counter[j]
        else:
            above |= equal & counter[j]
            equal &= ~counter[j]
    return above


def shifted_links(values: np.ndarray, run: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links between values of the same run, for many short runs at once: all lanes against the lanes s further on."""
    out, s = [], 1
    index = np.arange(len(values))
    while len(index):
        ok = index + s < len(values)
        index = index[ok]
        index = index[run[index + s] == run[index]]
        for i in range(0, len(index), 64 * BLOCK_WORDS):
            a = index[i : i + 64 * BLOCK_WORDS]
            x = planes(values[a] ^ values[a + s])
            hits = np.flatnonzero(np.unpackbits(within(list(x), x.shape[1], radius).view(np.uint8))[: len(a)])
            if len(hits):
                out.append((a[hits], a[hits] + s))
        s += 1
    return out


def tile_links(left: np.ndarray, right: np.ndarray, same: bool, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links between two tiles (or within one), by blocks of lanes of the right one against each value of the left."""
    out = []
    stored = planes(right)
    rows = np.unpackbits(left.astype(">u8").view(np.uint8).reshape(len(left), -1), axis=1).astype(bool)
    full = np.where(rows, ~np.uint64(0), np.uint64(0))
    for w in range(0, stored.shape[1], BLOCK_WORDS):
        block = stored[:, w : w + BLOCK_WORDS]
        for i in range(0, len(left), 64):
            q = full[i : i + 64]
            if same and (w + block.shape[1]) * 64 <= i:
                continue
            near = within((block[p][None, :] ^ q[:, p][:, None] for p in range(len(block))), (len(q), block.shape[1]), radius)
            hit = np.unpackbits(near.view(np.uint8), axis=1)
            a, b = np.nonzero(hit)
            a, b = a + i, b + w * 64
            keep = (b < len(right)) & ((b > a) if same else True)
            if keep.any():
                out.append((a[keep], b[keep]))
    return out


def _forest(pairs: list[tuple[np.ndarray, np.ndarray]], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links, as links to each tree's least value: all links kept, without all pairs."""
    a = np.concatenate([left[p[0]] for p in pairs])
    b = np.concatenate([right[p[1]] for p in pairs])
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = np.arange(len(nodes))
    i, j = where[: len(a)], where[len(a) :]
    while True:
        least = np.minimum(parent[i], parent[j])
        new = parent.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        np.minimum.at(new, parent[i], least)
        np.minimum.at(new, parent[j], least)
        new = new[new]
        if (new == parent).all():
            break
        parent = new
    moved = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[moved], nodes[parent[moved]]


def alike(pairs: list[tuple[np.ndarray, np.ndarray]], sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of those pairs of places in ``sets`` whose Jaccard similarity is ``similarity`` or more, exactly.

    Pairs that verified links already join are passed over, so that a large group of copies costs few comparisons.
    """
    ratio = Fraction(str(similarity))
    a, b = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    used = np.unique(np.concatenate([a, b]))
    size = np.array([len(sets[i]) for i in used.tolist()])
    until = np.cumsum(size)
    code = np.unique(np.concatenate([sets[i] for i in used.tolist()]), return_inverse=True)[1]
    mark = np.zeros(int(code.max()) + 1, bool)
    a, b = np.searchsorted(used, a), np.searchsorted(used, b)
    parent = list(range(len(used)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    out = []
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])).tolist()
    for s, e in zip(first, [*first[1:], len(a)]):
        i = int(a[s])
        own, mine = code[until[i] - size[i] : until[i]], root(i)
        others = b[s:e]
        fits = np.minimum(size[others], size[i]) * ratio.denominator >= np.maximum(size[others], size[i]) * ratio.numerator
        others = [j for j in others[fits].tolist() if root(j) != mine]
        mark[own] = True
        for k in range(0, len(others), 1024):
            some = np.array(others[k : k + 1024])
            starts = np.concatenate([[0], np.cumsum(size[some])[:-1]])
            common = np.add.reduceat(mark[np.concatenate([code[until[j] - size[j] : until[j]] for j in some.tolist()])], starts, dtype=np.int64)
            union = size[i] + size[some] - common
            for j in some[common * ratio.denominator >= union * ratio.numerator].tolist():
                if root(j) != root(i):
                    parent[root(j)] = root(i)
                    out.append((i, j))
        mark[own] = False
    found = used[np.array(out, np.int64).reshape(-1, 2)]
    return found[:, 0], found[:, 1]


def block_keys(nodes: DataFrame, radius: int) -> DataFrame:
    """(j, key, node, bits): nodes of distinct 64-bit ``fp`` in buckets of equal blocks; fingerprints at most ``radius``
    bits apart agree on one of radius + 1 blocks."""
    cuts = [round(64 * i / (radius + 1)) for i in range(radius + 2)]
    blocks = F.array(*(F.struct(F.lit(j).alias("j"), F.expr(f"shiftrightunsigned(shiftleft(fp, {cuts[j]}), {64 - cuts[j + 1] + cuts[j]})").alias("key")) for j in range(radius + 1)))
    name = F.lpad(F.hex("fp"), 16, "0")
    return nodes.select(name.alias("node"), F.unhex(name).alias("bits"), F.explode(blocks).alias("x")).select("x.j", "x.key", "node", "bits")


def _dealt(keyed: DataFrame) -> DataFrame:
    """(j, key, lo, hi, tile, node, bits) of nodes that aren't alone in their bucket (j, key), large buckets as pairs of
    tiles. Where the nodes have a ``size`` in bytes, it counts for the tiles, and of buckets with the same nodes one is
    left."""
    sized = "size" in keyed.columns
    counts = [F.count("*").alias("n"), F.sum("size").alias("bytes"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")]
    large = keyed.groupBy("j", "key").agg(*(counts if sized else counts[:1])).filter("n > 1")
    if sized:
        large = large.groupBy("n", "bytes", "x", "y").agg(F.min(F.struct("j", "key")).alias("b")).select("b.j", "b.key", "n", "bytes")
    large = materialize(large, "buckets")
    parts = F.ceil(F.col("n") / TILE)
    return (
        keyed.join(large, ["j", "key"])  # nodes alone in their bucket have no links
        .withColumn("tiles", (F.greatest(parts, F.least("n", F.ceil(F.col("bytes") / TILE_BYTES))) if sized else parts).cast("int"))
        .withColumn("tile", F.expr("pmod(xxhash64(node), tiles)").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("j", "key", F.least("tile", "other").cast("int").alias("lo"), F.greatest("tile", "other").cast("int").alias("hi"), "tile", "node", "bits")
    )


def links(keyed: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that connect exactly the nodes of a bucket (j, key) whose bits differ in at most ``radius`` places: a
    forest of each bucket. A node is in a bucket once."""
    return _compared(_dealt(keyed), radius)


def _compared(dealt: DataFrame, radius: int, words: int = 0, similarity: float | None = None) -> DataFrame:
    """Links (a, b) of the buckets dealt; given a similarity, only of nodes whose ``text`` has word shingles as alike as that."""
    exact = similarity is not None
    n_partitions = partitions(dealt.sparkSession)
    names = ["j", "key", "lo", "hi"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups come whole, one after the other: short ones are gathered, long ones are compared as tiles."""

        def flush(cols: list[np.ndarray], run: np.ndarray) -> Iterator[pa.RecordBatch]:
            lo, hi, tile, node, bits = cols[2:7]
            if not len(node):
                return
            start = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            size = np.diff(np.concatenate([start, [len(run)]]))
            short = np.repeat((size <= 64) & (lo[start] == hi[start]), size)
            where = np.arange(len(node))
            got = [(where[short], where[short], shifted_links(bits[short], run[short], radius))]
            for s, n in zip(start.tolist(), size.tolist()):
                if n > 1 and not short[s]:
                    part, here, t = bits[s : s + n], where[s : s + n], tile[s : s + n]
                    if lo[s] == hi[s]:
                        got.append((here, here, tile_links(part, part, True, radius)))
                    else:
                        x, y = t == lo[s], t == hi[s]
                        got.append((here[x], here[y], tile_links(part[x], part[y], False, radius)))
            made: dict[int, np.ndarray] = {}
            for x, y, pairs in got:
                if not pairs:
                    continue
                if exact:
                    pairs = [(x[a], y[b]) for a, b in pairs]
                    for i in np.unique(np.concatenate([v for p in pairs for v in p])).tolist():
                        if i not in made:
                            made[i] = shingles(cols[7][i].encode(), words)
                    a, b = (node[v] for v in alike(pairs, made, similarity))
                else:
                    a, b = _forest(pairs, node[x], node[y])
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(v.astype(str).tolist(), pa.string()) for v in (a, b)], ["a", "b"])

        held: list[list[np.ndarray]] = []
        count = size = 0
        for batch in (part for whole in batches for part in (pieces(whole, "text", TILE_BYTES) if exact else [whole])):
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            cols.append(np.array(batch.column(5).to_pylist(), "S"))
            cols.append(np.frombuffer(b"".join(batch.column(6).to_pylist()), ">u8").astype(np.uint64).reshape(batch.num_rows, -1))
            if exact:
                cols.append(batch.column(7).to_numpy(zero_copy_only=False))
                size += batch.column(7).nbytes
            held.append(cols)
            count += len(cols[0])
            if count < 1 << 15 and size < TILE_BYTES:
                continue
            cols = [np.concatenate(c) for c in zip(*held)]
            new = np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)
            last = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
            run = np.concatenate([[0], np.cumsum(new)])
            yield from flush([c[:last] for c in cols], run[:last])
            held, count, size = [[c[last:] for c in cols]], len(cols[0]) - last, 0
        if held:
            cols = [np.concatenate(c) for c in zip(*held)]
            yield from flush(cols, np.concatenate([[0], np.cumsum(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0))]))

    groups = dealt.repartition(n_partitions, *names).sortWithinPartitions(*names, "node")
    return groups.mapInArrow(compare, "a string, b string")


def _rooted(nodes: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, first, _root) of nodes with what is least in each, and (_root, first): the least of all nodes that the links
    join."""
    nodes = materialize(nodes, "nodes")
    joined = components(found, "simhash").withColumnRenamed("node", "_node")
    rooted = nodes.join(joined, F.col("node") == F.col("_node"), "left").select("node", F.coalesce("component", "node").alias("_root"), F.col("first").alias("_own"))
    # written before the join, so that Spark can split a large component's rows
    roots = materialize(rooted.groupBy("_root").agg(F.min("_own").alias("first")), "roots")
    return rooted.select("node", "_root"), roots


def near_duplicates(df: DataFrame, id_column: str, text_column: str, words: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """(id, fp, component) for every row; component is the smallest id reachable over links of fingerprints at most
    ``radius`` bits apart, the row's own included.

    Null and empty texts have fingerprint 0, which links like any other. Rows with a null id belong to components too;
    null is never the smallest unless all ids are null. Repeated rows are returned as often as they come; an empty
    table gives an empty result.
    """
    fps = materialize(fingerprints(df, id_column, text_column, words, seed), "fingerprints")
    found = links(block_keys(fps.select("fp").distinct(), radius), radius)
    named = fps.withColumn("node", F.lpad(F.hex("fp"), 16, "0"))
    nodes, roots = _rooted(named.groupBy("node").agg(F.min(id_column).alias("first")), found)
    return named.join(nodes.join(roots, "_root").select("node", F.col("first").alias("component")), "node").select(id_column, "fp", "component")


def radius_of(similarity: float, bits: int) -> int:
    """Differing bits of two SimHashes at a Jaccard similarity of equally large sets: the mean and six deviations more,
    since it is a filter of candidates (sets of a few shingles differ in more bits than the mean of large ones)."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * share + 6 * math.sqrt(bits * share * (1 - share)))


def similar(df: DataFrame, id_column: str, text_column: str, words: int = 5, similarity: float = 0.8, bits: int = 256, bands: int = 20, rows: int = 3) -> DataFrame:
    """(id, mark, component): documents in components of links between word-shingle sets that are ``similarity`` alike or
    more; ``mark`` is xxhash64 of the text, which tells apart rows of one id, and component the smallest id.

    Min-hash bands make the buckets (a pair of similarity 0.8 shares none of twenty bands of three with probability
    6e-7); in them SimHashes of 256 bits are compared bit-sliced, and pairs within the radius are linked if the Jaccard
    similarity of their sets is as asked. Texts that differ only in case and white space are one node. Null texts count
    as empty, and all empty texts are copies of each other.
    """
    return _similar(df, id_column, text_column, words, similarity, bits, bands, rows)[0]


def _similar(df: DataFrame, id_column: str, text_column: str, words: int = 5, similarity: float = 0.8, bits: int = 256, bands: int = 20, rows: int = 3) -> tuple[DataFrame, DataFrame]:
    """``similar``'s result, and (id, mark) of the one document that stands for each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "_text", CHUNK):
                got = [sketch((t or "").encode(), words, bits, bands, rows) for t in batch.column("_text").to_pylist()]
                keys = pa.array([np.array(g[2], np.uint64).view(np.int64) for g in got], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_mark"), batch.column("_size"), pa.array([g[0] for g in got]), pa.array([g[1] for g in got], pa.binary()), keys], ["_id", "_mark", "_size", "node", "bits", "keys"])

    kind = df.schema[id_column].dataType.simpleString()
    text = F.coalesce(F.col(text_column), F.lit(""))
    texts = df.select(F.col(id_column).alias("_id"), F.xxhash64(text).alias("_mark"), F.octet_length(text).cast("long").alias("_size"), text.alias("_text"))
    sketches = materialize(texts.mapInArrow(run, f"_id {kind}, _mark long, _size long, node string, bits binary, keys array<long>"), "sketches")
    distinct = sketches.groupBy("node").agg(F.first("bits").alias("bits"), F.first("keys").alias("keys"), F.max("_size").alias("size"))
    keyed = distinct.select("node", "bits", "size", F.posexplode("keys").alias("j", "key")).select("j", "key", "node", "bits", "size")
    dealt = materialize(_dealt(keyed), "dealt")
    # the text of one document stands for each node that is compared
    chosen = sketches.join(dealt.select("node").distinct(), "node").groupBy("node").agg(F.min(F.struct("_id", "_mark")).alias("m"))
    chosen = chosen.select("node", F.col("m._id").alias("_i"), F.col("m._mark").alias("_m"))
    found = texts.join(chosen, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_mark") == F.col("_m")))
    told = materialize(found.select("node", F.col("_text").alias("text")).dropDuplicates(["node"]), "told")
    compared = _compared(dealt.join(told, "node").select(*dealt.columns, "text"), radius_of(similarity, bits), words, similarity)
    nodes, roots = _rooted(sketches.groupBy("node").agg(F.min(_first("_id", "_mark")).alias("first")), compared)
    classes = sketches.select("_id", "_mark", "node").join(nodes.join(roots, "_root").select("node", F.col("first._id").alias("component")), "node")
    return classes.select(F.col("_id").alias(id_column), F.col("_mark").alias("mark"), "component"), roots.select("first._id", "first._mark")


def _first(id_column: str, mark: str) -> Column:
    """What the earliest row has least: its id, then its text's mark; null ids come last."""
    return F.struct(F.col(id_column).isNull().alias("unknown"), F.col(id_column).alias("_id"), F.col(mark).alias("_mark"))


def keep_one(df: DataFrame, id_column: str, text_column: str, **options) -> DataFrame:
    """The rows of one document of each component (see ``similar``), that of the smallest id; all other rows go.

    A document is an id with a text: a row whose id is kept elsewhere with another text stays or goes by its own text's
    component, and among texts of the smallest id one is kept. Rows that repeat the kept document stay as often as they
    come. An empty table stays empty.
    """
    kept = _similar(df, id_column, text_column, **options)[1].withColumnsRenamed({"_id": "_kept_id", "_mark": "_kept_mark"})
    mark = F.xxhash64(F.coalesce(F.col(text_column), F.lit("")))
    return df.join(kept, F.col(id_column).eqNullSafe(F.col("_kept_id")) & (mark == F.col("_kept_mark")), "left_semi").select(*df.columns)
