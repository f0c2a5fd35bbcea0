"""Exact removal of repeated strings by external induced suffix sorting.

Every string of ``length`` symbols (bytes, or whole words) that starts at two or more places is found, over all documents,
by recursive induction from sampled suffixes.

1. Sampling. A position is sampled when the hash of what stands there is the least of some run of ``window`` positions.
   Which position a string samples depends on its symbols alone, so equal strings sample equal places; each start of a
   ``length``-symbol string is served by one sampled position, its anchor, at most window - 1 symbols further on.
2. Grouping. Anchors are named by the digest of the symbols that all strings served by them share (the core). Spark counts
   the names and keeps those that come twice. Anchors whose whole neighbourhoods agree are counted as one.
3. Recursion. A name with more than GROUP different neighbourhoods is halved: for each half of the offsets its strings
   share a longer core, so its contexts are named, counted and grouped anew, until groups are small or a core is the whole
   string. No task ever gets such a group, however many rows one passage holds.
4. Induction. Spark sorts the other contexts by (name, symbols after the core) with its spilling sort. The order of the
   suffixes that start o symbols before an anchor follows from that of those o - 1 symbols before it, by the preceding
   symbol. Level by level, a queue on disk takes the suffix tuples (segment, preceding symbol, rank, common prefix, place)
   and gives them back in order; the common prefix of new neighbours is the least between their old ranks, carried along
   as the tuples stream by. A start is repeated when its suffix shares ``length`` symbols with a neighbour's. A task holds
   QUEUE_ROWS tuples and a batch of contexts, whatever its shard's size; everything else is in files where Spark spills.

Names are 64-bit digests that only group candidates; neighbourhoods count as equal by two digests (128 bits). Words count
as equal by their 64-bit digests, ``length`` of them in a row.
"""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, partitions, pieces

#: Positions that share a sampled one, by unit; the strings sought are longer.
WINDOWS = {"bytes": 256, "words": 32}
#: Tuples that a task's queue holds in memory before it writes a sorted run to disk.
QUEUE_ROWS = 1 << 18
#: Different neighbourhoods of a core that a task takes; Spark halves larger groups (some 32 MB of contexts).
GROUP = 1 << 16
CHUNK = 2 << 20
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SPANS = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer"))
#: Larger than any common prefix.
FAR = 1 << 40


def symbols(raw: bytes, unit: str) -> np.ndarray:
    """The bytes, or a digest for each word."""
    if unit == "bytes":
        return np.frombuffer(raw, np.uint8)
    return np.array(list(map(xxhash.xxh3_64_intdigest, raw.split())), np.uint64)


def sample(data: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a document's strings of ``length`` symbols: their positions, and the first and last start they serve."""
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 3
    if data.dtype == np.uint8:
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        word = np.zeros(n, np.uint64)
        for j in range(8):
            word |= padded[j : j + n].astype(np.uint64) << np.uint64(8 * j)
        reach = n - 7
    else:
        word, reach = data, n
    h = word * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    least = ((h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64))[:reach]  # the leftmost on ties
    width = 1
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if window > width:
        least = np.minimum(least[: width - window], least[window - width :])
    at = (least[: n - length + 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], first, np.concatenate([first[1:], [len(at)]]) - 1


def anchors(df: DataFrame, length: int, window: int, unit: str) -> DataFrame:
    """(name, near, id, digest, at, low, high): a row for each anchor of each text, which serves the starts ``low`` to
    ``high`` symbols before it; ``near`` is the digest of all symbols of those strings, with their places, and
    (id, digest) tells the document."""
    core = length - window + 1
    kind = df.schema["_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "_text", CHUNK):
                cols: list[list] = [[], [], [], [], [], [], []]
                for key, digest, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    data = symbols((text or "").encode(), unit)
                    at, first, last = sample(data, length, window)
                    raw, w = data.tobytes(), data.itemsize
                    for p, a, b in zip(at.tolist(), first.tolist(), last.tolist()):
                        cols[0].append(xxhash.xxh3_64_intdigest(raw[p * w : (p + core) * w]))
                        cols[1].append(xxhash.xxh3_64_intdigest(raw[a * w : (b + length) * w], p - a))
                    cols[2] += [key] * len(at)
                    cols[3] += [digest] * len(at)
                    cols[4].append(at)
                    cols[5].append(at - last)
                    cols[6].append(at - first)
                if cols[0]:
                    longs = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in cols[:2]]
                    ints = [pa.array(np.concatenate(c).astype(np.int32)) for c in cols[4:]]
                    yield pa.RecordBatch.from_arrays([*longs, pa.array(cols[2], batch.schema.field("_id").type), pa.array(cols[3], pa.int64()), *ints], schema.names)

    schema = T.StructType().add("name", "long").add("near", "long").add("_id", kind).add("_digest", "long").add("at", "integer").add("low", "integer").add("high", "integer")
    return df.select("_id", "_digest", "_text").mapInArrow(run, schema)


def scratch() -> tempfile.TemporaryDirectory:
    """A folder for what a task spills, where Spark keeps its own spills; no other task reads it, and it goes with the task."""
    own = [d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(d)]
    return tempfile.TemporaryDirectory(prefix="queue-", dir=own[0] if own else None)


class SortQueue:
    """A priority queue on disk of rows of integers, in the order of their first three columns.

    It takes sorted runs and gives all rows back, block by block, in order. Beyond ``limit`` rows the runs that it holds
    become a file; files are merged as they are read, so that memory is bounded by the limit.
    """

    def __init__(self, folder: str, limit: int):
        self.folder, self.limit = folder, limit
        self.held: list[np.ndarray] = []
        self.count = 0
        self.files: list[str] = []

    def push(self, rows: np.ndarray) -> None:
        """Adds rows that are in order among themselves."""
        for i in range(0, len(rows), self.limit):
            self.held.append(rows[i : i + self.limit])
            self.count += len(self.held[-1])
            if self.count >= self.limit:
                self._spill()

    def __bool__(self) -> bool:
        return bool(self.count or self.files)

    def _merged(self) -> np.ndarray:
        held, self.held, self.count = self.held, [], 0
        if len(held) == 1:
            return held[0]
        rows = np.concatenate(held)
        return rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]

    def _spill(self) -> None:
        handle, path = tempfile.mkstemp(suffix=".npy", dir=self.folder)
        os.close(handle)
        np.save(path, self._merged())
        self.files.append(path)

    def drain(self) -> Iterator[np.ndarray]:
        """All rows in order, in blocks; the queue is empty and its files are gone afterwards."""
        if not self.files:
            if self.count:
                yield self._merged()
            return
        if self.count:
            self._spill()
        runs = [np.load(p, mmap_mode="r") for p in self.files]
        starts = [0] * len(runs)
        step = max(1, self.limit // len(runs))
        while any(s < len(r) for s, r in zip(starts, runs)):
            x, y, z = min(tuple(r[min(s + step, len(r)) - 1, :3].tolist()) for s, r in zip(starts, runs) if s < len(r))
            parts = []  # what is certainly before all that is still on disk
            for i, r in enumerate(runs):
                part = np.asarray(r[starts[i] : starts[i] + step])
                n = int(np.count_nonzero((part[:, 0] < x) | ((part[:, 0] == x) & ((part[:, 1] < y) | ((part[:, 1] == y) & (part[:, 2] <= z))))))
                parts.append(part[:n])
                starts[i] += n
            block = np.concatenate(parts)
            yield block[np.lexsort((block[:, 2], block[:, 1], block[:, 0]))]
        del runs
        for path in self.files:
            os.unlink(path)
        self.files = []


class Minima:
    """The common prefixes of new neighbours: for each tuple the least prefix since the last one of the same segment that
    has the same preceding symbol. Between blocks it keeps a number for each symbol of the segment that is still open."""

    def __init__(self) -> None:
        self.symbol, self.least = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def take(self, segment: np.ndarray, prefix: np.ndarray, chosen: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For a block of tuples, of which ``chosen`` go on with the preceding ``symbol``: their places in the block in the
        order of (segment, symbol, rank), and their new prefixes, -1 where a new segment begins."""
        order = np.lexsort((symbol, segment[chosen]))
        i, c = chosen[order], symbol[order]
        s = segment[i]
        first = np.concatenate([[True], (s[1:] != s[:-1]) | (c[1:] != c[:-1])])[: len(i)]
        out = np.full(len(i), -1, np.int64)
        again = np.flatnonzero(~first)
        if len(again):
            spans = np.stack([i[again - 1] + 1, i[again] + 1], 1).ravel()
            out[again] = np.minimum.reduceat(np.concatenate([prefix, [FAR]]), spans)[::2]
        goes_on = prefix[0] >= 0  # the block begins within the segment that was open
        if goes_on and len(self.symbol):
            here = np.flatnonzero(first & (s == segment[0]))
            found = np.minimum(np.searchsorted(self.symbol, c[here]), len(self.symbol) - 1)
            known = self.symbol[found] == c[here]
            here, found = here[known], found[known]
            out[here] = np.minimum(self.least[found], np.minimum.accumulate(prefix)[i[here]])
        last = np.flatnonzero(np.concatenate([first[1:], [True]])[: len(i)] & (s == segment[-1]))
        after = np.concatenate([np.minimum.accumulate(prefix[::-1])[::-1], [FAR]])
        new_symbol, new_least = c[last], after[i[last] + 1]
        if goes_on and segment[0] == segment[-1] and len(self.symbol):
            old = ~np.isin(self.symbol, new_symbol)
            new_symbol = np.concatenate([new_symbol, self.symbol[old]])
            new_least = np.concatenate([new_least, np.minimum(self.least[old], after[0])])
        order = np.argsort(new_symbol, kind="stable")
        self.symbol, self.least = new_symbol[order], new_least[order]
        return i, out


class Shard:
    """The contexts of one task, in files, and the repeated starts that induction finds among them.

    Contexts come sorted by group and then by the symbols after the core (at most ``tail``). Offset o stands for the string
    that starts o symbols before the anchor; it is repeated when a context of the group shares the o symbols before the
    anchor and tail - o symbols after the core.
    """

    def __init__(self, folder: str, tail: int, symbol: np.dtype, limit: int = QUEUE_ROWS):
        self.folder, self.tail, self.symbol, self.limit = folder, tail, np.dtype(symbol), limit
        self.record = np.dtype([("low", "<i4"), ("high", "<i4"), ("left", self.symbol, (tail,))])
        self.file = open(f"{folder}/contexts", "wb")
        self.count = 0
        self.segment = -1
        self.last: tuple[int, np.ndarray, int] | None = None
        self.queue = SortQueue(folder, limit)

    def _rows(self, values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(v) // self.symbol.itemsize for v in values], np.int64)
        out = np.zeros((len(values), self.tail), self.symbol)
        out[np.arange(self.tail)[None, :] < size[:, None]] = np.frombuffer(b"".join(values), self.symbol)
        return out, size

    def add(self, group: np.ndarray, right: list[bytes], left: list[bytes], low: np.ndarray, high: np.ndarray) -> None:
        """The next contexts in order; ``left`` has the preceding symbols, nearest first, ``high`` of them at least."""
        n = len(group)
        if not n:
            return
        record = np.zeros(n, self.record)
        record["left"], record["low"], record["high"] = self._rows(left)[0], low, high
        record.tofile(self.file)
        text, size = self._rows(right)
        before = self.last or (int(group[0]) ^ 1, np.zeros(self.tail, self.symbol), 0)
        self.last = int(group[-1]), text[-1], int(size[-1])
        group = np.concatenate([[before[0]], group])
        text, size = np.concatenate([before[1][None, :], text]), np.concatenate([[before[2]], size])
        same = text[1:] == text[:-1]
        common = np.minimum(np.where(same.all(1), self.tail, same.argmin(1)), np.minimum(size[1:], size[:-1]))
        new = group[1:] != group[:-1]
        segment = self.segment + np.cumsum(new)
        self.segment = int(segment[-1])
        rank = self.count + np.arange(n)
        self.queue.push(np.stack([segment, np.zeros(n, np.int64), rank, np.where(new, -1, common), rank], 1))
        self.count += n

    def solve(self) -> np.ndarray:
        """Which starts are repeated: a matrix of offsets by contexts, in a file."""
        self.file.close()
        contexts = np.memmap(f"{self.folder}/contexts", self.record, "r", shape=(self.count,))
        found = np.memmap(f"{self.folder}/found", bool, "w+", shape=(self.tail + 1, self.count))
        queue = self.queue
        for o in range(self.tail + 1):
            following, minima = SortQueue(self.folder, self.limit), Minima()
            segment_of, rank, before = -1, 0, -1
            for block in queue.drain():
                prefix, place = block[:, 3], block[:, 4]
                new = prefix < 0
                segment = segment_of + np.cumsum(new)
                hit = np.flatnonzero(prefix >= self.tail - o)
                rows = np.concatenate([place[hit], np.where(hit > 0, place[hit - 1], before)])
                rows = rows[(contexts["low"][rows] <= o) & (o <= contexts["high"][rows])]
                found[o, rows] = True
                if o < self.tail:
                    # contexts that end here, and those alone in their segment, share nothing further to the left
                    alone = new & np.concatenate([new[1:], [False]])
                    going = np.flatnonzero((contexts["high"][place] > o) & ~alone)
                    i, least = minima.take(segment, prefix, going, contexts["left"][place[going], o].astype(np.int64))
                    following.push(np.stack([segment[i], contexts["left"][place[i], o].astype(np.int64), rank + i, least, place[i]], 1))
                segment_of, rank, before = int(segment[-1]), rank + len(block), int(place[-1])
            queue = following
            if not queue:
                break
        return found


def _edges(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of True of a matrix of contexts by offsets: the row, the first and the last offset of each."""
    edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def _packed(df: DataFrame) -> DataFrame:
    """df with its last column, _text, replaced by ``packed``: the bytes, compressed for the shuffle of a join."""
    schema = T.StructType([*df.schema.fields[:-1], T.StructField("packed", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for whole in batches:
            for batch in pieces(whole, "_text", CHUNK):
                packed = [squeeze((t or "").encode()) for t in batch.columns[-1].to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(packed, pa.binary())], schema.names)

    return df.mapInArrow(run, schema)


def _context_schema(id_type: T.DataType) -> T.StructType:
    schema = T.StructType().add("name", "long").add("near", "long").add("_id", id_type).add("_digest", "long")
    for c in ("at", "low", "high"):
        schema = schema.add(c, "integer")
    return schema.add("n", "long").add("rest", "binary").add("before", "binary")


def _contexts(mixed: DataFrame, texts: DataFrame, length: int, window: int, unit: str) -> DataFrame:
    """The symbols around the anchors of ``mixed``: a join with the documents, once for each document."""
    core = length - window + 1
    wanted = mixed.groupBy("_id", "_digest").agg(F.collect_list(F.struct("name", "near", "at", "low", "high", "n")).alias("wanted"))
    joined = _packed(texts).join(wanted.withColumnsRenamed({"_id": "_i", "_digest": "_d"}), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_digest") == F.col("_d")))
    schema = _context_schema(mixed.schema["_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        types = [pa.int64(), pa.int64(), None, pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        for whole in batches:
            for batch in pieces(whole, "packed", CHUNK >> 2):
                types[2] = batch.schema.field("_id").type
                rows = []
                for key, digest, packed, found in zip(*(c.to_pylist() for c in batch.columns)):
                    data = symbols(expand(packed), unit)
                    raw, back, w, n = data.tobytes(), data[::-1].tobytes(), data.itemsize, len(data)
                    for x in found:
                        at, low, high = x["at"], x["low"], x["high"]
                        right, left = raw[(at + core) * w : (at - low + length) * w], back[(n - at) * w : (n - at + high) * w]
                        rows.append((x["name"], x["near"], key, digest, at, low, high, x["n"], right, left))
                for i in range(0, len(rows), 8192):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 8192]), types)], schema.names)

    return joined.select("_id", "_digest", "packed", "wanted").mapInArrow(run, schema)


def _halved(contexts: DataFrame, tail: int, w: int) -> DataFrame:
    """Contexts once for each half of the offsets that they serve; the strings of a half share a core that is longer by
    tail - tail // 2 symbols. Names and neighbourhoods are those of the half."""
    half = tail // 2
    schema = _context_schema(contexts.schema["_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64
        for whole in batches:
            for batch in pieces(whole, "rest", CHUNK):
                rows = []
                for name, _, key, mark, at, low, high, n, rest, before in zip(*(c.to_pylist() for c in batch.columns)):
                    for lo in (0, tail - half):
                        a, b = max(low, lo), min(high, lo + half)
                        if a > b:
                            continue
                        shared = rest[: (tail - lo - half) * w]
                        own = rest[(tail - lo - half) * w : (tail - a) * w], before[lo * w : b * w]
                        core = digest(name.to_bytes(8, "little", signed=True) + lo.to_bytes(4, "little") + before[: lo * w] + shared)
                        near = digest((a - lo).to_bytes(4, "little") + (b - lo).to_bytes(4, "little") + own[1] + own[0])
                        rows.append((core.intdigest(), near.intdigest(), key, mark, at - lo, a - lo, b - lo, n, *own))
                if rows:
                    name, near, *others = zip(*rows)
                    longs = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in (name, near)]
                    yield pa.RecordBatch.from_arrays([*longs, *(pa.array(c, f.type) for c, f in zip(others, list(batch.schema)[2:]))], schema.names)

    return contexts.select(*schema.names).mapInArrow(run, schema)


def _induced(contexts: DataFrame, tail: int, symbol: str) -> DataFrame:
    """(id, digest, start, end): runs of repeated starts of contexts that come once, by induction in each shard."""
    schema = T.StructType().add("_id", contexts.schema["_id"].dataType).add("_digest", "long").add("start", "integer").add("end", "integer")
    limit = QUEUE_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with scratch() as folder:
            shard, writer = Shard(folder, tail, np.dtype(symbol), limit), None
            for batch in batches:
                for i in range(0, batch.num_rows, 8192):
                    part = batch.slice(i, 8192)
                    own = part.select(["_id", "_digest", "at", "n"])
                    writer = writer or pa.ipc.new_stream(f"{folder}/places", own.schema)
                    writer.write_batch(own)
                    group, low, high = (part.column(c).to_numpy() for c in ("name", "low", "high"))
                    shard.add(group, part.column("rest").to_pylist(), part.column("before").to_pylist(), low, high)
            if not writer:
                return
            writer.close()
            found, start = shard.solve(), 0
            for part in pa.ipc.open_stream(f"{folder}/places"):
                at, once = part.column("at").to_numpy(), part.column("n").to_numpy() == 1  # else all their starts count already
                row, first, last = _edges(np.ascontiguousarray(found[:, start : start + part.num_rows].T) & once[:, None])
                start += part.num_rows
                if len(row):
                    keys = part.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([keys.column(0), keys.column(1), pa.array((at[row] - last).astype(np.int32)), pa.array((at[row] - first).astype(np.int32))], schema.names)

    ordered = contexts.repartition(partitions(contexts.sparkSession), "name").sortWithinPartitions("name", "rest")
    return ordered.mapInArrow(run, schema)


def _starts(rows: DataFrame) -> DataFrame:
    return rows.select("_id", "_digest", (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low")).alias("end"))


def _grouped(rows: DataFrame, payload: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Runs of starts of rows whose neighbourhood comes again, and the neighbourhoods of the names with several: a row for
    each, with ``n``, how often it comes, and ``k``, how many its name has."""
    # written before they are joined, so that both sides are plain shuffles and Spark can split a frequent name's rows
    near = materialize(rows.groupBy("name", "near").agg(F.sum("n").alias("n"), F.min(F.struct(*payload)).alias("x")), "neighbourhoods")
    kinds = materialize(near.groupBy("name").agg(F.count("*").alias("k")).filter("k > 1"), "mixed")
    whole = _starts(rows.filter("n = 1").join(near.filter("n > 1").select("name", "near"), ["name", "near"]))
    return whole, near.join(kinds, "name").select("name", "near", "n", "k", "x.*")


def repeated_spans(df: DataFrame, length: int, window: int | None = None, unit: str = "bytes") -> DataFrame:
    """(id, digest, spans): what to remove of each document that has any, as [start, end) pairs of symbols.

    df has _id, _digest (of id and text) and _text. Only documents with a span are returned; spans may overlap.
    """
    window = min(window or WINDOWS[unit], length - 7 if unit == "bytes" else length)
    if window < 1:
        raise ValueError("strings of 8 bytes or one word at least can be sought")
    symbol, tail = np.dtype(np.uint8 if unit == "bytes" else np.uint64), window - 1
    texts = df.select("_id", "_digest", "_text")
    # written once: both the count of names and the rows of those that come twice are taken from it
    found = materialize(anchors(texts, length, window, unit).withColumn("n", F.lit(1).cast("long")), "found")
    twice = materialize(found.groupBy("name").agg(F.count("*").alias("c")).filter("c > 1").select("name"), "names")
    multi = materialize(found.join(twice, "name"), "anchors")
    discard(found)
    whole, mixed = _grouped(multi, ("_digest", "_id", "at", "low", "high"))
    out = [whole, _induced(_contexts(mixed.filter(F.col("k") <= GROUP), texts, length, window, unit), tail, symbol.str)]
    hot, passing = mixed.filter(F.col("k") > GROUP), [twice, multi]
    if not hot.isEmpty():
        hot = materialize(_contexts(hot, texts, length, window, unit), "contexts")
        while True:
            split = materialize(_halved(hot, tail, symbol.itemsize), "halves")
            tail //= 2
            whole, mixed = _grouped(split, ("_digest", "_id", "at", "low", "high", "rest", "before"))
            names = _context_schema(split.schema["_id"].dataType).names
            out += [whole, _induced(mixed.filter(F.col("k") <= GROUP).select(*names), tail, symbol.str)]
            passing += [split, hot]
            hot = mixed.filter(F.col("k") > GROUP).select(*names)
            if hot.isEmpty():
                break
            hot = materialize(hot, "contexts")
    every = out[0]
    for more in out[1:]:
        every = every.union(more)
    starts = materialize(every, "starts")
    discard(*passing)
    return starts.groupBy("_id", "_digest").agg(F.collect_list(F.struct("start", (F.col("end") + length).alias("end"))).alias("spans"))


def _merge(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _in_bytes(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as spans of bytes, up to the next word that stays."""
    words = [m.span() for m in WORD.finditer(raw)]
    return [(words[a][0], words[b][0] if b < len(words) else words[-1][1]) for a, b in spans]


def _cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]])


def remove_repeats(
    df: DataFrame,
    id_column: str,
    text_column: str,
    length: int = 400,
    window: int | None = None,
    carry: tuple[str, ...] = (),
    unit: str = "bytes",
    passages: int | None = None,
) -> DataFrame:
    """(id, carried columns, n_bytes, n_removed, n_spans, spans, longest, n_passages, passage_words, kept binary) for every
    row: the text without each symbol that a string of ``length`` symbols covers which also starts anywhere else, in the
    same row or another.

    With unit "bytes" texts are judged as UTF-8 bytes as they come (null: empty), so a cut may fall inside a character and
    ``kept`` is binary. With unit "words" symbols are words, whatever white space parts them; a cut reaches up to the next
    word that stays, so kept is valid UTF-8. ``spans`` are bytes of the original text, n_removed counts bytes, ``longest``
    is the longest run removed, in symbols. With ``passages`` the runs of as many words or more that come again are counted
    too, but not removed: how many there are, and their words; else these columns are null. Repeated rows are copies of
    each other. Rows of one id with different texts are different documents. An empty table gives an empty result. A carried
    column may have any name that isn't one of the result's.
    """
    digest = F.xxhash64(id_column, text_column)
    renamed = [F.col(c).alias(f"_carry{i}") for i, c in enumerate(carry)]
    rows = df.select(F.col(id_column).alias("_id"), digest.alias("_digest"), *renamed, F.col(text_column).alias("_text"))
    spans = repeated_spans(rows, length, window, unit).select("_id", "_digest", "spans", F.lit(None).cast(SPANS).alias("passages"))
    if passages:
        more = repeated_spans(rows, passages, unit="words").select("_id", "_digest", F.lit(None).cast(SPANS).alias("spans"), F.col("spans").alias("passages"))
        spans = spans.union(more).groupBy("_id", "_digest").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("spans", "passages")))
    spans = spans.withColumnsRenamed({"_id": "_id2", "_digest": "_digest2"})
    joined = _packed(rows).join(spans, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_digest") == F.col("_digest2")), "left").drop("_id2", "_digest", "_digest2")
    schema = T.StructType([rows.schema["_id"], *(rows.schema[f"_carry{i}"] for i in range(len(carry)))])
    for c in ("n_bytes", "n_removed", "n_spans"):
        schema = schema.add(c, "long")
    schema = schema.add("spans", SPANS).add("longest", "long").add("n_passages", "long").add("passage_words", "long").add("kept", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for whole in batches:
            for part in pieces(whole, "packed", CHUNK):
                out = []
                for packed, found, shared in zip(*(part.column(c).to_pylist() for c in ("packed", "spans", "passages"))):
                    raw, merged, shared = expand(packed), _merge(found or []), _merge(shared or [])
                    longest = max((b - a for a, b in merged), default=0)
                    merged = _in_bytes(raw, merged) if merged and unit == "words" else merged
                    kept = _cut(raw, merged)
                    words = (len(shared), sum(b - a for a, b in shared)) if passages else (None, None)
                    out.append((len(raw), len(raw) - len(kept), len(merged), [{"start": a, "end": b} for a, b in merged], longest, *words, kept))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carry) + 1], *(pa.array(c, t) for c, t in zip(zip(*out), types))], schema.names)

    names = {"_id": id_column} | {f"_carry{i}": c for i, c in enumerate(carry)}
    return joined.mapInArrow(run, schema).withColumnsRenamed(names)
