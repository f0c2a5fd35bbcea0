"""Best-fit packing of documents into sequences by a linear grouping scheme.

Lengths are bounded by the capacity, so their histogram is all that the plan needs: at most ``capacity`` counts come to
the driver, whatever the corpus holds. Large lengths are dealt into groups of equal cardinality and rounded up to their
group's greatest; configurations of the few rounded sizes are optimised by column generation; actual lengths take the
rounded places, and what is left, small ones above all, goes best-fit into the gaps. The plan says which ranks of each
length go to which run of sequences; documents get their ranks from a distributed sort and look their places up.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import global_rank, materialize, pieces

#: Groups of large lengths; more groups waste less in rounding and take longer to optimise.
GROUPS = 128
#: Lengths of at most this share of the capacity are small: they only fill gaps.
SMALL = 0.45
CHUNK = 4 << 20


def _knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of most worth within the capacity."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(sizes.min()), capacity + 1):
        fit = sizes <= c
        value = np.where(fit, best[np.where(fit, c - sizes, 0)] + worth, -1.0)
        k = int(value.argmax())
        best[c], choice[c] = (value[k], k) if value[k] > best[c - 1] + 1e-12 else (best[c - 1], -1)
    taken, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            taken[choice[c]] += 1
            c -= int(sizes[choice[c]])
    return float(best[capacity]), taken


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Columns (configurations) and how often each is used, for the least number of sequences, by column generation."""
    columns = np.diag(capacity // sizes).astype(float)
    times = demand / np.diag(columns)
    for _ in range(rounds):
        worth = np.linalg.solve(columns.T, np.ones(len(sizes)))
        value, taken = _knapsack(sizes, np.maximum(worth, 0), capacity)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(columns, taken.astype(float))
        ratio = np.where(step > 1e-9, times / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(ratio.argmin())
        grow = ratio[leave]
        times = np.maximum(times - grow * step, 0)
        times[leave] = grow
        columns[:, leave] = taken
    return columns.astype(np.int64), times


class _Bins:
    """Sequences in blocks of equal contents: (times, lengths placed in order), by the gap that is left."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_gap: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
        self.gaps: list[int] = []

    def add(self, times: int, lengths: tuple[int, ...]) -> None:
        gap = self.capacity - sum(lengths)
        if gap not in self.by_gap:
            self.by_gap[gap] = []
            insort(self.gaps, gap)
        self.by_gap[gap].append((times, lengths))

    def best_fit(self, length: int, count: int) -> None:
        """Place so many documents of a length, each in the smallest gap that holds it."""
        while count:
            i = bisect_left(self.gaps, length)
            if i == len(self.gaps):
                each = min(self.capacity // length, count)
                self.add(count // each, (length,) * each)
                if count % each:
                    self.add(1, (length,) * (count % each))
                return
            gap = self.gaps[i]
            times, lengths = self.by_gap[gap].pop()
            if not self.by_gap[gap]:
                del self.by_gap[gap]
                self.gaps.pop(i)
            used = min(times, count)
            if used < times:
                self.add(times - used, lengths)
            self.add(used, (*lengths, length))
            count -= used


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Blocks (times, lengths): sequences of those contents, holding exactly the lengths counted."""
    left = {n: c for n, c in sorted(counts.items()) if c > 0}
    bins = _Bins(capacity)
    if full := left.pop(capacity, 0):
        bins.add(full, (capacity,))
    large = [n for n in left if n > capacity * SMALL]
    total = sum(left[n] for n in large)
    if total:
        # groups of equal cardinality along the descending lengths, as runs (length, count)
        groups: list[list[list[int]]] = []
        each, room = -(-total // GROUPS), 0
        for n in reversed(large):
            c = left[n]
            while c:
                if not room:
                    groups.append([])
                    room = each
                take = min(c, room)
                groups[-1].append([n, take])
                c, room = c - take, room - take
        merged: dict[int, list[list[int]]] = {}
        for g in groups:  # groups that are rounded to one size are one
            merged.setdefault(g[0][0], []).extend(g)
        sizes = np.array(list(merged), np.int64)
        queues = list(merged.values())
        demand = np.array([sum(c for _, c in q) for q in queues], float)
        columns, times = configurations(sizes, demand, capacity)
        for j in np.argsort(-times):
            uses = int(times[j] + 1e-9)
            slots = [k for k in range(len(sizes)) for _ in range(int(columns[k, j]))]
            slots.sort(key=lambda k: -sizes[k])
            while uses > 0 and slots:
                heads, need, sub = [], {}, uses
                for k in slots:
                    need[k] = need.get(k, 0) + 1
                for k, per in need.items():  # as many sequences as the heads of the queues can serve alike
                    if not queues[k]:
                        sub = 0
                        break
                    if queues[k][0][1] >= per:
                        sub = min(sub, queues[k][0][1] // per)
                    else:
                        sub = min(sub, 1)
                if not sub:
                    break
                short = False
                for k, per in need.items():
                    if queues[k][0][1] >= per * sub:
                        heads += [queues[k][0][0]] * per
                        queues[k][0][1] -= per * sub
                    else:  # one sequence over the end of a run
                        got = 0
                        while got < per and queues[k]:
                            take = min(per - got, queues[k][0][1])
                            heads += [queues[k][0][0]] * take
                            queues[k][0][1] -= take
                            got += take
                            if not queues[k][0][1]:
                                queues[k].pop(0)
                        short |= got < per
                    if queues[k] and not queues[k][0][1]:
                        queues[k].pop(0)
                bins.add(sub, tuple(sorted(heads, reverse=True)))
                uses -= sub
                if short:
                    break
        for n in large:
            left[n] = 0
        for q in queues:
            for n, c in q:
                left[n] += c
    for n in sorted(left, reverse=True):
        bins.best_fit(n, left[n])
    return [b for gap in bins.gaps for b in bins.by_gap[gap]]


def segments(blocks: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: rank r of a length is in the last row at or before it."""
    rows, used, sequence = [], {}, 0
    for times, lengths in blocks:
        offset = 0
        for n in lengths:
            rows.append((n, used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


@cache
def _encoding(rank_path: str, pattern: str, special: tuple[tuple[str, int], ...]) -> tiktoken.Encoding:
    with open(rank_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))


def tokenize(df: DataFrame, id_column: str, text_column: str, rank_path: str, pattern: str, special: dict[str, int], end: int, capacity: int) -> DataFrame:
    """(id, piece, start, length, ids_crc32): every text's ids and the end id, cut into pieces of ``capacity`` ids if
    there are more; the first piece takes the remainder. Null texts count as empty and hold the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(rank_path, pattern, tuple(special.items()))
        for whole in batches:
            for batch in pieces(whole, "_text", CHUNK):
                where, piece, start, length, crc = [], [], [], [], []
                for i, text in enumerate(batch.column("_text").to_pylist()):
                    ids = np.append(encoding.encode_to_numpy(text or "", allowed_special="all"), end).astype("<u4")
                    first = len(ids) % capacity or capacity
                    cuts = [0, *range(min(first, len(ids)), len(ids) + 1, capacity)]
                    for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        where.append(i)
                        piece.append(p)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(ids[a:b].tobytes()))
                yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(where, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["_id", "piece", "start", "length", "ids_crc32"])

    schema = T.StructType().add("_id", df.schema[id_column].dataType).add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    rows = df.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_column)


def pack(items: DataFrame, order: list[str], capacity: int) -> DataFrame:
    """Add sequence_id and offset to items with a ``length`` from 1 to capacity.

    ``order`` ranks items of one length; items equal in it are interchangeable. An empty table gives an empty result.
    """
    items = materialize(items, "items")
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    table = segments(plan(counts, capacity))
    before, total = {}, 0
    for n in sorted(counts):
        before[n] = total
        total += counts[n]
    start = np.array([before.get(int(n), 0) for n in table[:, 0]], np.int64) + table[:, 1]  # global rank of each row
    ranked = global_rank(items, ["length", *order], "_rank", "lengths")
    schema = T.StructType([f for f in ranked.schema.fields if f.name != "_rank"]).add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("_rank").to_numpy()
            at = np.searchsorted(start, rank, side="right") - 1
            sequence = table[at, 2] + rank - start[at] if len(rank) else np.zeros(0, np.int64)
            rest = [batch.column(f.name) for f in schema.fields[:-2]]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(sequence), pa.array(table[at, 3] if len(rank) else sequence)], schema.names)

    return ranked.mapInArrow(place, schema)
