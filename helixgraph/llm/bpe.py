"""Byte-level BPE by a two-tier lookup.

Tier one: a minimal perfect hash maps whole pre-tokens that are in the vocabulary to their ids; a batch's distinct
pre-tokens are looked up together. Tier two: the misses are merged by a heap over a doubly linked list of bytes. Both
work on distinct pre-tokens only, and a bounded memo carries their id strings across the batches of a task.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

#: Distinct pre-tokens whose ids a task remembers; the memo is emptied when it is full.
MEMO = 400_000
#: Bytes of text that a task encodes at once.
CHUNK = 4 << 20


class PerfectHash:
    """A minimal perfect hash of byte strings by hash and displace, with their values and a check of the key.

    Keys fall into buckets of about two; from the largest bucket on, each takes the least displacement that puts its
    keys on free places, and buckets of one key take the places left. Lookups compare 64 bits of the key's digest and then the key itself, so foreign keys miss.
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        n = max(1, len(keys))
        self.n, self.buckets = n, n // 2 + 1
        h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        self.shift = np.zeros(self.buckets, np.uint64)
        self.slot_key: list[bytes | None] = [None] * n
        self.slot_value = np.full(n, -1, np.int64)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        runs = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(keys) else []
        free = np.ones(n, bool)
        for members in sorted(runs, key=len, reverse=True):
            if len(members) == 1:
                break
            for first in range(1, 1 << 20, 32):
                d = np.arange(first, first + 32, dtype=np.uint64)
                at = np.sort(self._place(h[members][None, :], d[:, None]), 1)
                fits = np.flatnonzero(free[at].all(1) & (np.diff(at, axis=1) > 0).all(1))
                if len(fits):
                    break
            else:
                raise ValueError("no displacement found")
            d = d[fits[0] : fits[0] + 1]
            self._put(members, self._place(h[members], d), keys, values, free, bucket, d[0])
        rest = iter(np.flatnonzero(free).tolist())
        for members in runs:
            if len(members) == 1:  # singles take what is left; the high bit says that the displacement is the place
                at = next(rest)
                self._put(members, np.array([at]), keys, values, free, bucket, (1 << 63) | at)

    def _place(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        x = (h ^ (d * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((x >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64)

    def _put(self, members, at, keys, values, free, bucket, d) -> None:
        free[at] = False
        self.shift[bucket[members[0]]] = d
        for i, a in zip(members, at):
            self.slot_key[a], self.slot_value[a] = keys[i], values[i]

    def find(self, keys: list[bytes]) -> list[int]:
        """Each key's value, or -1."""
        if not keys:
            return []
        h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        d = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        direct = d >> np.uint64(63) == 1
        at = np.where(direct, (d & np.uint64((1 << 63) - 1)).astype(np.int64), self._place(h, d))
        at[d == 0] = 0
        values = self.slot_value[at].tolist()
        return [v if self.slot_key[a] == k else -1 for k, a, v in zip(keys, at.tolist(), values)]


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of least rank merges first, the leftmost on ties, by a heap over linked bytes."""
    n = len(word)
    ends = list(range(1, n + 1))  # a part that begins at i ends at ends[i]; 0 once it is merged away
    left = list(range(-1, n - 1))
    get, push, pop = ranks.get, heapq.heappush, heapq.heappop
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = pop(heap)
        middle = ends[i]
        if not middle or middle >= n or ends[middle] != end:
            continue  # one of the two parts has changed since
        ends[i], ends[middle] = end, 0
        if end < n:
            left[end] = i
            if (s := get(word[i : ends[end]])) is not None:
                push(heap, (s, i, ends[end]))
        if (p := left[i]) >= 0 and (s := get(word[p:end])) is not None:
            push(heap, (s, p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : ends[i]]])
        i = ends[i]
    return out


class Encoder:
    """Encodes texts with a rank file; ids are the ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find_all = regex.compile(pattern).findall
        self.hash = PerfectHash(list(ranks), list(ranks.values()))
        self.memo: dict[str, bytes] = {}
        self.vocabulary: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, v in ranks.items():
            self.vocabulary[v] = k

    def _learn(self, words: list[str]) -> None:
        if len(self.memo) + len(words) > MEMO:
            self.memo.clear()
        raw = [w.encode() for w in words]
        for word, key, value in zip(words, raw, self.hash.find(raw)):
            ids = [value] if value >= 0 else merge_bytes(key, self.ranks)
            self.memo[word] = np.array(ids, "<u4").tobytes()

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        out = []
        for text in texts:
            found = self.find_all(text)
            try:
                out.append(b"".join(map(self.memo.__getitem__, found)))
            except KeyError:
                self._learn([w for w in dict.fromkeys(found) if w not in self.memo])
                if any(w not in self.memo for w in found):  # the memo was emptied
                    self._learn(list(dict.fromkeys(found)))
                out.append(b"".join(map(self.memo.__getitem__, found)))
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def encoder(rank_path: str, pattern: str) -> Encoder:
    """The encoder of a rank file (lines of base64 and rank), built once for each Python worker."""
    with open(rank_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Encoder(ranks, pattern)


def round_trip(df: DataFrame, id_column: str, text_column: str, rank_path: str, pattern: str) -> DataFrame:
    """Encode every text and decode its ids: (id, n_tokens, ids_sha256, decoded_sha256).

    Null and empty texts give no ids. rank_path is a vocabulary file that every machine holds at the same place. Other
    columns are not read; repeated rows give repeated results; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(rank_path, pattern)
        for whole in batches:
            for batch in pieces(whole, "_text", CHUNK):
                ids = bpe.encode(t or "" for t in batch.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_id"),
                        pa.array([len(i) // 4 for i in ids], pa.int64()),
                        pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                        pa.array([hashlib.sha256(bpe.decode(i)).hexdigest() for i in ids]),
                    ],
                    ["_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    return rows.mapInArrow(run, f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("_id", id_column)


def encode_column(df: DataFrame, id_column: str, text_column: str, rank_path: str, pattern: str) -> DataFrame:
    """Every text's ids as an array: (id, ids array<int>); null and empty texts give an empty array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(rank_path, pattern)
        for whole in batches:
            for batch in pieces(whole, "_text", CHUNK):
                ids = [np.frombuffer(i, "<u4").astype(np.int32) for i in bpe.encode(t or "" for t in batch.column("_text").to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(ids, pa.list_(pa.int32()))], ["_id", "ids"])

    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    return rows.mapInArrow(run, f"_id {kind}, ids array<int>").withColumnRenamed("_id", id_column)


def decode_column(df: DataFrame, id_column: str, ids_column: str, rank_path: str, pattern: str) -> DataFrame:
    """The bytes of every array of ids: (id, bytes binary); null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(rank_path, pattern)
        for batch in batches:
            out = [None if i is None else bpe.decode(np.array(i, "<u4").tobytes()) for i in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(out, pa.binary())], ["_id", "bytes"])

    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(F.col(id_column).alias("_id"), F.col(ids_column).alias("_ids"))
    return rows.mapInArrow(run, f"_id {kind}, bytes binary").withColumnRenamed("_id", id_column)
