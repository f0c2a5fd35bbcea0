"""Packing: exact coverage, ids equal to the tokenizers library's, few sequences."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from helixgraph.llm import packing, queries


def valid(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def first_fit_decreasing(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        for i, b in enumerate(bins):
            if b + n <= capacity:
                bins[i] += n
                break
        else:
            bins.append(n)
    return len(bins)


def test_plan_holds_the_counts_and_is_tight():
    r = random.Random(0)
    for most, n in ((1024, 20000), (300, 5000), (1024, 50), (1024, 0), (1024, 1)):
        counts = Counter(r.randint(1, most) for _ in range(n))
        blocks = packing.plan(dict(counts), 1024)
        placed = Counter()
        for times, lengths in blocks:
            assert times > 0 and sum(lengths) <= 1024
            for x in lengths:
                placed[x] += times
        assert placed == counts
        used, bound = sum(t for t, _ in blocks), -(-sum(k * v for k, v in counts.items()) // 1024)
        assert used <= max(bound * 1.02 + 1, bound + 3), (used, bound)


def test_sequences_and_ids(spark):
    r = random.Random(1)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [" ".join(r.choices(["alpha", "bêta", "γ", "12", "\n", "don't"], k=r.choice([1, 30, 400, 1500]))) for _ in range(120)]
    texts += [None, "", "word " * 6000, texts[0], texts[0], "a <|endoftext|> b"]
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(None, "no id", 5), (7, texts[7], 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset long")
    out = packing.pack(queries.tokenized(df), ["doc_id", "piece", "ids_crc32"], 1024).collect()
    used = valid(out, 1024)
    got = defaultdict(list)
    for x in out:
        got[x["doc_id"]].append((x["piece"], x["start"], x["length"], x["ids_crc32"]))
    total = 0
    for i, t, _ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(min(first, len(ids)), len(ids) + 1, 1024)]
        expected = [(p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted(set(got[i])) == expected
    assert sum(x["length"] for x in out) == total
    assert used <= first_fit_decreasing([x["length"] for x in out], 1024)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(queries.tokenized(df), ["doc_id", "piece"], 1024).collect() == []
