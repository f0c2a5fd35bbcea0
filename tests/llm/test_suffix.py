"""Repeated strings against brute force."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest

from helixgraph.llm import suffix


def marked(symbols, seen, length):
    gone = np.zeros(len(symbols), bool)
    for i in range(len(symbols) - length + 1):
        if seen[symbols[i : i + length]] > 1:
            gone[i : i + length] = True
    return gone


def runs(gone):
    return int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))


def brute(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for d, t in texts:
        gone = marked(t, seen, length)
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((d, len(t), int(gone.sum()), runs(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def brute_words(rows, length):
    texts = [(d, tuple((t or "").encode().split())) for d, t in rows]
    seen = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for d, t in texts:
        gone = marked(t, seen, length)
        out.append((d, runs(gone), int(gone.sum()), b" ".join(w for w, g in zip(t, gone) if not g)))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, kept string, start int")


def run(spark, rows, length, window=None):
    out = suffix.remove_repeats(frame(spark, rows), "doc_id", "text", length, window)
    return sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in out.collect())


def edited(seed, alphabet, length):
    r = random.Random(seed)
    passages = ["".join(r.choices(alphabet + "xyz", k=r.randint(length - 4, 3 * length))) for _ in range(6)]
    rows = []
    for i in range(60):
        text = "".join(r.choice(passages)[r.randint(0, 3) :] if r.random() < 0.4 else "".join(r.choices("abcdefgh", k=r.randint(0, 20))) for _ in range(r.randint(0, 8)))
        if text and r.random() < 0.3:  # an edit
            j = r.randrange(len(text))
            text = text[:j] + "#" + text[j + 1 :]
        rows.append((i, text))
    return rows + [(100, None), (101, ""), (102, "a" * 90), (103, "ab" * 60), (104, rows[3][1]), (3, rows[3][1]), (3, rows[4][1]), (105, "�" * 50), (106, "�" * 50)]


@pytest.mark.parametrize("length, window, alphabet, seed", [(12, 5, "ab", 1), (30, 12, "abcd", 2), (40, 32, "aé ", 3)])
def test_matches_brute_force(spark, length, window, alphabet, seed):
    rows = edited(seed, alphabet, length)
    assert run(spark, rows, length, window) == brute(rows, length)


@pytest.mark.parametrize("group, queue, window", [(1, 16, 12), (3, 7, 23), (6, 64, 20)])
def test_hot_groups_are_halved_and_queues_spill(spark, monkeypatch, group, queue, window):
    """A group far larger than GROUP, and shards larger than the queue, give the same result."""
    monkeypatch.setattr(suffix, "GROUP", group)
    monkeypatch.setattr(suffix, "QUEUE_ROWS", queue)
    r = random.Random(group)
    passage = "".join(r.choices("abcdefghij", k=70))
    noise = lambda: "".join(r.choices("abc", k=r.randint(0, 25)))
    rows = [(i, noise() + passage[r.randint(0, 30) : r.randint(40, 70)] + noise()) for i in range(80)] + [(200, passage), (201, None)]
    assert run(spark, rows, 30, window) == brute(rows, 30)


@pytest.mark.parametrize("group, queue", [(4096, 1 << 18), (2, 5)])
def test_words(spark, monkeypatch, group, queue):
    monkeypatch.setattr(suffix, "GROUP", group)
    monkeypatch.setattr(suffix, "QUEUE_ROWS", queue)
    r = random.Random(4)
    words = ["".join(r.choices("aébc.", k=r.randint(1, 4))) for _ in range(30)]
    passages = [r.choices(words, k=r.randint(8, 30)) for _ in range(5)]
    gap = lambda: r.choice([" ", "\n", "  ", "\t"])
    rows = []
    for i in range(60):
        parts = sum(((r.choice(passages)[r.randint(0, 3) :] if r.random() < 0.5 else r.choices(words, k=r.randint(0, 9))) for _ in range(r.randint(0, 6))), [])
        rows.append((i, "".join(w + gap() for w in parts)))
    rows += [(100, None), (101, " \n"), (102, "x " * 40), (103, "x " * 40 + "�"), (3, rows[4][1])]
    out = suffix.remove_repeats(frame(spark, rows), "doc_id", "text", 9, window=6, unit="words").collect()
    texts = {(d, t or "") for d, t in rows}
    assert sorted((r["doc_id"], r["n_spans"], len(r["kept"].split()), b" ".join(r["kept"].split())) for r in out) == sorted(
        (d, n, len(k.split()), k) for d, n, _, k in brute_words(rows, 9)
    )
    for r in out:
        raw = next(t for d, t in sorted(texts) if d == r["doc_id"] and len(t.encode()) == r["n_bytes"]).encode()
        assert r["n_removed"] == sum(s["end"] - s["start"] for s in r["spans"]) == len(raw) - len(r["kept"])
        r["kept"].decode()


@pytest.mark.parametrize("n", [51, 60, 80])
def test_passages_of_short_words(spark, n):
    """Passages of over 50 words, far below 400 bytes, inside lines and across them."""
    r = random.Random(n)
    words = ["".join(r.choices("abcdefgh", k=r.randint(1, 3))) for _ in range(300)]
    prose = lambda k: " ".join(r.choices(words, k=k))
    passage = r.choices(words, k=n)
    rows = [(i, prose(120)) for i in range(40)]
    for i in (3, 8, 20):
        rows[i] = (i, prose(20) + " " + (" " if i != 8 else "\n").join(passage) + " " + prose(30))
    out = {x["doc_id"]: x for x in suffix.remove_repeats(frame(spark, rows), "doc_id", "text", 400, passages=50).collect()}
    assert {d for d, x in out.items() if x["n_passages"]} == {3, 8, 20}
    # a neighbouring word may agree by chance
    assert all(n <= out[d]["passage_words"] <= n + 2 and out[d]["n_removed"] == 0 for d in (3, 8, 20))


def test_production_length(spark):
    r = random.Random(5)
    words = ["".join(r.choices("abcdefghij", k=r.randint(1, 9))) for _ in range(400)]
    base = [" ".join(r.choices(words, k=300)) for _ in range(4)]
    rows = [(i, " ".join(r.choices(words, k=r.randint(1, 200))) + r.choice(base)[r.randint(0, 900) :][: r.randint(380, 900)]) for i in range(60)]
    rows += [(200 + i, base[0][: 500 + i] + str(i) + base[0][700 + i :]) for i in range(30)]
    assert run(spark, rows, 400) == brute(rows, 400)


def test_empty(spark):
    assert run(spark, [], 400) == []


def test_queue_gives_back_the_order(tmp_path):
    r = np.random.default_rng(0)
    rows = np.stack([r.integers(0, 5, 5000), r.integers(0, 7, 5000), np.arange(5000), r.integers(0, 99, 5000)], 1)
    queue = suffix.SortQueue(str(tmp_path), limit=256)
    for i in range(0, 5000, 100):
        part = rows[i : i + 100]
        queue.push(part[np.lexsort((part[:, 2], part[:, 1], part[:, 0]))])
    assert len(queue.files) > 10 and queue
    blocks = list(queue.drain())
    assert max(map(len, blocks)) <= 256 + len(blocks) and (np.concatenate(blocks) == rows[np.lexsort((rows[:, 1], rows[:, 0]))]).all()
    assert not os.listdir(tmp_path) and not queue


def test_shard_against_pairs(tmp_path):
    """Induction with a queue of five rows against the comparison of all pairs."""
    r = np.random.default_rng(1)
    tail, rows = 6, []
    for i in range(400):
        low = int(r.integers(0, tail + 1))
        high = int(r.integers(low, tail + 1))
        rows.append((int(r.integers(0, 3)), bytes(r.integers(0, 2, tail - low).astype(np.uint8)), bytes(r.integers(0, 2, high).astype(np.uint8)), low, high))
    rows.sort(key=lambda x: x[:2])
    shard = suffix.Shard(str(tmp_path), tail, np.uint8, limit=5)
    for i in range(0, 400, 37):
        group, right, left, low, high = zip(*rows[i : i + 37])
        shard.add(np.array(group), list(right), list(left), np.array(low), np.array(high))
    found = shard.solve()
    for i, (g, right, left, low, high) in enumerate(rows):
        for o in range(low, high + 1):
            others = (x for j, x in enumerate(rows) if j != i and x[0] == g and x[3] <= o <= x[4])
            assert found[o, i] == any(x[1][: tail - o] == right[: tail - o] and x[2][:o] == left[:o] for x in others), (i, o)
