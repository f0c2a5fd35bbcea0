"""SimHash near-duplicates against brute force."""

import random
import re
from fractions import Fraction

import numpy as np
import xxhash

from helixgraph.llm import simhash


def brute(rows, words=3, radius=2):
    fps = []
    for _, text in rows:
        lowered = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0)
    comp = {f: f for f in fps}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    distinct = sorted(set(fps))
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if bin(a ^ b).count("1") <= radius:
                comp[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for (d, _), f in zip(rows, fps):
        least[find(f)] = min(least.get(find(f), d), d)
    return sorted((d, f, least[find(f)]) for (d, _), f in zip(rows, fps))


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string")
    out = simhash.near_duplicates(df, "doc_id", "text")
    return sorted((r["doc_id"], r["fp"] % (1 << 64), r["component"]) for r in out.collect())


def test_matches_brute_force(spark):
    r = random.Random(3)
    vocabulary = ["Ünder", "one", "TWO", "three", "four", "five", "six", "seven x", " eight"]
    rows = [(i, " ".join(r.choices(vocabulary, k=r.choice([1, 2, 3, 40, 400])))) for i in range(60)]
    base = rows[5][1] if len(rows[5][1]) > 200 else " ".join(r.choices(vocabulary, k=400))
    rows += [(100 + i, base + f"\t{i}") for i in range(20)] + [(200, None), (201, ""), (202, " \n\t"), (203, base), (204, base)]
    assert run(spark, rows) == brute(rows)


def test_empty_table_and_long_text(spark):
    assert run(spark, []) == []
    rows = [(1, "a b c " * 50_000), (2, "A B\vC " * 50_000)]
    assert run(spark, rows) == brute(rows)


def test_large_buckets_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    r = np.random.default_rng(0)
    # many fingerprints that agree in their first 22 bits
    fps = np.unique(r.integers(0, 1 << 12, 300, dtype=np.uint64) << np.uint64(8))
    df = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    got = {(int(x["a"], 16), int(x["b"], 16)) for x in simhash.links(simhash.block_keys(df, 2), 2).collect()}
    comp = {int(f): int(f) for f in fps}

    def find(c, x):
        while c[x] != x:
            x = c[x]
        return x

    expected = dict(comp)
    for a in expected:
        for b in expected:
            if a < b and bin(a ^ b).count("1") <= 2:
                expected[max(find(expected, a), find(expected, b))] = min(find(expected, a), find(expected, b))
    for a, b in got:
        x, y = find(comp, a), find(comp, b)
        comp[max(x, y)] = min(x, y)
    assert {f: find(comp, f) for f in comp} == {f: find(expected, f) for f in expected}


def test_counters_agree_with_popcount():
    r = np.random.default_rng(1)
    x = r.integers(0, 1 << 63, 200, dtype=np.uint64) & r.integers(0, 1 << 63, 200, dtype=np.uint64) & r.integers(0, 1 << 63, 200, dtype=np.uint64) & r.integers(0, 1 << 63, 200, dtype=np.uint64)
    p = simhash.planes(x[:, None])
    for radius in range(8):
        near = np.unpackbits(simhash.within(list(p), p.shape[1], radius).view(np.uint8))[:200]
        assert near.tolist() == [int(bin(int(v)).count("1") <= radius) for v in x]


def test_similar_catches_edits_and_leaves_others(spark):
    r = random.Random(4)
    words = ["".join(r.choices("abcdefghijklm", k=r.randint(2, 8))) for _ in range(3000)]
    base = [r.choices(words, k=300) for _ in range(30)]
    rows, family = [], {}
    for i, b in enumerate(base):
        for c in range(4):
            text = list(b)
            for _ in range(min(c, 3)):
                text[r.randrange(300)] = r.choice(words)
            family[len(rows)] = i
            rows.append((len(rows), " ".join(text).upper() if c == 1 else "  ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {x["doc_id"]: x["component"] for x in simhash.similar(df, "doc_id", "text").collect()}
    assert all(out[d] == 4 * family[d] for d in out)


def test_keep_one(spark):
    df = spark.createDataFrame([(3, "same words here again"), (1, "same words here again"), (2, "other things entirely said"), (4, None)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(df, "doc_id", "text").collect()) == [1, 2, 4]


def test_keep_one_loses_no_text(spark):
    """An id that is dropped with one text stays with another; repeated rows stay; a null id yields to a known one."""
    rows = [(3, "text a of some words", 1), (5, "text a of some words", 2), (5, "unique b with other words", 3), (6, "c d e f g", 4), (6, "c d e f g", 5), (None, "c d e f g", 6), (None, "all alone", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark int")
    assert sorted(r["mark"] for r in simhash.keep_one(df, "doc_id", "text").collect()) == [1, 3, 4, 5, 7]
    assert simhash.keep_one(df.limit(0), "doc_id", "text").collect() == []


def jaccard_components(texts, similarity=Fraction(4, 5)):
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    comp = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if comp[i] != comp[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                x, y = sorted((comp[i], comp[j]))
                comp = [x if c == y else c for c in comp]
    return comp


def near_and_far(seed):
    """Pairs at exactly 0.8 (to be joined), at 0.7 and 0.78 (not to be), of many lengths, and chains of edits."""
    r = random.Random(seed)
    made = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    texts = []
    for n in (8, 16, 80, 160, 480):
        for share, times in ((0.8, 8), (0.78, 4), (0.7, 8)):
            for _ in range(times):
                # n shingles in common and as many new ones beside them as the similarity leaves
                new, common = round(n / share) - n, made(n + 4)
                texts += [" ".join(made(new // 2) + common), " ".join(common + made(new - new // 2))]
    chain = made(300)
    for _ in range(12):
        texts.append(" ".join(chain))
        chain = chain[20:] + made(20)
    return texts


def test_links_are_those_of_the_exact_similarity(spark):
    texts = near_and_far(11)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = dict(simhash.similar(df, "doc_id", "text").select("doc_id", "component").collect())
    assert [out[i] for i in range(len(texts))] == jaccard_components(texts)


def test_exact_links_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 80)
    monkeypatch.setattr(simhash, "TILE_BYTES", 1 << 16)
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base[:k] + [f"x{r.randrange(10**9)}"] + base[k + 1 :]) for k in (r.randrange(120) for _ in range(300))] + near_and_far(12)[:60]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = dict(simhash.similar(df, "doc_id", "text").select("doc_id", "component").collect())
    assert [out[i] for i in range(len(texts))] == jaccard_components(texts)
