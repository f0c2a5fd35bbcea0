"""The pipeline's stages on documents with planted cases, and the registered queries' contracts."""

import random

import pytest

import __spark_entry__
import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(7)
    words = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(4000)]

    def prose(n):
        return " ".join(r.choices(words, k=n))

    passage = prose(120)
    rows = [(i, prose(r.randint(80, 400)), "en", "s", 0) for i in range(300)]
    toxic = set()
    for i in range(0, 120, 2):
        rows[i] = (i, rows[i][1] + " you idiot scum. " + prose(5) + " such a moron", "en", "s", 0)
        toxic.add(i)
    copies = {}
    for k, i in enumerate((151, 153, 155)):
        text = rows[i][1]
        w = text.split()
        w[10] = "edited"
        rows += [(1000 + 2 * k, text, "de", "s", 0), (1001 + 2 * k, " ".join(w), "en", "s", 0)]
        copies |= {1000 + 2 * k: i, 1001 + 2 * k: i}
    shared = (201, 203, 205)
    for i in shared:
        rows[i] = (i, prose(60) + "\n" + passage + "\n" + prose(60), "en", "s", 0)
    rows += [(2000, None, None, None, None), (2001, "", "en", "s", 0), (2002, "word " * 30_000, "en", "s", 0)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(i in toxic)) for i in range(300) if i % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, toxic, copies, shared, passage


def test_stages(spark, folder):
    path, toxic, copies, shared, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        if name != "packing":
            assert docs.columns == columns
        docs = corpus_pipeline.materialize(docs, name)
        seen[name] = docs
    clean = {r["doc_id"] for r in seen["toxicity"].collect()}
    assert clean == set(before) - toxic
    kept = {r["doc_id"]: r["text"] for r in seen["near_dedup"].collect()}
    assert set(kept) == clean - set(copies) - {2001}  # of the two empty texts one stays
    cut = {r["doc_id"]: r["text"] for r in seen["suffix_dedup"].collect()}
    assert set(cut) == set(kept)
    for d in cut:
        if d in shared:
            assert passage not in cut[d] and len(cut[d]) <= len(kept[d]) - len(passage)
        elif d != 2002:
            assert cut[d] == (kept[d] or "")
    places = {}
    for r in seen["packing"].collect():
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        assert sum(n for _, n in p) <= 1024 and sorted(p)[0][0] == 0
    assert {r["doc_id"] for r in seen["packing"].select("doc_id").distinct().collect()} == set(cut)


def test_registration():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
