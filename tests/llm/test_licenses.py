"""License rules against a plain scan of words."""

import random
import re

import pytest
from pyspark.sql import types as T

from helixgraph.llm import licenses as L


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    """All detections and what is left of them, every rule tried at every word."""
    ws, every = words(text), []
    for n, x in enumerate(L.signatures()):
        for f, (prefix, priority, weight) in enumerate(L.FORMS):
            if prefix and x.base:
                continue
            for i in range(len(ws)):
                if m := re.match(f"({prefix}{x.body})( |$)", " ".join(ws[i : i + 40])):
                    every.append((i, i + len(m[1].split()), priority, n * len(L.FORMS) + f, x.label, weight, x.base))
    one = {}
    for d in sorted(every, key=lambda d: (d[0], -d[1], d[2], d[3])):
        one.setdefault(d[0], d)
    whole = [d for d in one.values() if not any(e[0] < d[0] and e[1] >= d[1] for e in one.values())]
    found = [d for d in whole if not any(e[0] < d[1] and d[0] < e[1] and e[2] < d[2] for e in whole)]
    return len(ws), sorted(d[:6] for d in every if d[6]), sorted(d[:6] for d in found)


PARTS = ["licensed under the", "GNU General Public License", "version 3", "or later", "Apache", "License", "2.0", "the", "MIT", "CC-BY", "nc", "sa 4.0", "SPDX-License-Identifier:", "BSD", "3-clause", "released under", "public domain", "wort", "é", "gnu", "lesser"]


def scanned(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return [(r["doc_id"], r["n_words"], sorted(tuple(d)[:6] for d in r["base"]), sorted(tuple(d)[:6] for d in r["found"])) for r in L.scan(df, "doc_id", "text").collect()]


def test_equals_every_rule_at_every_word(spark):
    draw = random.Random(3)
    rows = [(i, " ".join(draw.choice(PARTS) for _ in range(draw.randint(0, 30)))) for i in range(40)]
    assert sorted(scanned(spark, rows)) == sorted((i, *brute(t)) for i, t in rows)


def test_priorities_and_containment(spark):
    rows = [
        (1, "This work is licensed under the GNU General Public License, version 3."),
        (2, "SPDX-License-Identifier: Apache-2.0"),
        (3, "licensed under the MIT License; CC BY-NC-SA 4.0"),
        (4, "mit license mit license"),
    ]
    got = {i: (base, [(a, b, label) for a, b, _, _, label, _ in found]) for i, _, base, found in scanned(spark, rows)}
    assert got[1][1] == [(3, 12, "gpl-3.0")]
    assert got[2][1] == [(0, 6, "apache-2.0")]
    assert [x[2] for x in got[3][1]] == ["mit", "cc-by-nc-sa"]
    assert len(got[4][0]) == 2


def test_nulls_repeats_long_texts_and_clashing_names(spark):
    long = "wort " * 20000 + "gnu general public license " * 300
    rows = [(None, None, 1, "a"), (1, "", 2, "b"), (1, "", 2, "b"), (2, "apache license", 3, None), (3, long, 4, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, found string")
    out = L.summary(L.scan(df, "doc_id", "text")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()
    got = sorted((tuple(r) for r in out), key=lambda r: (r[0] is not None, r[0] or 0))
    empty = (0, 0, None, None, "", "", 0.0)
    assert got == [(None, *empty), (1, *empty), (1, *empty), (2, 2, 1, 0, 0, "apache", "apache", 0.6), (3, 21200, 300, 20000, 21196, "gpl", "gpl", 0.6)]
    none = L.summary(L.scan(spark.createDataFrame([], T.StructType().add("doc_id", "long").add("text", "string")), "doc_id", "text"))
    assert none.collect() == []


def test_every_name_holds_its_keyword_at_its_place():
    for x in L.signatures():
        assert x.body.split(" ")[x.lead].startswith(x.keyword)
        assert not re.search(r"[+*{]", x.body)
        assert " (" not in " ".join(x.body.split(" ")[: x.lead])


@pytest.mark.parametrize("text", ["a\x00b", "ÀB", "İX y"])
def test_words(spark, text):
    (row,) = spark.createDataFrame([(text,)], "t string").select(L.joined_words(L.F.col("t"))).collect()
    assert row[0] == " ".join(words(text))
