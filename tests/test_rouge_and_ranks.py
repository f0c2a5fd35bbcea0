"""Overlap of answers by hand and by the plain table; ranks over all rows without one task."""

import random

from pyspark.sql import functions as F

from helixgraph.functions import text as X
from helixgraph.sources.session import ranked


def table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_longest_common_subsequence():
    draw = random.Random(1)
    for n in (0, 1, 3, 63, 64, 65, 200):
        for m in (0, 1, 64, 150):
            a, b = draw.choices("abcde", k=n), draw.choices("abcdef", k=m)
            assert X.lcs_length(a, b) == table(a, b)


def test_library_rouge(spark):
    rows = [("The cat sat on the mat.", "the cat was on THE mat"), ("a a a b", "a b b"), (None, "x"), ("one", "one"), ("Ünder", "nder")]
    df = spark.createDataFrame(rows, "p string, g string").coalesce(1)
    got = [tuple(round(x, 6) for x in r[0]) for r in df.select(X.library_rouge(X.library_words(F.col("p")), X.library_words(F.col("g")))).collect()]
    # six and six words, five shared in order, three shared pairs of five; then 2 of 4 and 3, one pair of 3 and 2
    assert got == [(round(10 / 12, 6), 0.6, round(10 / 12, 6)), (round(4 / 7, 6), 0.4, round(4 / 7, 6)), (0.0, 0.0, 0.0), (1.0, 0.0, 1.0), (1.0, 0.0, 1.0)]


def test_ranked(spark):
    draw = random.Random(2)
    rows = [(i, draw.choice([None, 0.5, 1.0, 2.0])) for i in range(500)]
    out = ranked(spark.createDataFrame(rows, "id long, score double"), [F.desc_nulls_first("score"), F.asc("id")])
    expected = sorted(rows, key=lambda r: (r[1] is not None, -(r[1] or 0), r[0]))
    assert [r["id"] for r in sorted(out.collect(), key=lambda r: r["rank"])] == [i for i, _ in expected]
    assert sorted(r["rank"] for r in out.collect()) == list(range(1, 501))
    assert ranked(spark.createDataFrame([], "id long"), [F.asc("id")]).collect() == []
