"""Answers are evaluated on all their words."""

from types import SimpleNamespace

from helixgraph.plans import evaluation_queries


def test_rouge_l_counts_words_after_the_fortieth(spark):
    head, tail = " ".join(f"a{i}" for i in range(40)), " ".join(f"t{i}" for i in range(60))
    rows = [(1, 1, "x", f"{head} {tail}", f"{head.replace('a', 'b')} {tail}"), (1, 2, "x", head, f"{head} {tail}"), (1, 3, "x", None, head)]
    star = SimpleNamespace(answers=spark.createDataFrame(rows, "conv_id long, turn long, type string, predicted string, gold string"))
    got = {r["turn"]: round(r["rouge_l"], 9) for r in evaluation_queries.answer_rouge_l(star).collect()}
    assert got == {1: 0.6, 2: round(2 * 40 / 140, 9), 3: 0.0}
