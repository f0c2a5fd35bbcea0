"""Views and lists are dealt over partitions by their rows, whatever the session's number of shuffle partitions."""

import pytest
from helixgraph.sources import star

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("view", ["risk", "maps_to", "translated"])
def test_views_follow_the_line_items(spark, monkeypatch, view):
    def table():
        s = star.Star(spark, FOLDER)
        return s.graph.edges["TRANSLATED_INTO"].table if view == "translated" else getattr(s, view)

    few = sorted(map(tuple, table().collect()))
    monkeypatch.setattr(star, "ROWS", 250)
    assert table().rdd.getNumPartitions() >= 20
    assert sorted(map(tuple, table().collect())) == few
