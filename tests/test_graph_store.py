"""Graphs from files, stored in buckets: plans without a shuffle of edges, both directions, what the catalogue says."""

import pytest
from pyspark.sql import functions as F

from helixgraph.sources import graph_store


@pytest.fixture
def graph(spark, tmp_path):
    (tmp_path / "gene.tsv").write_text("name\tID\tnote\nA\tg1\tx\n\tg2\ty\nB\tg1\tz\nC\t\tq\n")
    (tmp_path / "snp.tsv").write_text("ID\nrs1\nrs2\nrs3\n")
    (tmp_path / "maps.tsv").write_text('END_ID\tSTART_ID\tlink_score\tother\ng1\trs1\t0.5\t-\ng1\trs2\thigh\t-\ng2\trs1\t\t"\ng9\trs1\t1\t-\n\trs1\t1\t-\ng1\trs1\t0.5\t-\n')
    path = str(tmp_path)
    return graph_store.read_graph(spark, {"Gene": f"{path}/gene.tsv", "SNP": f"{path}/snp.tsv"}, {"MAPS_TO": (f"{path}/maps.tsv", "SNP", "Gene")})


def test_files(graph):
    assert sorted(map(tuple, graph.nodes["Gene"].collect())) == [("g1", "A"), ("g2", "g2")]
    assert sorted(map(tuple, graph.nodes["SNP"].collect())) == [(f"rs{i}", f"rs{i}") for i in (1, 2, 3)]
    got = sorted(map(tuple, graph.edges["MAPS_TO"].table.collect()), key=str)
    assert got == [("rs1", "g1", 0.5), ("rs1", "g1", 0.5), ("rs1", "g2", None), ("rs2", "g1", None)]


def test_stored(spark, graph):
    graph_store.store(graph, "little", 4)
    graph_store.store(graph, "little", 4)  # again: replaced, not doubled
    assert {(r["kind"], r["name"], r["n"]) for r in graph_store.catalogue(spark, "little").collect()} == {("node", "Gene", 2), ("node", "SNP", 3), ("edge", "MAPS_TO", 4)}
    same = graph_store.opened(spark, "little")

    def paths(g, **how):
        p = g.match("Gene", "g").hop("g", "MAPS_TO", "a", "s", "in", **how).hop("s", "MAPS_TO", "b", "h", **how)
        return sorted(map(tuple, p.select("g_id", "s_id", "h_id").collect()))

    assert paths(same) == paths(graph) == paths(same, id_only=True)
    graph_store.dropped(spark, "little")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("little")]


def test_edges_stay_where_they_lie(spark, graph):
    graph_store.store(graph, "laid", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        g = graph_store.opened(spark, "laid")
        one = g.match("Gene", "g").hop("g", "MAPS_TO", "a", "s", "in", id_only=True)
        two = one.hop("s", "MAPS_TO", "b", "h", id_only=True)
        plans = [p.rows.groupBy("g_id").agg(F.count("*").alias("n"))._jdf.queryExecution().executedPlan().toString() for p in (one, two)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        graph_store.dropped(spark, "laid")
    assert "Exchange" not in plans[0]
    # the second hop moves the paths by the node that they have reached, and back for the count; the edges lie still
    assert plans[1].count("Exchange hashpartitioning(s_id") == 1 and "Exchange hashpartitioning(b_here" not in plans[1] and "Exchange hashpartitioning(a_here" not in plans[1]
