"""Graph-pattern queries: one-hop, multi-hop, conjunction, risk, causal and mechanism families, and graph statistics.

Each question is answered for all its anchors at once, as a join, instead of one anchor at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.pattern import Edge, Graph, desc_like_graph, numbered, reach_counts, reached
from ..sources import graph_store
from ..sources.session import written
from ..sources.star import Star, with_views
from .registry import register


def query(sql: str) -> Callable:
    """Register a function of a Star under its name, with the SQL that it should equal."""

    def keep(function: Callable[[Star], DataFrame]) -> Callable:
        register(function.__name__, lambda spark, folder: function(Star(spark, folder)), with_views(sql))
        return function

    return keep


def top(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each group; the limit applies before the shuffle too."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def first_names(rows: DataFrame, by: list[str], column: str, k: int) -> DataFrame:
    """For each group the first k distinct values in order, as one string ``found``, and ``n``, how many there are. The
    values beyond the k-th are dropped before any list is made, so that no list grows with its group."""
    distinct = rows.select(*by, column).distinct()
    first = top(distinct, by, [F.col(column)], k).groupBy(*by).agg(F.array_join(F.sort_array(F.collect_list(column)), ",").alias("found"))
    return distinct.groupBy(*by).agg(F.count("*").alias("n")).join(first, by)


def band(score: Column) -> Column:
    """The evidence level of a score."""
    return F.when(score >= 0.8, "very_strong").when(score >= 0.6, "strong").when(score >= 0.4, "moderate").when(score >= 0.2, "suggestive").otherwise("weak")


BAND = "CASE WHEN {0} >= 0.8 THEN 'very_strong' WHEN {0} >= 0.6 THEN 'strong' WHEN {0} >= 0.4 THEN 'moderate' WHEN {0} >= 0.2 THEN 'suggestive' ELSE 'weak' END"


@query("""SELECT * FROM (SELECT d.name AS disease, r.src AS gene, r.risk_score, r.snp_count, row_number() OVER (PARTITION BY d.id ORDER BY r.risk_score DESC NULLS FIRST, r.src) AS rank
FROM risk r JOIN disease d ON r.dst = d.id) WHERE rank <= 20""")
def graph_top_risk_genes(s: Star) -> DataFrame:
    """The 20 genes of the highest risk for each disease."""
    found = s.graph.match("Gene", "g").hop("g", "INCREASES_RISK_OF", "r", "d")
    rows = found.select("d_id", F.col("d_name").alias("disease"), F.col("g_id").alias("gene"), F.col("r_risk_score").alias("risk_score"), F.col("r_snp_count").alias("snp_count"))
    return top(rows, ["d_id"], [desc_like_graph("risk_score"), F.col("gene")], 20, "rank").drop("d_id")


@query("SELECT m.src AS snp, g.id AS gene, g.name AS gene_name, m.link_score FROM maps_to m JOIN gene g ON m.dst = g.id")
def graph_snp_genes(s: Star) -> DataFrame:
    """The genes of each SNP."""
    return s.graph.match("SNP", "s").hop("s", "MAPS_TO", "m", "g").select(F.col("s_id").alias("snp"), F.col("g_id").alias("gene"), F.col("g_name").alias("gene_name"), F.col("m_link_score").alias("link_score"))


@query("SELECT r.src AS gene, d.name AS disease, r.risk_score, row_number() OVER (PARTITION BY r.src ORDER BY r.risk_score DESC, d.name) AS rank FROM risk r JOIN disease d ON r.dst = d.id")
def graph_gene_diseases(s: Star) -> DataFrame:
    """The diseases of each gene, ranked by risk."""
    rows = s.graph.match("Gene", "g").hop("g", "INCREASES_RISK_OF", "r", "d").select(F.col("g_id").alias("gene"), F.col("d_name").alias("disease"), F.col("r_risk_score").alias("risk_score"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("gene").orderBy(F.desc("risk_score"), "disease")))


@query("SELECT g.id AS gene, count(m.src) AS snp_count FROM gene g LEFT JOIN maps_to m ON m.dst = g.id GROUP BY 1")
def graph_snp_count(s: Star) -> DataFrame:
    """The number of SNPs that map to each gene, zeros included."""
    return s.graph.match("Gene", "g").hop("g", "MAPS_TO", "m", "s", "in", optional=True).rows.groupBy(F.col("g_id").alias("gene")).agg(F.count("s_id").alias("snp_count"))


@query("SELECT c.src AS snp, d.name AS disease, c.causal_score, round(-log10(c.pvalue), 6) AS neglog10p FROM causal c JOIN disease d ON c.dst = d.id")
def graph_snp_diseases(s: Star) -> DataFrame:
    """The causal score and significance of each SNP's disease."""
    found = s.graph.match("SNP", "s").hop("s", "PUTATIVE_CAUSAL_EFFECT", "c", "d")
    return found.select(F.col("s_id").alias("snp"), F.col("d_name").alias("disease"), F.col("c_causal_score").alias("causal_score"), F.round(-F.log10("c_pvalue"), 6).alias("neglog10p"))


@query("SELECT g.id AS gene, d.name AS disease, count(*) AS paths, max(m.link_score) AS best_link FROM maps_to m JOIN gene g ON m.dst = g.id JOIN risk r ON r.src = g.id JOIN disease d ON r.dst = d.id GROUP BY 1, 2")
def graph_paths(s: Star) -> DataFrame:
    """Paths from SNPs over genes to diseases, counted for each gene and disease."""
    found = s.graph.match("SNP", "s").hop("s", "MAPS_TO", "m", "g").hop("g", "INCREASES_RISK_OF", "r", "d")
    return found.rows.groupBy(F.col("g_id").alias("gene"), F.col("d_name").alias("disease")).agg(F.count("*").alias("paths"), F.max("m_link_score").alias("best_link"))


@query("SELECT d.name AS disease, max_by(r.src, r.risk_score * 1e9 - r.src) AS gene, max(r.risk_score) AS risk_score FROM risk r JOIN disease d ON r.dst = d.id GROUP BY 1")
def graph_top_risk_gene(s: Star) -> DataFrame:
    """The gene of the highest risk for each disease, the smallest id on ties."""
    rows = s.graph.match("Gene", "g").hop("g", "INCREASES_RISK_OF", "r", "d").rows
    best = F.max_by("g_id", F.struct("r_risk_score", -F.col("g_id")))
    return rows.groupBy(F.col("d_name").alias("disease")).agg(best.alias("gene"), F.max("r_risk_score").alias("risk_score"))


@query("SELECT disease, string_agg(CAST(gene AS VARCHAR), ',' ORDER BY rank) AS genes FROM (SELECT d.name AS disease, r.src AS gene, row_number() OVER (PARTITION BY d.id ORDER BY r.risk_score DESC, r.src) AS rank FROM risk r JOIN disease d ON r.dst = d.id) WHERE rank <= 3 GROUP BY 1")
def graph_top3_risk_genes(s: Star) -> DataFrame:
    """The three genes of the highest risk for each disease, collected in their order."""
    rows = s.graph.match("Gene", "g").hop("g", "INCREASES_RISK_OF", "r", "d").select(F.col("d_name").alias("disease"), "g_id", "r_risk_score")
    first = top(rows, ["disease"], [F.desc("r_risk_score"), F.col("g_id")], 3, "rank")
    return first.groupBy("disease").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "g_id"))), lambda x: x["g_id"]), ",").alias("genes"))


@query("SELECT disease, gene FROM (SELECT d.name AS disease, r.src AS gene, row_number() OVER (PARTITION BY d.id ORDER BY r.risk_score DESC, r.src) AS rank FROM risk r JOIN disease d ON r.dst = d.id) WHERE rank = 2")
def graph_second_risk_gene(s: Star) -> DataFrame:
    """The second best gene of each disease."""
    rows = s.graph.match("Gene", "g").hop("g", "INCREASES_RISK_OF", "r", "d").select(F.col("d_name").alias("disease"), F.col("g_id").alias("gene"), "r_risk_score")
    return top(rows, ["disease"], [F.desc("r_risk_score"), F.col("gene")], 2, "rank").filter("rank = 2").select("disease", "gene")


@query("SELECT src AS gene, risk_score FROM risk WHERE dst = (SELECT min(id) FROM disease) ORDER BY risk_score DESC, src LIMIT 5 OFFSET 1")
def graph_skip_limit(s: Star) -> DataFrame:
    """The genes ranked second to sixth for the first disease."""
    first = s.graph.nodes["Disease"].agg(F.min("id").alias("id"))
    rows = s.graph.edges["INCREASES_RISK_OF"].table.join(F.broadcast(first), F.col("dst") == F.col("id"))
    return rows.select(F.col("src").alias("gene"), "risk_score").orderBy(F.desc("risk_score"), "gene").offset(1).limit(5)


@query("SELECT d.name AS disease, count(DISTINCT r.src) AS genes, count(DISTINCT CASE WHEN r.risk_score > 0.5 THEN r.src END) AS high, count(DISTINCT CASE WHEN r.risk_score > 0.3 AND r.risk_score < 0.7 THEN r.src END) AS moderate FROM risk r JOIN disease d ON r.dst = d.id GROUP BY 1")
def graph_count_risk_genes(s: Star) -> DataFrame:
    """Genes of each disease: all, of high and of moderate risk."""
    rows = s.graph.match("Gene", "g").hop("g", "INCREASES_RISK_OF", "r", "d").rows
    score = F.col("r_risk_score")
    return rows.groupBy(F.col("d_name").alias("disease")).agg(
        F.count_distinct("g_id").alias("genes"), F.count_distinct(F.when(score > 0.5, F.col("g_id"))).alias("high"), F.count_distinct(F.when((score > 0.3) & (score < 0.7), F.col("g_id"))).alias("moderate")
    )


@query("SELECT a.src AS gene, a.dst AS first_disease, a.risk_score AS first_risk, b.risk_score AS second_risk, CASE WHEN a.risk_score > b.risk_score THEN a.dst ELSE b.dst END AS higher FROM risk a JOIN risk b ON a.src = b.src AND b.dst = a.dst + 1 WHERE a.risk_score > 0.2 AND b.risk_score > 0.2")
def graph_shared_high_risk(s: Star) -> DataFrame:
    """Genes that raise the risk of a disease and the next beyond a threshold each, and of which one more."""
    risk = s.graph.edges["INCREASES_RISK_OF"].table.filter("risk_score > 0.2")
    a = risk.select(F.col("src").alias("gene"), F.col("dst").alias("first_disease"), F.col("risk_score").alias("first_risk"))
    b = risk.select(F.col("src").alias("gene"), (F.col("dst") - 1).alias("first_disease"), F.col("risk_score").alias("second_risk"))
    higher = F.when(F.col("first_risk") > F.col("second_risk"), F.col("first_disease")).otherwise(F.col("first_disease") + 1)
    return a.join(b, ["gene", "first_disease"]).select("gene", "first_disease", "first_risk", "second_risk", higher.alias("higher"))


@query(f"SELECT r.src AS gene, d.name AS disease, r.evidence_score, {BAND.format('r.evidence_score')} AS level FROM risk r JOIN disease d ON r.dst = d.id")
def graph_evidence_levels(s: Star) -> DataFrame:
    """The evidence level of each gene and disease."""
    rows = s.graph.match("Gene", "g").hop("g", "INCREASES_RISK_OF", "r", "d")
    return rows.select(F.col("g_id").alias("gene"), F.col("d_name").alias("disease"), F.col("r_evidence_score").alias("evidence_score"), band(F.col("r_evidence_score")).alias("level"))


@query("SELECT disease, snp, causal_score FROM (SELECT d.name AS disease, c.src AS snp, c.causal_score, row_number() OVER (PARTITION BY d.id ORDER BY c.causal_score DESC, c.src) AS rank FROM causal c JOIN disease d ON c.dst = d.id) WHERE rank <= 10")
def graph_top_causal_snps(s: Star) -> DataFrame:
    """The ten SNPs of the highest causal score for each disease."""
    rows = s.graph.match("SNP", "s").hop("s", "PUTATIVE_CAUSAL_EFFECT", "c", "d").select(F.col("d_name").alias("disease"), F.col("s_id").alias("snp"), F.col("c_causal_score").alias("causal_score"))
    return top(rows, ["disease"], [F.desc("causal_score"), F.col("snp")], 10)


@query("SELECT d.name AS disease, count(*) AS snps, count(CASE WHEN c.causal_score > 0.8 THEN 1 END) AS strong, count(CASE WHEN c.causal_score = 1.0 THEN 1 END) AS validated, CAST(sum(CAST(floor(c.causal_score * 1000) AS BIGINT)) AS BIGINT) AS score_sum FROM causal c JOIN disease d ON c.dst = d.id GROUP BY 1 HAVING count(*) >= 2")
def graph_causal_counts(s: Star) -> DataFrame:
    """SNPs of each disease by causal strength, for diseases with two at least."""
    rows = s.graph.match("SNP", "s").hop("s", "PUTATIVE_CAUSAL_EFFECT", "c", "d").rows
    score = F.col("c_causal_score")
    return (
        rows.groupBy(F.col("d_name").alias("disease"))
        .agg(F.count("*").alias("snps"), F.count_if(score > 0.8).alias("strong"), F.count_if(score == 1.0).alias("validated"), F.sum(F.floor(score * 1000).cast("long")).alias("score_sum"))
        .filter("snps >= 2")
    )


@query("SELECT c.src AS snp, m.dst AS gene, c.dst AS disease, CASE WHEN c.causal_score > 0.5 THEN 'yes' ELSE 'no' END AS strong FROM causal c JOIN maps_to m ON m.src = c.src JOIN risk r ON r.src = m.dst AND r.dst = c.dst")
def graph_causal_chains(s: Star) -> DataFrame:
    """SNPs whose gene raises the risk of the SNP's own disease: a triangle, closed by an equi-join on both ends."""
    found = s.graph.match("SNP", "s").hop("s", "PUTATIVE_CAUSAL_EFFECT", "c", "d").hop("s", "MAPS_TO", "m", "g").hop("g", "INCREASES_RISK_OF", "r", "d")
    return found.select(F.col("s_id").alias("snp"), F.col("g_id").alias("gene"), F.col("d_id").alias("disease"), F.when(F.col("c_causal_score") > 0.5, "yes").otherwise("no").alias("strong"))


@query("SELECT g.id AS gene, p.id AS protein_id, p.name AS protein_name FROM translated t JOIN gene g ON t.src = g.id JOIN protein p ON t.dst = p.id")
def graph_gene_proteins(s: Star) -> DataFrame:
    """The proteins of each gene."""
    return s.graph.match("Gene", "g").hop("g", "TRANSLATED_INTO", "t", "p").select(F.col("g_id").alias("gene"), F.col("p_id").alias("protein_id"), F.col("p_name").alias("protein_name"))


def _mechanism(kind: str, view: str, node: str, label: str) -> None:
    """Gene to target over the gene's proteins: the first five names of each gene."""
    name_of = f"JOIN {node} n ON e.dst = n.id" if node else ""
    column = "n.name" if node else "e.dst"
    sql = f"SELECT t.src AS gene, array_to_string(list_slice(list_sort(list_distinct(list({column}))), 1, 5), ',') AS found, count(DISTINCT {column}) AS n FROM translated t JOIN {view} e ON e.src = t.dst {name_of} GROUP BY 1"

    def run(spark: SparkSession, folder: str) -> DataFrame:
        graph = Star(spark, folder).graph
        first = graph.match("Gene", "g").hop("g", "TRANSLATED_INTO", "t", "p").select(F.col("g_id").alias("src"), F.col("p_id").alias("dst"))
        second = graph.match("Protein", "p").hop("p", kind, "e", "x").select(F.col("p_id").alias("src"), F.col("x_name").alias("value"))
        return reached(first, second, 5).select(F.col("src").alias("gene"), "found", F.col("known").alias("n"))

    register(f"graph_mechanism_{label}", run, with_views(sql))


for _kind, _view, _node, _label in (
    ("ANNOTATED_IN_PATHWAY", "in_pathway", "pathway", "pathway"),
    ("HAS_PROCESS", "has_process", "", "process"),
    ("EXPRESSED_IN", "expressed_in", "", "tissue"),
    ("HAS_FUNCTION", "has_function", "", "function"),
    ("IN_COMPONENT", "in_component", "(SELECT DISTINCT p_size AS id, CAST(p_size AS VARCHAR) AS name FROM part)", "component"),
    ("ASSOCIATED_WITH", "associated", "disease", "disease"),
):
    _mechanism(_kind, _view, _node, _label)


def _one_hop(kind: str, view: str, label: str, target: str) -> None:
    """Protein to target, directed."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return Star(spark, folder).graph.match("Protein", "p").hop("p", kind, "e", "x").select(F.col("p_id").alias("protein"), F.col("x_id").alias(label))

    register(f"graph_protein_{label}", run, with_views(f"SELECT src AS protein, dst AS {label} FROM {view}"))

    def both(spark: SparkSession, folder: str) -> DataFrame:
        # the question's pairs are each protein and the next; all are answered in one equi-join on pair and target
        edges = Star(spark, folder).graph.edges[kind].table
        a = edges.select(F.col("src").alias("first_protein"), F.col("dst").alias(label))
        b = edges.select((F.col("src") - 1).alias("first_protein"), F.col("dst").alias(label))
        return a.join(b, ["first_protein", label]).select("first_protein", (F.col("first_protein") + 1).alias("second_protein"), label).distinct()

    register(f"graph_conjunction_{label}", both, with_views(f"SELECT DISTINCT a.src AS first_protein, b.src AS second_protein, a.dst AS {label} FROM {view} a JOIN {view} b ON b.src = a.src + 1 AND b.dst = a.dst"))


for _kind, _view, _label, _target in (
    ("ASSOCIATED_WITH", "associated", "disease", "Disease"),
    ("ANNOTATED_IN_PATHWAY", "in_pathway", "pathway", "Pathway"),
    ("HAS_PROCESS", "has_process", "process", "Process"),
    ("EXPRESSED_IN", "expressed_in", "tissue", "Tissue"),
    ("HAS_FUNCTION", "has_function", "function", "Function"),
    ("IN_COMPONENT", "in_component", "component", "Component"),
):
    _one_hop(_kind, _view, _label, _target)


@query("SELECT p.id AS protein, count(i.b) AS partners FROM protein p LEFT JOIN (SELECT src AS a, dst AS b FROM interacts UNION ALL SELECT dst, src FROM interacts WHERE src <> dst) i ON i.a = p.id GROUP BY 1")
def graph_undirected_partners(s: Star) -> DataFrame:
    """Interaction partners of each protein in either direction."""
    return s.graph.match("Protein", "p").hop("p", "INTERACTS_WITH", "i", "q", "both", optional=True).rows.groupBy(F.col("p_id").alias("protein")).agg(F.count("q_id").alias("partners"))


@query("SELECT a.src AS start_id, b.dst AS end_id FROM interacts a JOIN interacts b ON a.dst = b.src WHERE NOT (a.src = b.src AND a.dst = b.dst)")
def graph_two_hops_same_type(s: Star) -> DataFrame:
    """Two interactions in a row: one edge isn't taken twice."""
    found = s.graph.match("Protein", "p").hop("p", "INTERACTS_WITH", "a", "q").hop("q", "INTERACTS_WITH", "b", "t")
    return found.select(F.col("p_id").alias("start_id"), F.col("t_id").alias("end_id"))


#: Interactions both ways round (the next protein and back), and every third twice, with other scores.
_BOTH_WAYS = "(SELECT src, dst, k FROM (SELECT src, dst, 0 AS k FROM interacts UNION ALL SELECT dst, src, 0 FROM interacts UNION ALL SELECT src, dst, 1 FROM interacts WHERE src % 3 = 0))"


def both_ways(s: Star) -> Graph:
    """The proteins with reciprocal and parallel interactions."""
    once = s.graph.edges["INTERACTS_WITH"].table.withColumn("k", F.lit(0))
    back = once.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "k")
    edges = once.unionByName(back).unionByName(once.filter("src % 3 = 0").withColumn("k", F.lit(1)))
    return Graph(s.graph.nodes, {"INTERACTS_WITH": Edge(numbered(edges), "Protein", "Protein")})


@query(f"WITH e AS (SELECT *, row_number() OVER (ORDER BY src, dst, k) AS id FROM {_BOTH_WAYS}) SELECT a.src AS protein, count(*) AS paths, count(CASE WHEN c.dst = a.src THEN 1 END) AS rings FROM e a JOIN e b ON b.src = a.dst AND b.id <> a.id JOIN e c ON c.src = b.dst AND c.id <> a.id AND c.id <> b.id GROUP BY 1")
def graph_three_hops_same_type(s: Star) -> DataFrame:
    """Paths of three interactions from each protein, and those that come back, over reciprocal and parallel edges: each edge
    once in a path, its opposite and its parallels as edges of their own."""
    found = both_ways(s).match("Protein", "p").hop("p", "INTERACTS_WITH", "a", "q").hop("q", "INTERACTS_WITH", "b", "t").hop("t", "INTERACTS_WITH", "c", "u")
    return found.rows.groupBy(F.col("p_id").alias("protein")).agg(F.count("*").alias("paths"), F.count_if(F.col("u_id") == F.col("p_id")).alias("rings"))


@query(f"WITH e AS (SELECT *, row_number() OVER (ORDER BY src, dst, k) AS id FROM {_BOTH_WAYS}), u AS (SELECT id, src AS a, dst AS b FROM e UNION ALL SELECT id, dst, src FROM e WHERE src <> dst) SELECT x.a AS protein, count(*) AS walks FROM u x JOIN u y ON y.a = x.b AND y.id <> x.id GROUP BY 1")
def graph_undirected_two_hops(s: Star) -> DataFrame:
    """Two interactions in either direction; none is walked there and back, but its parallel may be."""
    found = both_ways(s).match("Protein", "p").hop("p", "INTERACTS_WITH", "a", "q", "both").hop("q", "INTERACTS_WITH", "b", "t", "both")
    return found.rows.groupBy(F.col("p_id").alias("protein")).agg(F.count("*").alias("walks"))


@query("SELECT a.dst AS first_disease, b.dst AS second_disease, count(*) AS genes FROM risk a JOIN risk b ON a.src = b.src AND a.dst < b.dst WHERE a.risk_score > 0.5 AND b.risk_score > 0.5 GROUP BY 1, 2")
def graph_disease_pairs(s: Star) -> DataFrame:
    """Pairs of diseases that share high-risk genes; a gene has at most as many diseases as there are nations."""
    risk = s.graph.edges["INCREASES_RISK_OF"].table.filter("risk_score > 0.5")
    a, b = risk.select("src", F.col("dst").alias("first_disease")), risk.select("src", F.col("dst").alias("second_disease"))
    return a.join(b, "src").filter("first_disease < second_disease").groupBy("first_disease", "second_disease").agg(F.count("*").alias("genes"))


@query("SELECT r.dst AS disease, r.src AS gene, count(DISTINCT o.dst) AS other_diseases FROM risk r JOIN risk o ON o.src = r.src AND o.dst <> r.dst GROUP BY 1, 2")
def graph_other_diseases(s: Star) -> DataFrame:
    """For each disease and its genes, how many other diseases these bear on: counted once for each gene."""
    pairs = s.graph.edges["INCREASES_RISK_OF"].table.select(F.col("dst").alias("disease"), F.col("src").alias("gene")).distinct()
    each = pairs.groupBy("gene").agg((F.count("*") - 1).alias("other_diseases")).filter("other_diseases > 0")
    return pairs.join(each, "gene").select("disease", "gene", "other_diseases")


@query("SELECT p.id AS protein, d.name AS disease, a.score, CASE WHEN d.id IS NULL THEN 'none' ELSE 'direct' END AS link FROM protein p LEFT JOIN (associated a JOIN disease d ON a.dst = d.id AND a.score > 0.5) ON a.src = p.id")
def graph_optional_with_condition(s: Star) -> DataFrame:
    """An optional hop whose condition belongs to the join: proteins without a strong link stay."""
    found = s.graph.match("Protein", "p").hop("p", "ASSOCIATED_WITH", "a", "d", optional=True, condition="a_score > 0.5")
    return found.select(F.col("p_id").alias("protein"), F.col("d_name").alias("disease"), F.col("a_score").alias("score"), F.when(F.col("d_id").isNull(), "none").otherwise("direct").alias("link"))


@query("SELECT s.id AS snp FROM snp s WHERE EXISTS (SELECT 1 FROM causal c WHERE c.src = s.id AND c.causal_score > 0.9) AND EXISTS (SELECT 1 FROM maps_to m WHERE m.src = s.id)")
def graph_exists(s: Star) -> DataFrame:
    """SNPs with a strong causal effect that map to a gene."""
    return s.graph.match("SNP", "s").exists("s", "PUTATIVE_CAUSAL_EFFECT", condition="causal_score > 0.9").exists("s", "MAPS_TO").select(F.col("s_id").alias("snp"))


@query("SELECT g.id AS gene FROM gene g WHERE NOT EXISTS (SELECT 1 FROM risk r WHERE r.src = g.id AND r.risk_score > 0.95)")
def graph_not_exists(s: Star) -> DataFrame:
    """Genes without any very high risk."""
    return s.graph.match("Gene", "g").exists("g", "INCREASES_RISK_OF", condition="risk_score > 0.95", negate=True).select(F.col("g_id").alias("gene"))


_ENDS = " UNION ALL ".join(
    f"SELECT '{a}' AS label, CAST(src AS VARCHAR) AS id FROM {v} UNION ALL SELECT '{b}', CAST(dst AS VARCHAR) FROM {v}"
    for v, a, b in (
        ("maps_to", "SNP", "Gene"),
        ("causal", "SNP", "Disease"),
        ("risk", "Gene", "Disease"),
        ("translated", "Gene", "Protein"),
        ("associated", "Protein", "Disease"),
        ("in_pathway", "Protein", "Pathway"),
        ("has_process", "Protein", "Process"),
        ("expressed_in", "Protein", "Tissue"),
        ("has_function", "Protein", "Function"),
        ("in_component", "Protein", "Component"),
        ("interacts", "Protein", "Protein"),
    )
)
_NODES = "SELECT 'SNP' AS label, CAST(id AS VARCHAR) AS id FROM snp UNION ALL SELECT 'Gene', CAST(id AS VARCHAR) FROM gene UNION ALL SELECT 'Protein', CAST(id AS VARCHAR) FROM protein UNION ALL SELECT 'Disease', CAST(id AS VARCHAR) FROM disease UNION ALL SELECT 'Pathway', CAST(id AS VARCHAR) FROM pathway UNION ALL SELECT DISTINCT 'Process', type FROM gene UNION ALL SELECT DISTINCT 'Tissue', brand FROM gene UNION ALL SELECT DISTINCT 'Function', string_split(p_type, ' ')[1] FROM part UNION ALL SELECT DISTINCT 'Component', CAST(p_size AS VARCHAR) FROM part"


@query(f"SELECT label, count(*) AS nodes FROM ({_NODES}) GROUP BY 1")
def graph_node_counts(s: Star) -> DataFrame:
    """Nodes by label."""
    return s.graph.any_node().groupBy("label").agg(F.count("*").alias("nodes"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS type, count(*) AS edges FROM {v} HAVING count(*) > 0" for t, v in (("MAPS_TO", "maps_to"), ("PUTATIVE_CAUSAL_EFFECT", "causal"), ("INCREASES_RISK_OF", "risk"), ("TRANSLATED_INTO", "translated"), ("ASSOCIATED_WITH", "associated"), ("ANNOTATED_IN_PATHWAY", "in_pathway"), ("HAS_PROCESS", "has_process"), ("EXPRESSED_IN", "expressed_in"), ("HAS_FUNCTION", "has_function"), ("IN_COMPONENT", "in_component"), ("INTERACTS_WITH", "interacts"))))
def graph_edge_counts(s: Star) -> DataFrame:
    """Edges by type."""
    return s.bare_graph.any_edge().groupBy("type").agg(F.count("*").alias("edges"))


@query(f"SELECT label, count(*) AS nodes, min(degree) AS least, max(degree) AS most, CAST(sum(degree) AS BIGINT) AS total FROM (SELECT n.label, n.id, count(e.id) AS degree FROM ({_NODES}) n LEFT JOIN ({_ENDS}) e ON e.label = n.label AND e.id = n.id GROUP BY 1, 2) GROUP BY 1")
def graph_degrees(s: Star) -> DataFrame:
    """Degrees by label; isolated nodes count."""
    return s.bare_graph.degrees().groupBy("label").agg(F.count("*").alias("nodes"), F.min("degree").alias("least"), F.max("degree").alias("most"), F.sum("degree").alias("total"))


@query(f"SELECT label, id FROM ({_NODES}) n WHERE NOT EXISTS (SELECT 1 FROM (SELECT 'SNP' AS label, CAST(src AS VARCHAR) AS id FROM maps_to WHERE link_score > 0.09 UNION ALL SELECT 'Gene', CAST(dst AS VARCHAR) FROM maps_to WHERE link_score > 0.09 UNION ALL SELECT 'SNP', CAST(src AS VARCHAR) FROM causal WHERE causal_score > 0.7 UNION ALL SELECT 'Disease', CAST(dst AS VARCHAR) FROM causal WHERE causal_score > 0.7 UNION ALL SELECT 'Protein', CAST(src AS VARCHAR) FROM associated WHERE score > 0.5 UNION ALL SELECT 'Disease', CAST(dst AS VARCHAR) FROM associated WHERE score > 0.5) e WHERE e.label = n.label AND e.id = n.id) AND label IN ('SNP', 'Gene', 'Protein', 'Disease')")
def graph_isolated(s: Star) -> DataFrame:
    """Nodes of four labels without edges in the subgraph of strong evidence."""
    strong = s.graph.subgraph({"MAPS_TO": "link_score > 0.09", "PUTATIVE_CAUSAL_EFFECT": "causal_score > 0.7", "ASSOCIATED_WITH": "score > 0.5"})
    return strong.degrees().filter(F.col("label").isin("SNP", "Gene", "Protein", "Disease") & (F.col("degree") == 0)).select("label", "id")


@query("SELECT name, count(*) AS n FROM gene GROUP BY 1 HAVING count(*) > 1")
def graph_duplicate_keys(s: Star) -> DataFrame:
    """Gene names that come more than once."""
    return s.graph.nodes["Gene"].groupBy("name").agg(F.count("*").alias("n")).filter("n > 1")


@query("SELECT count(CASE WHEN score IS NULL THEN 1 END) AS nulls, count(score) AS known, CAST(sum(CASE WHEN score > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS strong, count(*) AS total FROM associated")
def graph_null_scores(s: Star) -> DataFrame:
    """Null and non-null edge scores, by conditional counts."""
    edges = s.graph.edges["ASSOCIATED_WITH"].table
    return edges.agg(F.count_if(F.col("score").isNull()).alias("nulls"), F.count("score").alias("known"), F.sum(F.when(F.col("score") > 0.5, 1).otherwise(0)).alias("strong"), F.count("*").alias("total"))


@query("SELECT d.name AS disease, max(coalesce(a.score, 0.5)) AS relevance FROM associated a JOIN disease d ON a.dst = d.id GROUP BY 1")
def graph_default_weight(s: Star) -> DataFrame:
    """The relevance of diseases to proteins, a missing score counting as one half."""
    rows = s.graph.match("Protein", "p").hop("p", "ASSOCIATED_WITH", "a", "d").rows
    return rows.groupBy(F.col("d_name").alias("disease")).agg(F.max(F.coalesce("a_score", F.lit(0.5))).alias("relevance"))


@query("SELECT src AS protein, score, row_number() OVER (ORDER BY score DESC NULLS FIRST, src) AS place FROM associated QUALIFY place <= 25")
def graph_null_order(s: Star) -> DataFrame:
    """The first 25 edges in descending order: nulls come first, as in graph query languages."""
    edges = s.graph.edges["ASSOCIATED_WITH"].table.select(F.col("src").alias("protein"), "score").orderBy(desc_like_graph("score"), "protein").limit(25)
    return edges.withColumn("place", F.row_number().over(Window.orderBy(desc_like_graph("score"), "protein")).cast("long"))


@query("SELECT id, name FROM (SELECT id, name FROM gene WHERE contains(lower(name), 'a') ORDER BY id LIMIT 5) UNION SELECT id, name FROM (SELECT id, name FROM protein ORDER BY id LIMIT 5) UNION SELECT id, name FROM (SELECT id, name FROM protein ORDER BY id LIMIT 3)")
def graph_union_distinct(s: Star) -> DataFrame:
    """A distinct union of branches with limits of their own."""
    nodes = s.graph.nodes
    a = nodes["Gene"].filter(F.lower("name").contains("a")).select("id", "name").orderBy("id").limit(5)
    b = nodes["Protein"].select("id", "name").orderBy("id")
    return a.unionByName(b.limit(5)).unionByName(b.limit(3)).distinct()


@query("SELECT snps, causal, snps - causal AS rest, round(causal * 100.0 / snps, 1) AS pct FROM (SELECT count(*) AS snps FROM snp) CROSS JOIN (SELECT count(DISTINCT src) AS causal FROM causal)")
def graph_two_totals(s: Star) -> DataFrame:
    """Two independent totals side by side: one row each."""
    a = s.graph.nodes["SNP"].agg(F.count("*").alias("snps"))
    b = s.graph.edges["PUTATIVE_CAUSAL_EFFECT"].table.agg(F.count_distinct("src").alias("causal"))
    return a.crossJoin(b).select("snps", "causal", (F.col("snps") - F.col("causal")).alias("rest"), F.round(F.col("causal") * 100.0 / F.col("snps"), 1).alias("pct"))


@query("SELECT 'Gene' AS label, src AS id, 'risk_gene' AS node_type FROM (SELECT DISTINCT src FROM risk WHERE risk_score > 0.5) UNION ALL SELECT 'Protein', dst, 'risk_protein' FROM (SELECT DISTINCT t.dst FROM translated t JOIN risk r ON r.src = t.src WHERE r.risk_score > 0.5) UNION ALL SELECT 'SNP', s.id, CASE WHEN c.src IS NOT NULL AND m.src IS NOT NULL THEN 'causal_snp,risk_snp' WHEN c.src IS NOT NULL THEN 'causal_snp' WHEN m.src IS NOT NULL THEN 'risk_snp' END FROM snp s LEFT JOIN (SELECT DISTINCT src FROM causal WHERE causal_score > 0.7) c ON c.src = s.id LEFT JOIN (SELECT DISTINCT m.src FROM maps_to m JOIN risk r ON r.src = m.dst WHERE m.link_score > 0.05 AND r.risk_score > 0.5) m ON m.src = s.id")
def graph_node_tags(s: Star) -> DataFrame:
    """Tags by the patterns that nodes are in: risk genes, their proteins, causal SNPs, and SNPs of risk genes, whose tag is
    appended to one that is there."""
    e = s.graph.edges
    genes = e["INCREASES_RISK_OF"].table.filter("risk_score > 0.5").select(F.col("src").alias("id")).distinct()
    proteins = e["TRANSLATED_INTO"].table.join(genes, F.col("src") == F.col("id"), "left_semi").select(F.col("dst").alias("id")).distinct()
    causal = e["PUTATIVE_CAUSAL_EFFECT"].table.filter("causal_score > 0.7").select(F.col("src").alias("id"), F.lit("causal_snp").alias("first_tag")).distinct()
    risky = e["MAPS_TO"].table.filter("link_score > 0.05").join(genes, F.col("dst") == F.col("id"), "left_semi").select(F.col("src").alias("id"), F.lit("risk_snp").alias("second_tag")).distinct()
    snps = s.graph.nodes["SNP"].select("id").join(causal, "id", "left").join(risky, "id", "left")
    tag = F.when(F.col("first_tag").isNotNull() | F.col("second_tag").isNotNull(), F.concat_ws(",", "first_tag", "second_tag"))
    parts = [(genes, "Gene", F.lit("risk_gene")), (proteins, "Protein", F.lit("risk_protein")), (snps, "SNP", tag)]
    return reduce(DataFrame.unionByName, (t.select(F.lit(label).alias("label"), "id", c.alias("node_type")) for t, label, c in parts))


@query("SELECT a.dst AS first_disease, b.dst AS second_disease, count(DISTINCT a.pathway) AS pathways, count(DISTINCT a.src) + count(DISTINCT b.src) AS genes FROM (SELECT DISTINCT r.src, r.dst, w.dst AS pathway FROM risk r JOIN translated t ON t.src = r.src JOIN in_pathway w ON w.src = t.dst WHERE r.risk_score > 0.9) a JOIN (SELECT DISTINCT r.src, r.dst, w.dst AS pathway FROM risk r JOIN translated t ON t.src = r.src JOIN in_pathway w ON w.src = t.dst WHERE r.risk_score > 0.9) b ON a.pathway = b.pathway AND b.dst = a.dst + 1 GROUP BY 1, 2")
def graph_shared_pathways(s: Star) -> DataFrame:
    """Pathways on which a disease and the next meet: they meet as sets of pathways, so no product of genes is made."""
    found = s.graph.match("Gene", "g").hop("g", "INCREASES_RISK_OF", "r", "d", condition="r_risk_score > 0.9").hop("g", "TRANSLATED_INTO", "t", "p").hop("p", "ANNOTATED_IN_PATHWAY", "w", "x")
    arms = found.select(F.col("d_id").alias("disease"), F.col("x_id").alias("pathway"), F.col("g_id").alias("gene")).distinct()
    sets = arms.select("disease", "pathway").distinct()
    met = sets.join(sets.select((F.col("disease") - 1).alias("disease"), "pathway"), ["disease", "pathway"])

    def genes(side: int, name: str) -> DataFrame:
        own = met.select((F.col("disease") + side).alias("disease"), "pathway", F.col("disease").alias("first_disease"))
        return arms.join(own, ["disease", "pathway"]).groupBy("first_disease").agg(F.count_distinct("gene").alias(name))

    pathways = met.groupBy(F.col("disease").alias("first_disease")).agg(F.count("*").alias("pathways"))
    both = pathways.join(genes(0, "a"), "first_disease").join(genes(1, "b"), "first_disease")
    return both.select("first_disease", (F.col("first_disease") + 1).alias("second_disease"), "pathways", (F.col("a") + F.col("b")).alias("genes"))


@query("SELECT g.id AS gene, r.n AS diseases, m.n AS snps, t.n AS proteins, e.n AS tissues, h.n AS processes, w.n AS pathways FROM gene g JOIN (SELECT src, count(DISTINCT dst) AS n FROM risk GROUP BY 1) r ON r.src = g.id JOIN (SELECT dst, count(DISTINCT src) AS n FROM maps_to GROUP BY 1) m ON m.dst = g.id JOIN (SELECT src, count(DISTINCT dst) AS n FROM translated GROUP BY 1) t ON t.src = g.id " + " ".join(f"JOIN (SELECT t.src, count(DISTINCT x.dst) AS n FROM translated t JOIN {v} x ON x.src = t.dst GROUP BY 1) {a} ON {a}.src = g.id" for v, a in (("expressed_in", "e"), ("has_process", "h"), ("in_pathway", "w"))))
def graph_branch_counts(s: Star) -> DataFrame:
    """Distinct counts over the six branches of a gene, for genes that have all of them. Each branch is aggregated by itself, and
    those of two hops as sets of bits, so that no product of genes and targets is made."""
    e = s.graph.edges
    out = e["INCREASES_RISK_OF"].table.groupBy(F.col("src").alias("gene")).agg(F.count_distinct("dst").alias("diseases"))
    out = out.join(e["MAPS_TO"].table.groupBy(F.col("dst").alias("gene")).agg(F.count_distinct("src").alias("snps")), "gene")
    translated = written(e["TRANSLATED_INTO"].table)
    out = out.join(translated.groupBy(F.col("src").alias("gene")).agg(F.count_distinct("dst").alias("proteins")), "gene")
    for kind, name in (("EXPRESSED_IN", "tissues"), ("HAS_PROCESS", "processes"), ("ANNOTATED_IN_PATHWAY", "pathways")):
        far = e[kind].table.select("src", "dst")
        numbers = written(s.graph.nodes[e[kind].target].select(F.col("id").alias("dst"), F.monotonically_increasing_id().alias("number")))
        out = out.join(reach_counts(translated, far, numbers).select(F.col("src").alias("gene"), F.col("n").alias(name)), "gene")
    return out


@query("SELECT 'multi-hop' AS answer, 'Gene->Protein->Pathway requires 2 hops' AS explanation, count(*) AS genes FROM gene")
def graph_constant(s: Star) -> DataFrame:
    """Literal columns beside an aggregate."""
    return s.graph.nodes["Gene"].agg(F.count("*").alias("genes")).select(F.lit("multi-hop").alias("answer"), F.lit("Gene->Protein->Pathway requires 2 hops").alias("explanation"), "genes")


@query("SELECT d.name AS disease, count(DISTINCT r.src) AS genes, array_to_string(list_slice(list_sort(list_distinct(list(r.src))), 1, 5), ',') AS first_genes FROM risk r JOIN disease d ON r.dst = d.id WHERE r.evidence_score > 0.6 GROUP BY 1 HAVING count(DISTINCT r.src) >= 5")
def graph_valid_entities(s: Star) -> DataFrame:
    """Diseases with five genes of strong evidence at least: the entities that questions can ask about."""
    rows = s.graph.match("Gene", "g").hop("g", "INCREASES_RISK_OF", "r", "d", condition="r_evidence_score > 0.6").rows
    found = first_names(rows.select(F.col("d_name").alias("disease"), "g_id"), ["disease"], "g_id", 5)
    return found.filter("n >= 5").select("disease", F.col("n").alias("genes"), F.col("found").alias("first_genes"))


@query("SELECT count(*) AS genes, count(CASE WHEN n = 0 THEN 1 END) AS orphans, count(CASE WHEN n = 1 THEN 1 END) AS single, count(CASE WHEN n > 1 THEN 1 END) AS multiple FROM (SELECT g.id, count(t.dst) AS n FROM gene g LEFT JOIN translated t ON t.src = g.id GROUP BY 1)")
def graph_gene_protein_consistency(s: Star) -> DataFrame:
    """Genes by how many proteins they have."""
    rows = s.graph.match("Gene", "g").hop("g", "TRANSLATED_INTO", "t", "p", optional=True).rows.groupBy("g_id").agg(F.count("p_id").alias("n"))
    return rows.agg(F.count("*").alias("genes"), F.count_if(F.col("n") == 0).alias("orphans"), F.count_if(F.col("n") == 1).alias("single"), F.count_if(F.col("n") > 1).alias("multiple"))


@query("SELECT source_label, target_label, count(*) AS edges FROM (SELECT 'SNP' AS source_label, 'Gene' AS target_label FROM maps_to UNION ALL SELECT 'Gene', 'Disease' FROM risk UNION ALL SELECT 'Gene', 'Protein' FROM translated) GROUP BY 1, 2")
def graph_any_type_expand(s: Star) -> DataFrame:
    """Edges of any type, narrowed to three types, by the labels of their ends."""
    edges = s.graph.any_edge().filter(F.col("type").isin("MAPS_TO", "INCREASES_RISK_OF", "TRANSLATED_INTO"))
    return edges.groupBy("source_label", "target_label").agg(F.count("*").alias("edges"))


@query("SELECT least(a, b) AS x, greatest(a, b) AS y, CAST(max(w) AS BIGINT) AS weight FROM (SELECT src AS a, dst AS b, 700 + src % 300 AS w FROM interacts UNION ALL SELECT dst, src, 400 + dst % 300 FROM interacts) WHERE w >= 500 GROUP BY 1, 2")
def graph_canonical_edges(s: Star) -> DataFrame:
    """An undirected weighted graph: each edge once, its best weight, beyond a threshold."""
    e = s.graph.edges["INTERACTS_WITH"].table
    both = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), (700 + F.col("src") % 300).alias("w")).unionByName(e.select(F.col("dst").alias("a"), F.col("src").alias("b"), (400 + F.col("dst") % 300).alias("w")))
    return both.filter("w >= 500").groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.max("w").alias("weight"))


@query("SELECT i.src, i.dst FROM interacts i WHERE i.src IN (SELECT src FROM associated WHERE score > 0.3) AND i.dst IN (SELECT src FROM associated WHERE score > 0.3)")
def graph_induced_subgraph(s: Star) -> DataFrame:
    """Interactions whose two ends are in a node set."""
    chosen = s.graph.edges["ASSOCIATED_WITH"].table.filter("score > 0.3").select(F.col("src").alias("k"))
    e = s.graph.edges["INTERACTS_WITH"].table
    return e.join(chosen, F.col("src") == F.col("k"), "left_semi").join(chosen, F.col("dst") == F.col("k"), "left_semi").select("src", "dst")


def stored(s: Star, labels: list[str], kinds: list[str]) -> str:
    """A part of the graph as stored tables; the name under which they are."""
    name = f"graph_{uuid.uuid4().hex}"
    graph_store.store(Graph({k: s.graph.nodes[k] for k in labels}, {k: s.graph.edges[k] for k in kinds}), name, graph_store.buckets_for(s.table("lineitem").count()))  # no type has more edges than that
    return name


@query("SELECT t.src AS gene, count(*) AS paths, count(DISTINCT h.dst) AS processes FROM gene JOIN translated t ON t.src = gene.id JOIN has_process h ON t.dst = h.src GROUP BY 1")
def graph_stored_hops(s: Star) -> DataFrame:
    """Paths from each gene by its proteins to processes, over a stored graph: no edge moves."""
    graph = graph_store.opened(s.spark, stored(s, ["Gene", "Protein", "Process"], ["TRANSLATED_INTO", "HAS_PROCESS"]))
    found = graph.match("Gene", "g").hop("g", "TRANSLATED_INTO", "t", "p", id_only=True).hop("p", "HAS_PROCESS", "h", "q", id_only=True)
    return found.rows.groupBy(F.col("g_id").alias("gene")).agg(F.count("*").alias("paths"), F.count_distinct("q_id").alias("processes"))


@query("""SELECT 'node' AS kind, 'SNP' AS name, NULL AS source, NULL AS target, count(*) AS n FROM snp UNION ALL SELECT 'node', 'Gene', NULL, NULL, count(*) FROM gene UNION ALL SELECT 'node', 'Disease', NULL, NULL, count(*) FROM disease
UNION ALL SELECT 'edge', 'MAPS_TO', 'SNP', 'Gene', count(*) FROM maps_to UNION ALL SELECT 'edge', 'PUTATIVE_CAUSAL_EFFECT', 'SNP', 'Disease', count(*) FROM causal UNION ALL SELECT 'edge', 'INCREASES_RISK_OF', 'Gene', 'Disease', count(*) FROM risk""")
def graph_stored_catalogue(s: Star) -> DataFrame:
    """Labels, types and counts of a stored graph, read from its catalogue."""
    name = stored(s, ["SNP", "Gene", "Disease"], ["MAPS_TO", "PUTATIVE_CAUSAL_EFFECT", "INCREASES_RISK_OF"])
    return graph_store.catalogue(s.spark, name).select("kind", "name", "source", "target", "n")
