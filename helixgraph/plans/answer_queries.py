"""Queries over answers of the graph: shaping, grounding, answerability, approach tables, gene names and consequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..sources.star import Star
from . import registry
from .evaluation_queries import LISTS, WORDS, lists
from .graph_queries import query, top


@query("SELECT p.id, CASE WHEN p.id % 2 = 0 THEN '' || p.id WHEN d.name LIKE 'P%' THEN d.name ELSE '' || d.id END AS answer_id, CASE WHEN p.id % 2 = 0 THEN d.name WHEN d.name LIKE 'P%' THEN p.name ELSE d.name END AS answer_name FROM protein p JOIN associated a ON a.src = p.id JOIN disease d ON a.dst = d.id WHERE NOT (p.id % 2 = 0 AND (d.name LIKE 'P%' OR d.name LIKE 'Q%'))")
def answer_shaping(s: Star) -> DataFrame:
    """Names are preferred to identifiers."""
    found = s.graph.match("Protein", "p").hop("p", "ASSOCIATED_WITH", "a", "d").where("NOT (p_id % 2 = 0 AND (d_name LIKE 'P%' OR d_name LIKE 'Q%'))").rows
    even = F.col("p_id") % 2 == 0
    peru = F.col("d_name").startswith("P")
    value = F.when(even | peru, F.col("d_name"))
    name = F.when(even | peru, F.col("p_name")).otherwise(F.col("d_name"))
    identifier = F.when(even, F.col("p_id")).otherwise(F.col("d_id").cast("long"))
    shaped = A.shape_answer(value, name, identifier)
    return found.select(F.col("p_id").alias("id"), shaped["id"].alias("answer_id"), shaped["name"].alias("answer_name"))


HEADS = f"(SELECT conv_id, turn, type, {WORDS.format('predicted')} AS p, {WORDS.format('gold')} AS g FROM answers)"


@query(f"SELECT type, count(*) AS n, round(avg(CASE WHEN len(p) = 0 THEN 0.0 ELSE len(list_filter(p, lambda x: NOT list_contains(g, x) AND NOT list_contains(['the', 'of', 'and', 'a', 'to'], x))) / len(p) END), 9) AS hallucination FROM {HEADS} GROUP BY 1")
def answer_hallucination(s: Star) -> DataFrame:
    """Predictions that are neither gold nor known, by type."""
    rows = lists(s).select("type", "p", "g")
    known = F.array(*(F.lit(w) for w in ("the", "of", "and", "a", "to")))
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg(A.hallucination_rate(F.col("p"), F.col("g"), known)), 9).alias("hallucination"))


@query(f"SELECT conv_id, turn, round(CASE WHEN h > 0 THEN 2 * (h / len(p)) * least(h / len(g), 1.0) / ((h / len(p)) + least(h / len(g), 1.0)) ELSE 0.0 END, 9) AS f1 FROM (SELECT *, len(list_filter(p, lambda x: len(list_filter(g, lambda y: contains(y, x) OR contains(x, y))) > 0)) AS h FROM {HEADS})")
def answer_substring_f1(s: Star) -> DataFrame:
    """F1 with substring matches."""
    rows = lists(s).select("conv_id", "turn", "p", "g")
    return rows.select("conv_id", "turn", F.round(A.substring_f1(F.col("p"), F.col("g")), 9).alias("f1"))


@query(f"SELECT type, count(CASE WHEN n > 0 THEN 1 END) AS matched, count(*) AS total, round(100.0 * count(CASE WHEN n > 0 THEN 1 END) / count(*), 2) AS em_pct FROM {LISTS} GROUP BY 1")
def answer_any_overlap(s: Star) -> DataFrame:
    """Exact match in the loose sense: any overlap of prediction and gold."""
    some = F.count_if(F.arrays_overlap("p", "g"))
    return lists(s).groupBy("type").agg(some.alias("matched"), F.count("*").alias("total"), F.round(some * 100.0 / F.count("*"), 2).alias("em_pct"))


@query("SELECT kind, count(CASE WHEN answerable = 'yes' THEN 1 END) AS yes, count(CASE WHEN answerable = 'no' THEN 1 END) AS no, count(CASE WHEN answerable = 'unknown' THEN 1 END) AS unknown FROM (SELECT s_suppkey % 3 AS kind, CASE WHEN s_suppkey % 3 = 2 THEN 'unknown' WHEN s_suppkey % 3 = 0 AND a.src IS NOT NULL THEN 'yes' WHEN s_suppkey % 3 = 1 AND i.src IS NOT NULL THEN 'yes' ELSE 'no' END AS answerable FROM supplier LEFT JOIN (SELECT DISTINCT src FROM associated WHERE score > 0.5) a ON a.src = s_suppkey LEFT JOIN (SELECT DISTINCT src FROM interacts) i ON i.src = s_suppkey) GROUP BY 1")
def question_answerability(s: Star) -> DataFrame:
    """Questions that the graph can answer, can't, or has no rule for, by kind."""
    e = s.graph.edges
    a = e["ASSOCIATED_WITH"].table.filter("score > 0.5").select(F.col("src").alias("a")).distinct()
    i = e["INTERACTS_WITH"].table.select(F.col("src").alias("i")).distinct()
    rows = s.table("supplier").join(a, F.col("s_suppkey") == F.col("a"), "left").join(i, F.col("s_suppkey") == F.col("i"), "left")
    kind = F.col("s_suppkey") % 3
    verdict = F.when(kind == 2, "unknown").when((kind == 0) & F.col("a").isNotNull(), "yes").when((kind == 1) & F.col("i").isNotNull(), "yes").otherwise("no")
    return rows.groupBy(kind.alias("kind")).agg(*(F.count_if(verdict == v).alias(v) for v in ("yes", "no", "unknown")))


@query("SELECT gene, type, target_label, target FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY type, target) AS n FROM (SELECT src AS gene, 'INCREASES_RISK_OF' AS type, 'Disease' AS target_label, CAST(dst AS VARCHAR) AS target FROM risk UNION ALL SELECT src, 'TRANSLATED_INTO', 'Protein', CAST(dst AS VARCHAR) FROM translated)) WHERE n <= 100")
def graph_expand_all(s: Star) -> DataFrame:
    """Up to a hundred out-edges of each gene with the labels of their targets: the fallback of questions."""
    edges = s.graph.any_edge().filter("source_label = 'Gene'").select(F.col("src").cast("long").alias("gene"), "type", "target_label", F.col("dst").alias("target"))
    return top(s.spread(edges, "gene"), ["gene"], [F.col("type"), F.col("target")], 100)


@query("SELECT src AS gene, dst AS disease, risk_score FROM risk ORDER BY risk_score DESC, src, dst LIMIT 50")
def graph_default_limit(s: Star) -> DataFrame:
    """A query without a limit of its own gets one of fifty rows."""
    return with_limit(s.risk.select(F.col("src").alias("gene"), F.col("dst").alias("disease"), "risk_score").orderBy(F.desc("risk_score"), "gene", "disease"))


def with_limit(df: DataFrame, most: int | None = None) -> DataFrame:
    """The limit asked for, or the default of 50."""
    return df.limit(50 if most is None else most)


@query("SELECT a.src AS first_gene, a.dst AS disease, CASE WHEN a.risk_score > b.risk_score THEN a.src ELSE b.src END AS riskier, abs(a.risk_score - b.risk_score) AS gap FROM risk a JOIN risk b ON b.src = a.src + 1 AND b.dst = a.dst")
def graph_compare_genes(s: Star) -> DataFrame:
    """Which of two genes raises the risk of a disease more: one of two entities is returned."""
    risk = s.graph.edges["INCREASES_RISK_OF"].table
    a = risk.select(F.col("src").alias("first_gene"), F.col("dst").alias("disease"), F.col("risk_score").alias("x"))
    b = risk.select((F.col("src") - 1).alias("first_gene"), F.col("dst").alias("disease"), F.col("risk_score").alias("y"))
    return a.join(b, ["first_gene", "disease"]).select("first_gene", "disease", F.when(F.col("x") > F.col("y"), F.col("first_gene")).otherwise(F.col("first_gene") + 1).alias("riskier"), F.abs(F.col("x") - F.col("y")).alias("gap"))


@query("SELECT g.id AS gene, array_to_string(list_transform(list_slice(list_sort(list({'s': -r.risk_score, 'd': r.dst})), 1, 3), lambda x: x.d || ':' || round(-x.s, 4)), ',') AS best FROM gene g JOIN risk r ON r.src = g.id GROUP BY 1")
def graph_collected_maps(s: Star) -> DataFrame:
    """The three diseases of the highest risk of each gene as collected records."""
    rows = s.graph.match("Gene", "g").hop("g", "INCREASES_RISK_OF", "r", "d").rows
    first = top(rows.select(F.col("g_id").alias("gene"), (-F.col("r_risk_score")).alias("s"), F.col("d_id").alias("d")), ["gene"], [F.col("s"), F.col("d")], 3)
    best = F.sort_array(F.collect_list(F.struct("s", "d")))
    return first.groupBy("gene").agg(F.array_join(F.transform(best, lambda x: F.concat(x["d"], F.lit(":"), F.round(-x["s"], 4))), ",").alias("best"))


@query("SELECT count(*) AS names, count(CASE WHEN starts_with(name, 'a') OR starts_with(name, 'b') THEN 1 END) AS early, count(DISTINCT name) AS distinct_names FROM gene WHERE NOT (contains(name, 'APOC4-APOC2') OR starts_with(name, 'CTB-') OR starts_with(name, 'C19orf') OR starts_with(name, 'C6orf'))")
def gene_clean_names(s: Star) -> DataFrame:
    """Genes with proper names."""
    kept = s.genes.filter(A.clean_gene(F.col("name")))
    return kept.agg(F.count("*").alias("names"), F.count_if(F.col("name").startswith("a") | F.col("name").startswith("b")).alias("early"), F.count_distinct("name").alias("distinct_names"))


@query("SELECT disease, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS coding, count(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 END) AS pathogenic, round(max(neglog10p), 9) AS best FROM variants JOIN orders ON rsid = 'rs' || o_orderkey GROUP BY 1")
def gene_consequence_counts(s: Star) -> DataFrame:
    """Coding and pathogenic variants, by membership and by substring."""
    from .genetic_queries import annotated

    rows = annotated(s)
    return rows.groupBy("disease").agg(
        F.count_if(A.coding(F.col("consequence"))).alias("coding"), F.count_if(A.pathogenic(F.col("significance"))).alias("pathogenic"), F.round(F.max("neglog10p"), 9).alias("best")
    )


@query("SELECT source, lang, n, accuracy FROM (SELECT source, lang, count(*) AS n, round(avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM labelled GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY source ORDER BY accuracy DESC, lang) = 1")
def label_best_cell(s: Star) -> DataFrame:
    """The best language of each source."""
    cells = s.labelled.groupBy("source", "lang").agg(F.count("*").alias("n"), F.round(F.avg((F.col("truth") == F.col("predicted")).cast("double")), 9).alias("accuracy"))
    best = F.min_by(F.struct("lang", "n", "accuracy"), F.struct(-F.col("accuracy"), "lang"))
    return cells.groupBy("source").agg(best.alias("b")).select("source", "b.*")


@query("SELECT model, purchases, views, CASE WHEN views > 0 THEN CAST(purchases AS DOUBLE) / views END AS per_view FROM (SELECT CAST(user_id % 10 AS BIGINT) AS model, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS purchases, count(CASE WHEN event_type = 'view' THEN 1 END) AS views FROM events GROUP BY 1)")
def call_approach_table(s: Star) -> DataFrame:
    """Two measures side by side and their ratio, guarded against zero."""
    wide = s.table("events").groupBy((F.col("user_id") % 10).alias("model")).agg(F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.count_if(F.col("event_type") == "view").alias("views"))
    return wide.withColumn("per_view", F.try_divide(F.col("purchases"), F.col("views")))
