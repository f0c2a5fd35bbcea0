"""Queries of the genetic evidence pipeline: quality control, scoring, mapping, aggregation, ranking and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import enrichment, variants as V
from ..sources.session import ranked
from ..sources.star import Star
from .graph_queries import first_names, query, top

RISK = "least(neglog10p / 10, 1.0) * 0.3 + (CASE WHEN susie >= 0 AND finemap >= 0 THEN (susie + finemap) / 2 WHEN susie >= 0 THEN susie WHEN finemap >= 0 THEN finemap ELSE 0.0 END) * 0.7"


@query("SELECT disease, count(*) AS rows, count(CASE WHEN p < 5e-8 THEN 1 END) AS significant, count(CASE WHEN p < 5e-8 AND maf BETWEEN 0.001 AND 0.5 THEN 1 END) AS frequent, count(CASE WHEN p < 5e-8 AND maf BETWEEN 0.001 AND 0.5 AND beta > 0 THEN 1 END) AS risky FROM variants GROUP BY 1")
def gene_filter_counts(s: Star) -> DataFrame:
    """How many variants each filter leaves."""
    sig, maf, up = F.col("p") < K.GENOME_WIDE, F.col("maf").between(K.MAF_LEAST, K.MAF_MOST), F.col("beta") > 0
    return s.variants.groupBy("disease").agg(F.count("*").alias("rows"), F.count_if(sig).alias("significant"), F.count_if(sig & maf).alias("frequent"), F.count_if(sig & maf & up).alias("risky"))


@query("SELECT rsid, gene, beta, maf, round(neglog10p, 9) AS neglog10p FROM variants WHERE p < 5e-8 AND maf BETWEEN 0.001 AND 0.5 AND beta > 0")
def gene_filtered(s: Star) -> DataFrame:
    """Significant, frequent variants that raise the risk."""
    kept = V.raises_risk(V.usual_frequency(V.significant(s.variants)))
    return kept.select("rsid", "gene", "beta", "maf", F.round("neglog10p", 9).alias("neglog10p"))


@query("SELECT count(*) AS rows, count(CASE WHEN rsid IS NULL THEN 1 END) AS null_rsid, count(CASE WHEN p <= 0 OR p > 1 THEN 1 END) AS bad_p, count(CASE WHEN chr < 1 OR chr > 22 THEN 1 END) AS bad_chr, count(DISTINCT rsid) AS rsids FROM variants")
def gene_quality(s: Star) -> DataFrame:
    """Data-quality rules in one pass."""
    p = F.col("p")
    return s.variants.agg(F.count("*").alias("rows"), F.count_if(F.col("rsid").isNull()).alias("null_rsid"), F.count_if((p <= 0) | (p > 1)).alias("bad_p"), F.count_if(~F.col("chr").between(1, 22)).alias("bad_chr"), F.count_distinct("rsid").alias("rsids"))


@query("SELECT 'susie' AS method, count(CASE WHEN susie >= 0 THEN 1 END) AS n, round(100.0 * count(CASE WHEN susie >= 0 THEN 1 END) / count(*), 2) AS pct FROM variants UNION ALL SELECT 'finemap', count(CASE WHEN finemap >= 0 THEN 1 END), round(100.0 * count(CASE WHEN finemap >= 0 THEN 1 END) / count(*), 2) FROM variants")
def gene_method_coverage(s: Star) -> DataFrame:
    """Coverage of each fine-mapping method, as rows."""
    one = s.variants.agg(F.count_if(F.col("susie") >= 0).alias("susie"), F.count_if(F.col("finemap") >= 0).alias("finemap"), F.count("*").alias("total"))
    long = one.unpivot(["total"], ["susie", "finemap"], "method", "n")
    return long.select("method", "n", F.round(F.col("n") * 100.0 / F.col("total"), 2).alias("pct"))


@query(f"SELECT rsid, gene, round(max({RISK}), 9) AS risk_score, max((CASE WHEN susie >= 0 THEN 1 ELSE 0 END) + (CASE WHEN finemap >= 0 THEN 1 ELSE 0 END)) AS most_valid FROM variants GROUP BY 1, 2")
def gene_risk_scores(s: Star) -> DataFrame:
    """Risk from evidence and causality, with failed methods left out of the mean."""
    return V.scored(s.variants, ["susie", "finemap"]).groupBy("rsid", "gene").agg(F.round(F.max("risk_score"), 9).alias("risk_score"), F.max("n_valid").alias("most_valid"))


@query("SELECT rsid, gene, bp, beta FROM (SELECT rsid, gene, bp, beta, row_number() OVER (PARTITION BY rsid ORDER BY neglog10p DESC, bp, gene, beta) AS n FROM variants) WHERE n = 1")
def gene_best_per_variant(s: Star) -> DataFrame:
    """The most significant row of each variant."""
    return V.keep_best(s.variants, ["rsid"], [F.desc("neglog10p"), F.col("bp"), F.col("gene"), F.col("beta")]).select("rsid", "gene", "bp", "beta")


@query("SELECT DISTINCT rsid, gene, distance FROM variants v WHERE NOT EXISTS (SELECT 1 FROM variants w WHERE w.rsid = v.rsid AND w.distance = 0) OR distance = 0")
def gene_inside_first(s: Star) -> DataFrame:
    """Gene mappings, those inside a gene taking precedence."""
    return V.inside_first(s.variants.select("rsid", "gene", "distance").distinct(), ["rsid"])


ANNOTATED = """(SELECT v.*, CASE o_orderpriority WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN 0.8 WHEN '3-MEDIUM' THEN 0.3 ELSE 0.0 END::DOUBLE AS clinical_score, CASE o_orderstatus WHEN 'F' THEN 0.7 WHEN 'O' THEN 0.3 ELSE 0.0 END::DOUBLE AS consequence_score FROM variants v LEFT JOIN orders ON v.rsid = 'rs' || o_orderkey)"""


def annotated(s: Star) -> DataFrame:
    """Variants with clinical significance and consequence, joined by id; unknown ones score 0."""
    orders = s.table("orders")
    clinical = F.when(F.col("o_orderpriority") == "1-URGENT", "pathogenic").when(F.col("o_orderpriority") == "2-HIGH", "likely_pathogenic").when(F.col("o_orderpriority") == "3-MEDIUM", "uncertain_significance")
    consequence = F.when(F.col("o_orderstatus") == "F", "missense_variant").when(F.col("o_orderstatus") == "O", "synonymous_variant")
    notes = orders.select(F.concat(F.lit("rs"), F.col("o_orderkey")).alias("rsid"), clinical.alias("significance"), consequence.alias("consequence"))
    joined = s.variants.join(notes, "rsid", "left").fillna("not_annotated", ["significance", "consequence"])
    return joined.withColumns({"clinical_score": V.looked_up(K.CLINICAL_SCORES, F.col("significance")), "consequence_score": V.looked_up(K.CONSEQUENCE_SCORES, F.col("consequence"))})


@query(f"SELECT clinical_score, consequence_score, count(*) AS n, count(CASE WHEN clinical_score > 0 THEN 1 END) AS annotated FROM {ANNOTATED} GROUP BY 1, 2")
def gene_annotation_counts(s: Star) -> DataFrame:
    """Annotated variants by their scores."""
    return annotated(s).groupBy("clinical_score", "consequence_score").agg(F.count("*").alias("n"), F.count_if(F.col("clinical_score") > 0).alias("annotated"))


EXTENDED = f"(SELECT *, ({RISK}) * 0.65 + abs(beta) / 5 * 0.0 + clinical_score * 0.05 + consequence_score * 0.10 + least(neglog10p / 10, 1.0) * 0.20 AS extended_score FROM {ANNOTATED})"


def extended(s: Star) -> DataFrame:
    return V.extended(V.scored(annotated(s), ["susie", "finemap"]).withColumn("effect_score", F.abs("beta") / 5))


@query(f"SELECT gene, round(max(extended_score), 6) AS gene_score, count(*) AS snp_count, count(CASE WHEN p < 5e-8 THEN 1 END) AS n_sig, round(max(neglog10p), 6) AS best_neglog10p FROM {EXTENDED} GROUP BY 1")
def gene_aggregates(s: Star) -> DataFrame:
    """Best score, counts and significance of each gene."""
    return V.gene_scores(extended(s), "extended_score").select("gene", F.round("gene_score", 6).alias("gene_score"), "snp_count", "n_sig", F.round("best_neglog10p", 6).alias("best_neglog10p"))


@query(f"SELECT gene, round(best + (1 - best) * 0.3 * CASE WHEN most > 0 THEN ln(1 + n) / ln(1 + most) ELSE 0 END, 9) AS bonus_score FROM (SELECT gene, best, n, max(n) OVER () AS most FROM (SELECT gene, max(extended_score) AS best, count(CASE WHEN p < 5e-8 THEN 1 END) AS n FROM {EXTENDED} GROUP BY 1))")
def gene_bonus_scores(s: Star) -> DataFrame:
    """Gene scores with a bonus for many significant variants."""
    return V.gene_scores(extended(s), "extended_score").select("gene", F.round("bonus_score", 9).alias("bonus_score"))


@query("SELECT gene, arg_min(rsid, (-q, rsid)) AS best_snp, max(q) AS best FROM (SELECT gene, rsid, round(neglog10p, 9) AS q FROM variants) GROUP BY 1")
def gene_best_variant(s: Star) -> DataFrame:
    """The most significant variant of each gene, the first by id on ties."""
    rows = s.variants.select("gene", "rsid", F.round("neglog10p", 9).alias("q"))
    return rows.groupBy("gene").agg(F.min_by("rsid", F.struct(-F.col("q"), "rsid")).alias("best_snp"), F.max("q").alias("best"))


@query("SELECT gene, array_to_string(list_slice(list_sort(list_distinct(list(rsid))), 1, 5), ',') AS first_snps, count(DISTINCT rsid) AS snps FROM variants GROUP BY 1")
def gene_first_variants(s: Star) -> DataFrame:
    """Up to five variants of each gene, joined."""
    found = first_names(s.variants, ["gene"], "rsid", 5)
    return found.select("gene", F.col("found").alias("first_snps"), F.col("n").alias("snps"))


@query("SELECT CAST(l_partkey AS BIGINT) AS gene, count(*) AS snps, count(CASE WHEN distance = 0 THEN 1 END) AS inside, min(distance) AS nearest FROM (SELECT g.p_partkey AS l_partkey, greatest(g.p_partkey * 1000 - v.bp, v.bp - (g.p_partkey * 1000 + 500), 0) AS distance FROM variants v JOIN part g ON v.chr = g.p_partkey % 22 + 1 AND v.bp BETWEEN g.p_partkey * 1000 - 5000 AND g.p_partkey * 1000 + 5500) GROUP BY 1")
def gene_range_join(s: Star) -> DataFrame:
    """Variants within a window of each gene on its chromosome."""
    key = F.col("p_partkey")
    spans = s.table("part").select(key.alias("near_gene"), (key % 22 + 1).cast("int").alias("chr"), (key * 1000).alias("start"), (key * 1000 + 500).alias("end"))
    near = V.near_genes(s.variants.select("chr", "bp"), spans, 5000)
    return near.groupBy(F.col("near_gene").alias("gene")).agg(F.count("*").alias("snps"), F.count_if(F.col("distance_to_gene") == 0).alias("inside"), F.min("distance_to_gene").alias("nearest"))


@query("SELECT gene, n, CASE WHEN hi > lo THEN CAST(n - lo AS DOUBLE) / (hi - lo) ELSE 0 END AS scaled FROM (SELECT gene, n, min(n) OVER () AS lo, max(n) OVER () AS hi FROM (SELECT gene, count(*) AS n FROM variants GROUP BY 1))")
def gene_min_max(s: Star) -> DataFrame:
    """Variant counts scaled to 0..1."""
    return V.min_max(s.variants.groupBy("gene").agg(F.count("*").alias("n")), "n", "scaled")


@query("SELECT gene, a, r, CAST(a + r AS DOUBLE) / 2 AS mean_count FROM (SELECT gene, count(*) AS a FROM variants WHERE disease = 'A' GROUP BY 1) JOIN (SELECT gene, count(*) AS r FROM variants WHERE disease = 'R' GROUP BY 1) USING (gene)")
def gene_shared(s: Star) -> DataFrame:
    """Genes of both diseases with averaged counts."""
    counts = s.variants.filter(F.col("disease").isin("A", "R")).groupBy("gene").pivot("disease", ["A", "R"]).agg(F.count(F.lit(1)))
    return counts.filter(F.col("A").isNotNull() & F.col("R").isNotNull()).select("gene", F.col("A").alias("a"), F.col("R").alias("r"), ((F.col("A") + F.col("R")) / 2).alias("mean_count"))


@query("SELECT category, count(*) AS genes FROM (SELECT gene, CASE WHEN max(CASE WHEN disease = 'A' THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN disease = 'R' THEN 1 ELSE 0 END) = 1 THEN 'shared' WHEN max(CASE WHEN disease = 'A' THEN 1 ELSE 0 END) = 1 THEN 'first_only' ELSE 'second_only' END AS category FROM variants WHERE disease IN ('A', 'R') AND p < 5e-8 GROUP BY 1) GROUP BY 1")
def gene_categories(s: Star) -> DataFrame:
    """The union of two gene sets, what is in both taking precedence: a full outer join."""
    sig = V.significant(s.variants)
    a = sig.filter("disease = 'A'").select("gene", F.lit(1).alias("a")).distinct()
    r = sig.filter("disease = 'R'").select("gene", F.lit(1).alias("r")).distinct()
    category = F.when(F.col("a").isNotNull() & F.col("r").isNotNull(), "shared").when(F.col("a").isNotNull(), "first_only").otherwise("second_only")
    return a.join(r, "gene", "full_outer").groupBy(category.alias("category")).agg(F.count("*").alias("genes"))


@query("SELECT gene FROM variants WHERE disease = 'A' AND p < 5e-8 INTERSECT SELECT gene FROM variants WHERE disease = 'N' AND p < 5e-8")
def gene_intersection(s: Star) -> DataFrame:
    sig = V.significant(s.variants)
    return sig.filter("disease = 'A'").select("gene").intersect(sig.filter("disease = 'N'").select("gene"))


@query("SELECT gene FROM variants WHERE disease = 'A' AND p < 5e-8 EXCEPT SELECT gene FROM variants WHERE disease = 'N' AND p < 5e-8")
def gene_difference(s: Star) -> DataFrame:
    sig = V.significant(s.variants)
    return sig.filter("disease = 'A'").select("gene").subtract(sig.filter("disease = 'N'").select("gene"))


@query("SELECT gene, n, row_number() OVER (ORDER BY n DESC, gene) AS rank FROM (SELECT gene, count(*) AS n FROM variants GROUP BY 1) QUALIFY rank <= 500")
def gene_top_ranked(s: Star) -> DataFrame:
    """The 500 genes with the most variants, ranked: the limit comes before the ranking."""
    first = s.variants.groupBy("gene").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gene").limit(500)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "gene")).cast("long"))


@query("SELECT disease, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM variants GROUP BY 1")
def gene_value_counts(s: Star) -> DataFrame:
    """Counts and shares of a column's values."""
    counts = s.variants.groupBy("disease").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("disease", "n", F.round(F.col("n") * 100.0 / F.col("total"), 4).alias("pct"))


@query(f"SELECT round(corr({RISK}, extended_score), 9) AS correlation, round(avg(CASE WHEN clinical_score > 0 THEN 1.0 ELSE 0.0 END), 9) AS coverage, round(avg(({RISK}) * 0.65), 9) AS risk_part, round(avg(clinical_score * 0.05), 9) AS clinical_part FROM {EXTENDED}")
def gene_contributions(s: Star) -> DataFrame:
    """Correlation of two scores, coverage of annotations and mean contributions of components."""
    rows = extended(s)
    return rows.agg(
        F.round(F.corr("risk_score", "extended_score"), 9).alias("correlation"),
        F.round(F.avg(F.when(F.col("clinical_score") > 0, 1.0).otherwise(0.0)), 9).alias("coverage"),
        F.round(F.avg(F.col("risk_score") * K.EXTENDED_WEIGHTS["risk"]), 9).alias("risk_part"),
        F.round(F.avg(F.col("clinical_score") * K.EXTENDED_WEIGHTS["clinical"]), 9).alias("clinical_part"),
    )


TERMS = "(SELECT p_type AS library, p_brand AS term, list(DISTINCT p_partkey % 50) AS genes, min(p_retailprice) AS best FROM part GROUP BY 1, 2)"


def terms(s: Star) -> DataFrame:
    """Enrichment terms: a library, a gene list and a value to rank by."""
    return s.table("part").groupBy(F.col("p_type").alias("library"), F.col("p_brand").alias("term")).agg(F.collect_set(F.col("p_partkey") % 50).alias("genes"), F.min("p_retailprice").alias("best"))


@query(f"SELECT library, term, len(list_intersect(genes, [1, 2, 3, 4, 5, 6, 7, 8])) AS n_first, len(list_intersect(genes, [7, 8, 9, 10, 11, 12])) AS n_second, len(list_intersect(genes, [7, 8])) AS n_shared, CASE WHEN len(list_intersect(genes, [7, 8])) > 0 THEN 'shared' WHEN len(list_intersect(genes, [1, 2, 3, 4, 5, 6, 7, 8])) > len(list_intersect(genes, [7, 8, 9, 10, 11, 12])) THEN 'first' ELSE 'second' END AS dominance FROM {TERMS}")
def gene_term_overlap(s: Star) -> DataFrame:
    """Overlap of each term's genes with two gene sets, and which one dominates."""
    def n(values: list[int]) -> F.Column:
        return F.size(F.array_intersect("genes", F.array(*(F.lit(v).cast("long") for v in values)))).cast("long")

    rows = terms(s).select("library", "term", n([1, 2, 3, 4, 5, 6, 7, 8]).alias("n_first"), n([7, 8, 9, 10, 11, 12]).alias("n_second"), n([7, 8]).alias("n_shared"))
    return rows.withColumn("dominance", F.when(F.col("n_shared") > 0, "shared").when(F.col("n_first") > F.col("n_second"), "first").otherwise("second"))


@query(f"SELECT library, count(*) AS n_terms, min(best) AS best, substring(arg_min(term, (best, term)), 1, 5) AS top_term, max(len(genes)) AS most_genes FROM {TERMS} GROUP BY 1")
def gene_enrichment_summary(s: Star) -> DataFrame:
    """The best term of each library, its text cut, and sizes."""
    return terms(s).groupBy("library").agg(F.count("*").alias("n_terms"), F.min("best").alias("best"), F.substring(F.min_by("term", F.struct("best", "term")), 1, 5).alias("top_term"), F.max(F.size("genes")).cast("long").alias("most_genes"))


@query(f"SELECT gene, rsid, round(extended_score, 6) AS extended_score FROM {EXTENDED} ORDER BY round(extended_score, 6) DESC, gene, rsid LIMIT 1")
def gene_global_best(s: Star) -> DataFrame:
    """The gene and variant of the highest score of all."""
    score = F.round("extended_score", 6)
    best = F.min_by(F.struct("gene", "rsid", score.alias("extended_score")), F.struct(-score, "gene", "rsid"))
    return extended(s).agg(best.alias("b")).select("b.*")


_FULL = "SELECT CAST(gene AS BIGINT) AS gene_id, name AS gene_name, round(max(x), 6) AS gene_score, round(avg(x), 6) AS mean_extended_score, round(max(r), 6) AS max_risk_score, round(avg(r), 6) AS mean_risk_score, count(r) AS snp_count, round(max(c), 6) AS max_causal, round(max(e), 6) AS max_evidence, max(clinical_score) AS max_clinvar, max(consequence_score) AS max_vep, max(beta) AS max_beta, min(q) AS min_p_exponent, max(v) AS max_valid_pips"


@query(f"""WITH rows AS (SELECT x0.*, g.name, extended_score AS x, {RISK} AS r, CASE WHEN susie >= 0 AND finemap >= 0 THEN (susie + finemap) / 2 WHEN susie >= 0 THEN susie WHEN finemap >= 0 THEN finemap ELSE 0.0 END AS c, least(neglog10p / 10, 1.0) AS e, -round(neglog10p, 6) AS q, (CASE WHEN susie >= 0 THEN 1 ELSE 0 END) + (CASE WHEN finemap >= 0 THEN 1 ELSE 0 END) AS v FROM {EXTENDED} x0 JOIN gene g ON x0.gene = g.id),
ranked AS (SELECT gene, rsid, x, bp, beta, row_number() OVER (PARTITION BY gene ORDER BY round(x, 6) DESC, rsid, bp, beta, q) AS n FROM rows),
firsts AS (SELECT gene, string_agg(rsid, ',' ORDER BY m) AS snps FROM (SELECT gene, rsid, row_number() OVER (PARTITION BY gene ORDER BY min(n)) AS m FROM ranked GROUP BY gene, rsid) WHERE m <= 5 GROUP BY 1)
SELECT t.*, f.snps, b.rsid AS best_snp, round(b.x, 6) AS best_snp_extended, b.bp AS best_snp_position, b.beta AS best_snp_beta, row_number() OVER (ORDER BY gene_score DESC, gene_id) AS rank FROM ({_FULL} FROM rows GROUP BY gene, name) t JOIN firsts f ON f.gene = t.gene_id JOIN ranked b ON b.gene = t.gene_id AND b.n = 1""")
def gene_full_aggregates(s: Star) -> DataFrame:
    """Everything that is told of a gene: best, mean and extreme scores, its first five variants by score, the best one's
    own values, and its rank. The five are taken by a limited window, not cut from a list of all."""
    names = s.genes.select(F.col("id").alias("gene"), F.col("name").alias("gene_name"))
    rows = extended(s).join(names, "gene").withColumn("q", -V.rounded("neglog10p", 6))
    genes = rows.groupBy("gene", "gene_name").agg(
        V.rounded(F.max("extended_score"), 6).alias("gene_score"), V.rounded(V.exact_mean("extended_score"), 6).alias("mean_extended_score"),
        V.rounded(F.max("risk_score"), 6).alias("max_risk_score"), V.rounded(V.exact_mean("risk_score"), 6).alias("mean_risk_score"), F.count("risk_score").alias("snp_count"),
        V.rounded(F.max("causal_score"), 6).alias("max_causal"), V.rounded(F.max("evidence_score"), 6).alias("max_evidence"), F.max("clinical_score").alias("max_clinvar"),
        F.max("consequence_score").alias("max_vep"), F.max("beta").alias("max_beta"), F.min("q").alias("min_p_exponent"), F.max("n_valid").alias("max_valid_pips"),
        F.min_by(F.struct("rsid", V.rounded("extended_score", 6).alias("extended_score"), "bp", "beta"), F.struct(-V.rounded("extended_score", 6), "rsid", "bp", "beta", "q")).alias("b"),
    )
    first = rows.groupBy("gene", "rsid").agg(F.min(F.struct(-V.rounded("extended_score", 6), "rsid")).alias("place"))
    first = top(first, ["gene"], [F.col("place")], 5).groupBy("gene").agg(F.array_join(F.transform(F.sort_array(F.collect_list("place")), lambda x: x["rsid"]), ",").alias("snps"))
    out = genes.join(first, "gene").select(F.col("gene").alias("gene_id"), *(c for c in genes.columns if c not in ("gene", "b")), "snps", F.col("b.rsid").alias("best_snp"), F.col("b.extended_score").alias("best_snp_extended"), F.col("b.bp").alias("best_snp_position"), F.col("b.beta").alias("best_snp_beta"))
    return ranked(out, [F.desc("gene_score"), F.asc("gene_id")])


_BEST = "(SELECT gene, round(max(extended_score), 6) AS score, max(least(neglog10p / 10, 1.0)) AS evidence, max(beta) AS beta FROM {0} WHERE disease = '{1}' GROUP BY 1)"


@query(f"SELECT a.gene, round((a.score + r.score) / 2, 7) AS score, (a.evidence + r.evidence) / 2 AS evidence, (a.beta + r.beta) / 2 AS beta, 0.1::DOUBLE AS vep, 0.0::DOUBLE AS clinvar, row_number() OVER (ORDER BY round((a.score + r.score) / 2, 7) DESC, a.gene) AS rank FROM {_BEST.format(EXTENDED, 'A')} a JOIN {_BEST.format(EXTENDED, 'R')} r USING (gene)")
def gene_shared_scores(s: Star) -> DataFrame:
    """Genes of two diseases with the means of both rankings' scores, ranked anew; two components are constants."""
    rows = extended(s)

    def side(disease: str, suffix: str) -> DataFrame:
        best = rows.filter(F.col("disease") == disease).groupBy("gene")
        return best.agg(V.rounded(F.max("extended_score"), 6).alias(f"score_{suffix}"), F.max("evidence_score").alias(f"evidence_{suffix}"), F.max("beta").alias(f"beta_{suffix}"))

    both = side("A", "a").join(side("R", "b"), "gene")
    mean = {c: (F.col(f"{c}_a") + F.col(f"{c}_b")) / 2 for c in ("score", "evidence", "beta")}
    means = [V.rounded(m, 7).alias(c) if c == "score" else m.alias(c) for c, m in mean.items()]
    out = both.select("gene", *means, F.lit(0.1).alias("vep"), F.lit(0.0).alias("clinvar"))
    return ranked(out, [F.desc("score"), F.asc("gene")])


_SIG = f"(SELECT *, best / 40000 AS adjusted FROM {TERMS} WHERE best / 40000 < 0.05)"


def enriched(s: Star) -> DataFrame:
    """Terms beyond the threshold of the adjusted p-value."""
    return terms(s).withColumn("adjusted", F.col("best") / 40000).filter(F.col("adjusted") < 0.05)


@query(f"SELECT lib AS library, count(term) AS n_terms, coalesce(round(-log10(min(adjusted)), 9), 0.0) AS best_p, coalesce(max(len(list_intersect(genes, [1, 2, 3, 4, 5, 6, 7, 8]))), 0) AS n_first, coalesce(max(len(list_intersect(genes, [7, 8, 9, 10, 11, 12]))), 0) AS n_second FROM (SELECT DISTINCT p_type AS lib FROM part) LEFT JOIN {_SIG} ON library = lib GROUP BY 1")
def gene_library_summary(s: Star) -> DataFrame:
    """Significant terms of every library, zeros for those without any."""
    def n(values: list[int]) -> F.Column:
        return F.max(F.size(F.array_intersect("genes", F.array(*(F.lit(v).cast("long") for v in values))))).cast("long")

    found = enriched(s).groupBy("library").agg(F.count("*").alias("n_terms"), F.round(-F.log10(F.min("adjusted")), 9).alias("best_p"), n([1, 2, 3, 4, 5, 6, 7, 8]).alias("n_first"), n([7, 8, 9, 10, 11, 12]).alias("n_second"))
    every = s.table("part").select(F.col("p_type").alias("library")).distinct()
    return every.join(found, "library", "left").fillna(0, ["n_terms", "n_first", "n_second"]).fillna(0.0, ["best_p"])


FAMILIES = {"STANDARD": "pathway", "SMALL": "ontology", "MEDIUM": "disease", "LARGE": "tissue", "ECONOMY": "regulator", "PROMO": "drug"}


@query(f"SELECT family, count(*) AS terms, count(DISTINCT library) AS libraries, round(min(adjusted), 9) AS least FROM {_SIG} JOIN (SELECT unnest({list(FAMILIES)}) AS word, unnest({list(FAMILIES.values())}) AS family) ON word = string_split(library, ' ')[1] GROUP BY 1")
def gene_library_families(s: Star) -> DataFrame:
    """Significant terms by the six families of libraries."""
    family = s.spark.createDataFrame(list(FAMILIES.items()), "word string, family string")
    rows = enriched(s).withColumn("word", F.split("library", " ")[0]).join(F.broadcast(family), "word")  # six rows
    return rows.groupBy("family").agg(F.count("*").alias("terms"), F.count_distinct("library").alias("libraries"), F.round(F.min("adjusted"), 9).alias("least"))


_LOG_CHOOSE = "lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1)"
_TAIL = " + ".join(_LOG_CHOOSE.format(n, k) for n, k in [("term", "i"), ("(universe - term)", "(drawn - i)")]) + " - (" + _LOG_CHOOSE.format("universe", "drawn") + ")"


@query(f"""WITH asked AS (SELECT DISTINCT src AS gene FROM risk WHERE risk_score > 0.9 AND src IN (SELECT p_partkey FROM part)),
sizes AS (SELECT string_split(p_type, ' ')[1] AS library, p_brand AS term_name, count(*) AS term, count(asked.gene) AS hits, (SELECT count(*) FROM asked) AS drawn, (SELECT count(*) FROM part) AS universe
FROM part LEFT JOIN asked ON p_partkey = gene GROUP BY 1, 2),
tails AS (SELECT *, least(1.0, list_sum(list_transform(range(greatest(hits, term + drawn - universe), least(term, drawn) + 1), lambda i: exp({_TAIL})))) AS p FROM sizes),
placed AS (SELECT *, p * count(*) OVER (PARTITION BY library) / row_number() OVER (PARTITION BY library ORDER BY p, term_name) AS raw FROM tails)
SELECT library, term_name, term, CAST(hits AS BIGINT) AS hits, drawn, universe, round(p, 9) AS p,
round(least(1.0, min(raw) OVER (PARTITION BY library ORDER BY p, term_name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS adjusted FROM placed""")
def gene_enrichment_tests(s: Star) -> DataFrame:
    """Over-representation of each term among the genes of high risk: hypergeometric p-values, adjusted in each library."""
    parts = s.table("part").select(F.col("p_partkey").alias("gene"), F.split("p_type", " ")[0].alias("library"), F.col("p_brand").alias("term_name"))
    asked = s.risk.filter("risk_score > 0.9").select(F.col("src").alias("gene"))
    rows = enrichment.enrich(parts, asked, parts.select("gene"))
    return rows.withColumns({"p": F.round("p", 9), "adjusted": F.round("adjusted", 9)})
