"""Queries that build and validate question sets, read through caches, and run over streams of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import benchmarks as B
from ..sources import documents, readers, results
from ..sources.session import work_folder
from ..sources.star import Star
from ..streaming import ingest
from .graph_queries import query

TEMPLATES = [("R-RISK", "What is the risk of gene {gene} for disease {disease}?"), ("R-EVIDENCE", "How strong is the evidence that gene {gene} bears on disease {disease}?")]
SAMPLES = "(SELECT CASE WHEN dst % 2 = 0 THEN 'R-RISK' ELSE 'R-EVIDENCE' END AS task_id, src AS gene, dst AS disease FROM (SELECT src, dst, row_number() OVER (PARTITION BY dst ORDER BY md5(src || '-' || dst || '-42'), src, dst) AS n FROM risk WHERE risk_score > 0.3) WHERE n <= 30)"


def samples(s: Star) -> DataFrame:
    pool = B.sample_pool(s.risk.select("src", "dst", "risk_score"), "risk_score", 0.3, ["src", "dst"], 30, ["dst"])
    return pool.select(F.when(F.col("dst") % 2 == 0, "R-RISK").otherwise("R-EVIDENCE").alias("task_id"), F.col("src").alias("gene"), F.col("dst").alias("disease"))


@query(f"SELECT task_id, gene, disease, CASE task_id WHEN 'R-RISK' THEN 'What is the risk of gene ' || gene || ' for disease ' || disease || '?' ELSE 'How strong is the evidence that gene ' || gene || ' bears on disease ' || disease || '?' END AS question FROM {SAMPLES}")
def build_questions(s: Star) -> DataFrame:
    """Questions from templates and sampled pairs beyond a score."""
    return B.generate(s.spark.createDataFrame(TEMPLATES, "task_id string, template string"), samples(s), ["gene", "disease"])


@query(f"SELECT task_id, reason, count(*) AS n FROM (SELECT q.task_id, CASE WHEN count(a.src) = 0 THEN 'no_rows' ELSE 'ok' END AS reason FROM {SAMPLES} q LEFT JOIN (SELECT * FROM risk WHERE evidence_score > 0.5) a ON a.src = q.gene AND a.dst = q.disease GROUP BY q.task_id, q.gene, q.disease) GROUP BY 1, 2")
def build_validation(s: Star) -> DataFrame:
    """Whether each question has an answer in the graph."""
    answers = s.risk.filter("evidence_score > 0.5").select(F.col("src").alias("gene"), F.col("dst").alias("disease"), "evidence_score")
    return B.validate(samples(s), answers, ["gene", "disease"], "evidence_score").groupBy("task_id", "reason").agg(F.count("*").alias("n"))


def question_files(s: Star) -> DataFrame:
    """The sampled questions written as files of two layouts (a list; an object with a list), read back as one."""
    rows = samples(s).withColumn("question", F.format_string("Is gene %s tied to disease \"%s\" {a}?", "gene", "disease"))
    rows = rows.withColumn("parameters", F.create_map(F.lit("gene"), F.col("gene").cast("string"), F.lit("disease"), F.col("disease").cast("string")))
    folder = work_folder(s.spark)
    known = rows.filter("task_id = 'R-RISK'").select("question", "task_id", F.lit("R").alias("taxonomy"), F.lit("risk").alias("type"), F.lit("risk_score").alias("answer_key"), "parameters")
    documents.write_json_lists(known, f"{folder}/knowledge")
    options = F.when(F.col("gene") % 2 == 0, F.array(F.lit("yes"), F.lit("no")))
    reasoned = rows.filter("task_id = 'R-EVIDENCE'").select("question", "task_id", F.lit("evidence").alias("reasoning_type"), options.alias("options"), F.lit("yes").alias("correct_answer"), "parameters")
    documents.write_json_lists(reasoned, f"{folder}/reasoning", "questions")
    return documents.question_records(s.spark, f"{folder}/*")


@query(f"""SELECT task_id, key, count(*) AS n FROM (SELECT task_id, unnest(CASE WHEN task_id = 'R-RISK' THEN ['question', 'task_id', 'taxonomy', 'type', 'answer_key', 'parameters']
WHEN gene % 2 = 0 THEN ['question', 'task_id', 'reasoning_type', 'options', 'correct_answer', 'parameters'] ELSE ['question', 'task_id', 'reasoning_type', 'correct_answer', 'parameters'] END) AS key FROM {SAMPLES}) GROUP BY 1, 2""")
def source_question_keys(s: Star) -> DataFrame:
    """How many questions of each task hold each key, over files whose keys vary by row."""
    rows = question_files(s).withColumn("task_id", F.variant_get("record", "$.task_id", "string"))
    return documents.keys_of(rows, "task_id").groupBy("task_id", "key").agg(F.count("*").alias("n"))


@query(f"""SELECT 'Is gene ' || gene || ' tied to disease "' || disease || '" {{a}}?' AS question, task_id, CASE WHEN task_id = 'R-RISK' THEN 'risk' END AS type, CASE WHEN task_id <> 'R-RISK' THEN 'evidence' END AS reasoning_type,
CASE WHEN task_id <> 'R-RISK' AND gene % 2 = 0 THEN 'yes,no' END AS options, gene AS gene, CAST(disease AS BIGINT) AS disease FROM {SAMPLES}""")
def source_question_records(s: Star) -> DataFrame:
    """Questions of both layouts in one schema, parameters included."""
    rows = documents.typed(question_files(s), readers.QUESTION_SCHEMA)
    number = {name: F.col("parameters")[name].cast("long").alias(name) for name in ("gene", "disease")}
    return rows.select("question", "task_id", "type", "reasoning_type", F.array_join("options", ",").alias("options"), number["gene"], number["disease"])


@query("SELECT count(DISTINCT v.rsid) AS wanted, count(DISTINCT CASE WHEN o.o_orderkey IS NOT NULL THEN v.rsid END) AS hits, count(DISTINCT CASE WHEN o.o_orderkey IS NULL THEN v.rsid END) AS misses FROM variants v LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') o ON v.rsid = 'rs' || o.o_orderkey")
def source_cache(s: Star) -> DataFrame:
    """Hits and misses of an annotation cache."""
    cache = s.table("orders").filter("o_orderstatus = 'F'").select(F.concat(F.lit("rs"), F.col("o_orderkey")).alias("rsid"), "o_orderpriority")
    hits, misses = readers.read_through(s.variants.select("rsid"), cache, "rsid")
    both = hits.select(F.lit(1).alias("hit"), F.lit(0).alias("miss")).unionByName(misses.select(F.lit(0).alias("hit"), F.lit(1).alias("miss")))
    return both.agg(F.count("*").alias("wanted"), F.sum("hit").alias("hits"), F.sum("miss").alias("misses"))


@query("SELECT model, count(*) AS calls, CAST(sum(tokens_in) AS BIGINT) AS tokens FROM calls GROUP BY 1")
def source_results_resumed(s: Star) -> DataFrame:
    """Calls written in two runs, one killed before its manifest and repeated, one repeated though done: each row once."""
    path, rows = work_folder(s.spark), s.calls.select("call_id", "model", "tokens_in")
    first, second = rows.filter("model <= 'click'"), rows.filter("model > 'click' OR model IS NULL")
    results.stage(first, path, "first")
    for run, part in (("first", first), ("second", second), ("second", second)):
        results.write_run(part, path, run)
    return results.read_runs(s.spark, path).groupBy("model").agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens"))


@query("SELECT src, dst, score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS n FROM (SELECT l_suppkey AS src, l_partkey AS dst, count(*) * 100 + 650 AS score FROM lineitem GROUP BY 1, 2) WHERE score >= 700) WHERE n <= 50")
def source_partners(s: Star) -> DataFrame:
    """The fifty best partners of each protein beyond a score."""
    edges = s.table("lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg((F.count("*") * 100 + 650).alias("score"))
    return readers.top_partners(edges, 700, 50)


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS model, count(*) AS calls, CAST(sum(CAST(round(value) AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY 1, 2")
def stream_call_windows(s: Star) -> DataFrame:
    """Daily windows over a stream of call logs."""
    events = ingest.file_stream(s.spark, s.folder, "events", s.table("events").schema)
    windows = ingest.call_windows(events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("model"), F.round("value").cast("long").alias("tokens")))
    return ingest.run_complete(windows, windows.schema)


@query("SELECT rsid, gene, bp, beta FROM (SELECT rsid, gene, bp, beta, row_number() OVER (PARTITION BY rsid ORDER BY neglog10p DESC, bp, gene, beta) AS n FROM variants WHERE p < 5e-8 AND maf BETWEEN 0.001 AND 0.5 AND beta > 0) WHERE n = 1")
def stream_best_variants(s: Star) -> DataFrame:
    """The best significant row of each variant, over a stream of files."""
    schema = s.table("lineitem").schema
    stream = Star(s.spark, s.folder)
    stream.table = lambda name: ingest.file_stream(s.spark, s.folder, name, schema)  # the same view over the stream
    return ingest.best_variants(stream.variants.select("rsid", "gene", "bp", "beta", "p", "maf", "neglog10p")).select("rsid", "gene", "bp", "beta")
