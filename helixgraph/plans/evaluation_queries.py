"""Queries that evaluate answers and classifications: text overlap, ranks, calibration, composites, costs and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as X
from ..operators.metrics import class_metrics, expected_calibration_error, summary
from ..sources.star import Star
from .graph_queries import query

WORDS = "list_filter(string_split(trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: w <> '')"
LISTS = f"(SELECT *, list_distinct(p) AS pd, list_distinct(g) AS gd, len(list_intersect(p, g)) AS n FROM (SELECT conv_id, turn, type, {WORDS.format('predicted')} AS p, {WORDS.format('gold')} AS g FROM answers))"


def lists(s: Star) -> DataFrame:
    return s.answers.select("conv_id", "turn", "type", X.words(F.col("predicted")).alias("p"), X.words(F.col("gold")).alias("g"))


@query(f"SELECT conv_id, turn, CASE WHEN len(pd) > 0 THEN n / len(pd) ELSE 0.0 END AS bleu1, CASE WHEN len(gd) > 0 THEN n / len(gd) ELSE 0.0 END AS rouge1, CASE WHEN len(list_distinct(list_concat(p, g))) > 0 THEN n / len(list_distinct(list_concat(p, g))) ELSE 0.0 END AS jaccard, len(p) AS n_words FROM {LISTS}")
def answer_overlap(s: Star) -> DataFrame:
    """Set overlap of each answer with its gold text."""
    p, g = F.col("p"), F.col("g")
    return lists(s).select("conv_id", "turn", X.bleu1_set(p, g).alias("bleu1"), X.rouge1_set(p, g).alias("rouge1"), X.jaccard(p, g).alias("jaccard"), F.size("p").cast("long").alias("n_words"))


@query(f"SELECT type, count(*) AS answers, round(avg(CASE WHEN len(p) > 0 AND len(g) > 0 AND n > 0 THEN 2.0 * n / (len(p) + len(g)) ELSE 0 END), 9) AS token_f1 FROM {LISTS} GROUP BY 1")
def answer_token_f1(s: Star) -> DataFrame:
    """Mean token F1 by type (shared distinct words over list lengths)."""
    return lists(s).groupBy("type").agg(F.count("*").alias("answers"), F.round(F.avg(X.token_f1(F.col("p"), F.col("g"))), 9).alias("token_f1"))


RANKED = f"(SELECT type, p AS pl, list_min(list_filter(list_transform(p, lambda x, i: CASE WHEN list_contains(g, x) THEN i END), lambda i: i IS NOT NULL)) AS place FROM (SELECT type, {WORDS.format('predicted')} AS p, {WORDS.format('gold')} AS g FROM answers))"
METRICS = "count(*) AS total, count(CASE WHEN len(pl) > 0 THEN 1 END) AS answered, count(CASE WHEN place = 1 THEN 1 END) AS hit1, count(CASE WHEN place <= 5 THEN 1 END) AS hit5, count(CASE WHEN place <= 10 THEN 1 END) AS hit10, round(sum(coalesce(1.0 / place, 0)) / nullif(count(CASE WHEN len(pl) > 0 THEN 1 END), 0), 9) AS mrr"


def ranked(s: Star) -> DataFrame:
    rows = lists(s).select("type", F.col("p").alias("pl"), F.col("g").alias("gl"))
    return rows.withColumn("place", X.best_rank(F.col("pl"), F.col("gl")))


def rank_metrics() -> list[Column]:
    answered = F.count_if(F.size("pl") > 0)
    return [
        F.count("*").alias("total"),
        answered.alias("answered"),
        F.count_if(F.col("place") == 1).alias("hit1"),
        F.count_if(F.col("place") <= 5).alias("hit5"),
        F.count_if(F.col("place") <= 10).alias("hit10"),
        F.round(F.try_divide(F.sum(F.coalesce(1.0 / F.col("place"), F.lit(0.0))), answered), 9).alias("mrr"),
    ]


@query(f"SELECT type, {METRICS} FROM {RANKED} GROUP BY 1")
def answer_rank_metrics(s: Star) -> DataFrame:
    """Hits at k and mean reciprocal rank by type, over the answered questions."""
    return ranked(s).groupBy("type").agg(*rank_metrics())


@query(f"SELECT coalesce(type, 'all') AS type, {METRICS} FROM {RANKED} GROUP BY GROUPING SETS ((), (type))")
def answer_rank_rollup(s: Star) -> DataFrame:
    """The same, overall and by type, in one pass."""
    return ranked(s).rollup("type").agg(*rank_metrics()).withColumn("type", F.coalesce("type", F.lit("all")))


@query(f"SELECT type, count(*) AS n, round(avg(x), 9) AS mean, round(stddev_samp(x), 9) AS std, round(greatest(0, avg(x) - 1.96 * stddev_samp(x) / sqrt(count(*))), 9) AS ci_low, round(least(1, avg(x) + 1.96 * stddev_samp(x) / sqrt(count(*))), 9) AS ci_high FROM (SELECT type, CASE WHEN len(gd) > 0 THEN n / len(gd) ELSE 0.0 END AS x FROM {LISTS}) GROUP BY 1")
def answer_summary(s: Star) -> DataFrame:
    """Mean, deviation and confidence interval of the recall of words, by type."""
    rows = lists(s).select("type", X.rouge1_set(F.col("p"), F.col("g")).alias("x"))
    return summary(rows, ["type"], "x")


@query("SELECT conv_id, turn, CASE WHEN predicted IS NULL THEN 'no_results' WHEN contains(lower(trim(predicted)), lower(trim(gold))) OR contains(lower(trim(gold)), lower(trim(predicted))) THEN 'success' WHEN substr(lower(trim(predicted)), 1, 1) = substr(lower(trim(gold)), 1, 1) THEN 'wrong_entity' ELSE 'wrong_answer' END AS outcome FROM answers")
def answer_error_types(s: Star) -> DataFrame:
    """The outcome of each answer."""
    p, g = X.normalise_case(F.col("predicted")), X.normalise_case(F.col("gold"))
    outcome = F.when(F.col("predicted").isNull(), "no_results").when(X.either_contains(F.col("predicted"), F.col("gold")), "success").when(F.substring(p, 1, 1) == F.substring(g, 1, 1), "wrong_entity").otherwise("wrong_answer")
    return s.answers.select("conv_id", "turn", outcome.alias("outcome"))


PARSED = """SELECT doc_id, CASE WHEN contains(h, 'A') THEN 'A' WHEN contains(h, 'B') THEN 'B' WHEN contains(h, 'C') THEN 'C' WHEN contains(h, 'D') THEN 'D' ELSE 'A' END AS choice, CASE WHEN contains(lower(text), 'yes') THEN 'yes' WHEN contains(lower(text), 'no') THEN 'no' ELSE 'maybe' END AS yes_no, len(string_split(trim(text), chr(10))) AS n_lines FROM (SELECT doc_id, text, upper(substr(trim(text), 1, 20)) AS h FROM documents)"""


@query(PARSED)
def answer_parsed(s: Star) -> DataFrame:
    """Choices and yes/no answers read from responses."""
    c = F.col("text")
    return s.table("documents").select("doc_id", X.parse_choice_prefix(c).alias("choice"), X.parse_yes_no(c).alias("yes_no"), F.size(F.split(F.trim(c), "\n")).cast("long").alias("n_lines"))


@query("""SELECT doc_id, len(x) AS n_items, list_min(x) AS first_item FROM (SELECT doc_id, list_filter(list_transform(CASE WHEN contains(text, ',') THEN string_split(text, ',') WHEN contains(text, chr(10)) THEN string_split(text, chr(10)) WHEN contains(text, ';') THEN string_split(text, ';') WHEN contains(text, ' and ') THEN string_split(text, ' and ') ELSE [text] END, lambda v: trim(regexp_replace(trim(v), '^[0-9.\\-) ]+', ''))), lambda v: v <> '') AS x FROM documents)""")
def answer_lists(s: Star) -> DataFrame:
    """Answer lists split at the first delimiter that is present."""
    rows = s.table("documents").select("doc_id", X.parse_list(F.col("text")).alias("x"))
    return rows.select("doc_id", F.size("x").cast("long").alias("n_items"), F.array_min("x").alias("first_item"))


_HOLDS = "regexp_matches(lower(text), '{0}')"
_TIERS = " ".join(f"WHEN {_HOLDS.format('|'.join(phrases))} THEN {value}" for value, phrases in X.CONFIDENT)
_STATED = "regexp_extract(lower(text), 'confidence[:\\s]+([0-9]+(?:\\.[0-9]+)?)', 1)"


@query(f"SELECT doc_id, text = '' OR {_HOLDS.format('|'.join(X.ABSTENTIONS).replace(chr(39), chr(39) * 2))} AS abstains, CASE WHEN text = '' THEN 0.5 WHEN {_STATED} <> '' THEN least(CASE WHEN CAST({_STATED} AS DOUBLE) > 1 THEN CAST({_STATED} AS DOUBLE) / 100 ELSE CAST({_STATED} AS DOUBLE) END, 1.0) {_TIERS} ELSE 0.75 END::DOUBLE AS confidence FROM documents")
def answer_confidence(s: Star) -> DataFrame:
    """Abstention and stated confidence of responses."""
    c = F.col("text")
    return s.table("documents").select("doc_id", X.abstains(c).alias("abstains"), X.confidence(c).alias("confidence"))


QUESTIONS = "(SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'Which diseases are associated with protein ' || s_name || '?' WHEN 1 THEN 'Proteins P' || s_suppkey || ' and P1 both interact with what?' WHEN 2 THEN 'What pathway is gene G' || s_suppkey || ' via its protein annotated in?' ELSE 'In which tissue is ' || s_name || ' expressed?' END AS question, 'MATCH (p:Protein {id: ' || s_suppkey || '})' || CASE s_suppkey % 3 WHEN 0 THEN '-[:ASSOCIATED_WITH]->(d)' WHEN 1 THEN '-[:A]->(x)-[:B]->(y)' ELSE '-[:A]->(x' END || ' RETURN p' AS pattern FROM supplier)"


def questions(s: Star) -> DataFrame:
    """Questions and graph queries from templates, one for each protein."""
    k, name = F.col("s_suppkey"), F.col("s_name")
    text = (
        F.when(k % 4 == 0, F.concat(F.lit("Which diseases are associated with protein "), name, F.lit("?")))
        .when(k % 4 == 1, F.concat(F.lit("Proteins P"), k, F.lit(" and P1 both interact with what?")))
        .when(k % 4 == 2, F.concat(F.lit("What pathway is gene G"), k, F.lit(" via its protein annotated in?")))
        .otherwise(F.concat(F.lit("In which tissue is "), name, F.lit(" expressed?")))
    )
    tail = F.when(k % 3 == 0, "-[:ASSOCIATED_WITH]->(d)").when(k % 3 == 1, "-[:A]->(x)-[:B]->(y)").otherwise("-[:A]->(x")
    return s.table("supplier").select(k.alias("id"), text.alias("question"), F.concat(F.lit("MATCH (p:Protein {id: "), k, F.lit("})"), tail, F.lit(" RETURN p")).alias("pattern"))


@query(f"SELECT id, (length(pattern) - length(replace(pattern, '(', ''))) = (length(pattern) - length(replace(pattern, ')', ''))) AS balanced, len(regexp_extract_all(pattern, '-\\[.*?\\]-')) AS hops FROM {QUESTIONS}")
def question_pattern_checks(s: Star) -> DataFrame:
    """Syntax and hop counts of graph queries."""
    p = F.col("pattern")
    return questions(s).select("id", X.query_is_balanced(p).alias("balanced"), X.hops(p).cast("long").alias("hops"))


@query(f"SELECT array_to_string(list_slice(string_split(question, ' '), 1, 3), ' ') AS opening, count(*) AS n FROM {QUESTIONS} GROUP BY 1")
def question_openings(s: Star) -> DataFrame:
    """Questions by their first three words."""
    return questions(s).groupBy(F.array_join(F.slice(F.split("question", " "), 1, 3), " ").alias("opening")).agg(F.count("*").alias("n"))


@query(f"SELECT keyword, count(*) AS n FROM (SELECT unnest(list_filter(['disease', 'pathway', 'gene', 'protein', 'tissue'], lambda k: contains(lower(question), k))) AS keyword FROM {QUESTIONS}) GROUP BY 1")
def question_keywords(s: Star) -> DataFrame:
    """Questions by keyword; one may hold several."""
    keys = F.array(*(F.lit(k) for k in ("disease", "pathway", "gene", "protein", "tissue")))
    return questions(s).select(F.explode(F.filter(keys, lambda k: F.lower("question").contains(k))).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n"))


@query(f"SELECT type, count(*) AS total, count(CASE WHEN known THEN 1 END) AS found, round(100.0 * count(CASE WHEN known THEN 1 END) / count(*), 2) AS pct FROM (SELECT id % 4 AS type, EXISTS (SELECT 1 FROM associated a WHERE a.src = q.id AND a.score > 0.4) AS known FROM {QUESTIONS} q) GROUP BY 1")
def question_coverage(s: Star) -> DataFrame:
    """How many questions have an answer in the graph, by type."""
    known = s.graph.edges["ASSOCIATED_WITH"].table.filter("score > 0.4").select(F.col("src").alias("k")).distinct()
    rows = questions(s).join(known, F.col("id") == F.col("k"), "left")
    found = F.count_if(F.col("k").isNotNull())
    return rows.groupBy((F.col("id") % 4).alias("type")).agg(F.count("*").alias("total"), found.alias("found"), F.round(found * 100.0 / F.count("*"), 2).alias("pct"))


@query("SELECT source, lang, count(*) AS n, round(avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM labelled GROUP BY 1, 2")
def label_accuracy(s: Star) -> DataFrame:
    """Accuracy by stratum."""
    return s.labelled.groupBy("source", "lang").agg(F.count("*").alias("n"), F.round(F.avg((F.col("truth") == F.col("predicted")).cast("double")), 9).alias("accuracy"))


COUNTS = "(SELECT lang, label, count(CASE WHEN truth = label AND predicted = label THEN 1 END) AS tp, count(CASE WHEN truth <> label AND predicted = label THEN 1 END) AS fp, count(CASE WHEN truth = label AND predicted <> label THEN 1 END) AS fn FROM labelled CROSS JOIN (SELECT unnest([0, 1]) AS label) GROUP BY 1, 2 HAVING tp + fp + fn > 0)"
PRF = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f"


@query(f"SELECT lang, round(avg(p), 9) AS precision_macro, round(avg(r), 9) AS recall_macro, round(avg(f), 9) AS f1_macro, round(sum(f * support) / sum(support), 9) AS f1_weighted, round(CAST(sum(tp) AS DOUBLE) / (sum(tp) + sum(fp)), 9) AS f1_micro FROM (SELECT lang, tp, fp, tp + fn AS support, {PRF} FROM {COUNTS}) GROUP BY 1")
def label_class_metrics(s: Star) -> DataFrame:
    """Macro, weighted and micro precision, recall and F1 by language."""
    return class_metrics(s.labelled, ["lang"], "truth", "predicted")


@query("SELECT round(sum(abs(hits - conf)) / sum(n), 9) AS ece, max(bins) AS bins FROM (SELECT bin, count(*) AS n, sum(CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END) AS hits, sum(c) AS conf, count(*) OVER () AS bins FROM (SELECT truth, predicted, (n_chars % 101) / 100 AS c, least((n_chars % 101) // 10, 9) AS bin FROM labelled) GROUP BY 1)")
def label_calibration(s: Star) -> DataFrame:
    """Expected calibration error over ten bins; the last bin holds 1.0 too."""
    rows = s.labelled.select((F.col("truth") == F.col("predicted")).alias("correct"), (F.col("n_chars") % 101).alias("percent"))
    return expected_calibration_error(rows, "correct", "percent")


@query("SELECT source, coalesce(round(avg(CASE WHEN lang = 'en' THEN ok END), 2), 0) AS c, coalesce(round(avg(CASE WHEN lang = 'de' THEN ok END), 2), 0) AS m, coalesce(round(avg(CASE WHEN lang = 'fr' THEN ok END), 2), 0) AS r, coalesce(round(avg(CASE WHEN lang = 'es' THEN ok END), 2), 0) AS s FROM (SELECT source, lang, CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END AS ok FROM labelled) GROUP BY 1")
def label_taxonomy_pivot(s: Star) -> DataFrame:
    """Scores of four categories side by side; a missing one is 0."""
    ok = F.round(F.avg((F.col("truth") == F.col("predicted")).cast("double")), 2)
    wide = s.labelled.groupBy("source").pivot("lang", ["en", "de", "fr", "es"]).agg(ok).fillna(0.0)
    return wide.withColumnsRenamed({"en": "c", "de": "m", "fr": "r", "es": "s"})


@query("SELECT source, round((0.25 * s + 0.30 * c + 0.25 * r + 0.20 * m) * sqrt(exp(-6.9 * hr) * 0.9), 9) AS composite FROM (SELECT source, coalesce(avg(CASE WHEN lang = 'es' THEN ok END), 0) AS s, coalesce(avg(CASE WHEN lang = 'en' THEN ok END), 0) AS c, coalesce(avg(CASE WHEN lang = 'fr' THEN ok END), 0) AS r, coalesce(avg(CASE WHEN lang = 'de' THEN ok END), 0) AS m, avg(CASE WHEN ok <= 0.2 AND n_chars % 100 > 70 THEN 1.0 ELSE 0.0 END) AS hr FROM (SELECT source, lang, n_chars, CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END AS ok FROM labelled) GROUP BY 1)")
def label_composite(s: Star) -> DataFrame:
    """The weighted composite of four categories with a penalty for confident errors."""
    ok = (F.col("truth") == F.col("predicted")).cast("double")
    category = {"S": "es", "C": "en", "R": "fr", "M": "de"}
    parts = [F.coalesce(F.avg(F.when(F.col("lang") == lang, ok)), F.lit(0.0)).alias(k) for k, lang in category.items()]
    wrong = F.avg(F.when((ok <= 0.2) & (F.col("n_chars") % 100 > 70), 1.0).otherwise(0.0)).alias("hr")
    base = sum((F.col(k) * w for k, w in K.CATEGORY_WEIGHTS.items()), F.lit(0.0))
    rows = s.labelled.groupBy("source").agg(*parts, wrong)
    return rows.select("source", F.round(base * F.sqrt(F.exp(-K.HALLUCINATION_RATE * F.col("hr")) * (1 - K.ASSUMED_ECE)), 9).alias("composite"))


@query("SELECT CASE WHEN n % 10 < 3 THEN 'small' ELSE 'large' END AS class, round(avg(accuracy), 9) AS mean, round(stddev_samp(accuracy), 9) AS std, round(quantile_cont(accuracy, 0.25), 9) AS q1, round(quantile_cont(accuracy, 0.5), 9) AS median, round(quantile_cont(accuracy, 0.75), 9) AS q3 FROM (SELECT source, count(*) AS n, avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END) AS accuracy FROM labelled GROUP BY 1) GROUP BY 1")
def label_quartiles(s: Star) -> DataFrame:
    """Mean, deviation and quartiles of the sources' accuracies, by a derived class."""
    per = s.labelled.groupBy("source").agg(F.count("*").alias("n"), F.avg((F.col("truth") == F.col("predicted")).cast("double")).alias("accuracy"))
    q = F.percentile("accuracy", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    rows = per.groupBy(F.when(F.col("n") % 10 < 3, "small").otherwise("large").alias("class")).agg(F.avg("accuracy").alias("mean"), F.stddev_samp("accuracy").alias("std"), q.alias("q"))
    return rows.select("class", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), *(F.round(F.col("q")[i], 9).alias(k) for i, k in enumerate(("q1", "median", "q3"))))


@query("SELECT CAST(truth AS VARCHAR) AS truth, lang, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most FROM labelled GROUP BY 1, 2 UNION ALL SELECT 'all', lang, count(*), min(n_chars), max(n_chars) FROM labelled GROUP BY 2")
def label_summary(s: Star) -> DataFrame:
    """Label distributions, and totals beside them."""
    numbers = [F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most")]
    by = s.labelled.groupBy(F.col("truth").cast("string").alias("truth"), "lang").agg(*numbers)
    return by.unionByName(s.labelled.groupBy("lang").agg(*numbers).withColumn("truth", F.lit("all")))


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '-42'), doc_id) AS n FROM labelled) WHERE n <= 20")
def label_stratified_sample(s: Star) -> DataFrame:
    """Twenty rows of each stratum in a random, repeatable order."""
    order = Window.partitionBy("lang").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("-42"))), "doc_id")
    return s.labelled.select("lang", "doc_id", F.row_number().over(order).alias("n")).filter("n <= 20").drop("n")


@query("SELECT lang, doc_id, CASE WHEN n <= greatest(1, CAST(floor(0.15 * total) AS BIGINT)) THEN 'dev' ELSE 'test' END AS split FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '-42'), doc_id) AS n, count(*) OVER (PARTITION BY lang) AS total FROM labelled)")
def label_split(s: Star) -> DataFrame:
    """A stratified split: 15 % of each stratum, one row at least."""
    by = Window.partitionBy("lang")
    order = by.orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("-42"))), "doc_id")
    rows = s.labelled.select("lang", "doc_id", F.row_number().over(order).alias("n"), F.count("*").over(by).alias("total"))
    return rows.select("lang", "doc_id", F.when(F.col("n") <= F.greatest(F.lit(1), F.floor(F.col("total") * 0.15)), "dev").otherwise("test").alias("split"))


PRICES = "(SELECT * FROM (VALUES ('click', 2.0, 8.0), ('view', 0.5, 1.5)) AS t(model, price_in, price_out))"


def costed(s: Star) -> DataFrame:
    """Calls with the prices of their model; models without a price cost nothing."""
    prices = s.spark.createDataFrame([("click", 2.0, 8.0), ("view", 0.5, 1.5)], "model string, price_in double, price_out double")
    rows = s.calls.join(F.broadcast(prices), "model", "left").fillna(0.0, ["price_in", "price_out"])
    return rows.withColumn("cost", (F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1_000_000)


@query(f"SELECT model, count(*) AS calls, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, round((sum(tokens_in) * max(coalesce(price_in, 0)) + sum(tokens_out) * max(coalesce(price_out, 0))) / 1000000, 9) AS cost FROM calls LEFT JOIN {PRICES} USING (model) GROUP BY 1")
def call_costs(s: Star) -> DataFrame:
    """Tokens and cost by model."""
    return costed(s).groupBy("model").agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum("cost"), 9).alias("cost"))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, model, count(*) AS calls, CAST(sum(tokens_in) AS BIGINT) AS tokens, count(DISTINCT user_id) AS users FROM calls GROUP BY 1, 2")
def call_days(s: Star) -> DataFrame:
    """Calls by day and model."""
    return s.calls.groupBy(F.to_date("ts").cast("string").alias("day"), "model").agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens"), F.count_distinct("user_id").alias("users"))


@query("SELECT provider, count(DISTINCT model) AS models, count(*) AS calls, arg_max(model, (n, model)) AS busiest FROM (SELECT CASE WHEN contains(model, 'c') THEN 'first' WHEN contains(model, 'e') THEN 'second' ELSE 'other' END AS provider, model, count(*) OVER (PARTITION BY model) AS n FROM calls) GROUP BY 1")
def call_providers(s: Star) -> DataFrame:
    """Roll-up by a bucket derived from the model's name, and the busiest model of each."""
    provider = F.when(F.col("model").contains("c"), "first").when(F.col("model").contains("e"), "second").otherwise("other")
    models = s.calls.groupBy("model").agg(F.count("*").alias("n"))
    return models.groupBy(provider.alias("provider")).agg(F.count("*").alias("models"), F.sum("n").alias("calls"), F.max_by("model", F.struct("n", "model")).alias("busiest"))


@query("SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM calls GROUP BY 1, 2")
def call_props(s: Star) -> DataFrame:
    """A field of the calls' JSON properties."""
    return s.calls.groupBy("user_id", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT model, metric, value FROM (SELECT model, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, count(*) AS calls FROM calls GROUP BY 1) UNPIVOT (value FOR metric IN (tokens_in, tokens_out, calls))")
def call_metrics_long(s: Star) -> DataFrame:
    """Metrics as rows."""
    wide = s.calls.groupBy("model").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.count("*").alias("calls"))
    return wide.unpivot(["model"], ["tokens_in", "tokens_out", "calls"], "metric", "value")


@query("SELECT model, total, row_number() OVER (ORDER BY CASE model WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, total DESC, model) AS place FROM (SELECT model, count(*) AS total FROM calls GROUP BY 1)")
def call_custom_order(s: Star) -> DataFrame:
    """Models in an order of their own."""
    counts = s.calls.groupBy("model").agg(F.count("*").alias("total"))
    order = F.when(F.col("model") == "view", 0).when(F.col("model") == "click", 1).otherwise(2)
    return counts.withColumn("place", F.row_number().over(Window.orderBy(order, F.desc("total"), "model")).cast("long"))


def answer_rouge_l(s: Star) -> DataFrame:
    """F1 of the longest common subsequence of each answer's and its gold text's words, all of them."""
    return lists(s).select("conv_id", "turn", X.rouge_l(F.col("p"), F.col("g")).alias("rouge_l"))


@query("SELECT lang, count(*) AS n, count(CASE WHEN contains(source, 'src1') THEN 1 END) AS chosen FROM documents GROUP BY 1")
def label_source_filter(s: Star) -> DataFrame:
    """Rows whose source holds a name; null doesn't."""
    chosen = F.coalesce(F.col("source").contains("src1"), F.lit(False))
    return s.table("documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(chosen).alias("chosen"))


_CELLS = "(SELECT source, lang, avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END) AS a FROM labelled GROUP BY 1, 2)"
_WIDE = "(SELECT source, " + ", ".join(f"round(max(CASE WHEN lang = '{k}' THEN a END), 9) AS {k}" for k in ("en", "de", "fr", "es")) + f" FROM {_CELLS} GROUP BY 1)"


def cells(s: Star) -> DataFrame:
    """Sources by languages, accuracies in the cells."""
    ok = F.round(F.avg((F.col("truth") == F.col("predicted")).cast("double")), 9)
    return s.labelled.groupBy("source").pivot("lang", ["en", "de", "fr", "es"]).agg(ok)


@query(f"SELECT source, metric, value FROM (SELECT *, round((coalesce(en, 0) + coalesce(de, 0) + coalesce(fr, 0) + coalesce(es, 0)) / nullif((en IS NOT NULL)::INT + (de IS NOT NULL)::INT + (fr IS NOT NULL)::INT + (es IS NOT NULL)::INT, 0), 6) AS mean FROM {_WIDE}) UNPIVOT (value FOR metric IN (en, de, fr, es, mean))")
def label_pivot_means(s: Star) -> DataFrame:
    """A pivot with the mean of the cells that each row has, melted again."""
    langs = ["en", "de", "fr", "es"]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in langs[1:]), F.coalesce(langs[0], F.lit(0.0)))
    known = sum((F.col(c).isNotNull().cast("int") for c in langs[1:]), F.col(langs[0]).isNotNull().cast("int"))
    wide = cells(s).withColumn("mean", F.round(F.try_divide(total, known), 6))
    return wide.unpivot(["source"], [*langs, "mean"], "metric", "value").filter("value IS NOT NULL")


@query(f"SELECT strategy, count(*) AS models, " + ", ".join(f"round(avg({k}), 6) AS {k}" for k in ("en", "de", "fr", "es")) + f" FROM (SELECT *, length(source) % 2 AS strategy FROM {_WIDE}) GROUP BY 1")
def label_strategy_means(s: Star) -> DataFrame:
    """Means of the columns of a wide table by strategy; missing cells don't count."""
    means = [F.round(F.avg(c), 6).alias(c) for c in ("en", "de", "fr", "es")]
    return cells(s).groupBy((F.length("source") % 2).cast("long").alias("strategy")).agg(F.count("*").alias("models"), *means)


@query("SELECT source, round(avg(CASE WHEN truth = predicted THEN 0.0 ELSE 1.0 END), 9) AS error_rate, round(100.0 * count(CASE WHEN truth <> predicted AND predicted = 1 THEN 1 END) / count(*), 6) AS false_pct FROM labelled GROUP BY 1")
def label_error_rates(s: Star) -> DataFrame:
    """Error rates by source."""
    wrong = F.col("truth") != F.col("predicted")
    return s.labelled.groupBy("source").agg(F.round(F.avg(wrong.cast("double")), 9).alias("error_rate"), F.round(F.count_if(wrong & (F.col("predicted") == 1)) * 100.0 / F.count("*"), 6).alias("false_pct"))


@query(f"SELECT conv_id % 5 AS model, " + ", ".join(f"round(100.0 * count(CASE WHEN type = '{k}' AND n > 0 THEN 1 END) / nullif(count(CASE WHEN type = '{k}' THEN 1 END), 0), 6) AS {c}" for k, c in (("one-hop", "one_hop"), ("multi-hop", "multi_hop"), ("conjunction", "conjunction"))) + f" FROM {LISTS} GROUP BY 1")
def answer_em_pivot(s: Star) -> DataFrame:
    """Loose exact match by model, question types side by side."""
    wide = lists(s).groupBy((F.col("conv_id") % 5).alias("model")).pivot("type", ["one-hop", "multi-hop", "conjunction"])
    out = wide.agg(F.round(F.avg(F.arrays_overlap("p", "g").cast("double")) * 100, 6))
    return out.withColumnsRenamed({"one-hop": "one_hop", "multi-hop": "multi_hop"})


def _library_sql(n: int) -> str:
    """Clipped n-grams of both sides of each answer: (conv_id, turn, f)."""
    words = "list_filter(string_split_regex(lower(coalesce({0}, '')), '[^a-z0-9]+'), lambda w: w <> '')"
    side = f"SELECT conv_id, turn, array_to_string(ws[i : i + {n - 1}], ' ') AS g, count(*) AS n FROM (SELECT *, unnest(range(1, len(ws) - {n - 2})) AS i FROM (SELECT conv_id, turn, {words} AS ws FROM answers) WHERE len(ws) >= {n}) GROUP BY 1, 2, 3"
    p, g = side.format("predicted"), side.format("gold")
    return f"SELECT conv_id, turn, CASE WHEN sum(least(p, g)) > 0 THEN round(2.0 * sum(least(p, g)) / (sum(p) + sum(g)), 9) ELSE 0.0 END AS f FROM (SELECT conv_id, turn, coalesce(a.n, 0) AS p, coalesce(b.n, 0) AS g FROM ({p}) a FULL JOIN ({g}) b USING (conv_id, turn, g)) GROUP BY 1, 2"


@query(f"SELECT a.conv_id, a.turn, coalesce(x.f, 0.0) AS rouge1, coalesce(y.f, 0.0) AS rouge2 FROM answers a LEFT JOIN ({_library_sql(1)}) x USING (conv_id, turn) LEFT JOIN ({_library_sql(2)}) y USING (conv_id, turn)")
def answer_library_rouge(s: Star) -> DataFrame:
    """ROUGE-1 and ROUGE-2 of each answer by clipped n-grams."""
    rows = s.answers.select("conv_id", "turn", X.library_rouge(X.library_words(F.col("predicted")), X.library_words(F.col("gold"))).alias("r"))
    return rows.select("conv_id", "turn", F.round("r.rouge1", 9).alias("rouge1"), F.round("r.rouge2", 9).alias("rouge2"))


def answer_library_means(s: Star) -> DataFrame:
    """The means of ROUGE-1, ROUGE-2 and ROUGE-L by type of question."""
    rows = s.answers.select("type", X.library_rouge(X.library_words(F.col("predicted")), X.library_words(F.col("gold"))).alias("r"))
    return rows.groupBy("type").agg(*(F.round(F.avg(f"r.{c}"), 9).alias(c) for c in ("rouge1", "rouge2", "rougel")), F.count("*").alias("answers"))
