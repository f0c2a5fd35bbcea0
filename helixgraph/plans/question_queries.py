"""From questions to answers: questions are parsed by columns, dispatched to a graph pattern each, and answered as joins.

The questions are made of the graph's own entities, so that the SQL can tell from how a question was made what must be read
from it and what must answer it, without parsing it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import questions as P
from ..functions import text as X
from ..operators.pattern import reached_numbers
from ..sources.session import ranked, written
from ..sources.star import Star
from .evaluation_queries import LISTS, WORDS, lists
from .graph_queries import query, top
from .registry import register

#: What a template asks of a protein: the relation that must be read, the edge type that answers it, and its view in SQL.
ASKED = (
    ("Which proteins are interacting with {}?", "protein_interaction", "INTERACTS_WITH", "interacts"),
    ("What diseases are linked to {}?", "protein_disease", "ASSOCIATED_WITH", "associated"),
    ("Which pathways list {}?", "protein_pathway", "ANNOTATED_IN_PATHWAY", "in_pathway"),
    ("Name a biological process of {}.", "protein_biological_process", "HAS_PROCESS", "has_process"),
    ("Name a molecular function of {}.", "protein_molecular_function", "HAS_FUNCTION", "has_function"),
    ("Where is {} localized?", "protein_cellular_component", "IN_COMPONENT", "in_component"),
    ("In which tissue is {} found?", "protein_tissue", "EXPRESSED_IN", "expressed_in"),
    ("What is known of {}?", "unknown", None, None),
)
#: What a template asks of a gene's proteins, and the words that decide it, the first counts; the default is a function.
ASKED_OF_GENES = (
    ("function that the protein of gene {} has", ("molecular function", "function"), "HAS_FUNCTION", "has_function"),
    ("biological process of the protein from gene {}", ("process",), "HAS_PROCESS", "has_process"),
    ("cellular component of the protein from gene {}", ("cellular component", "locali"), "IN_COMPONENT", "in_component"),
    ("disease that is linked to the protein from gene {}", ("disease",), "ASSOCIATED_WITH", "associated"),
    ("pathway of the protein from gene {}", ("pathway",), "ANNOTATED_IN_PATHWAY", "in_pathway"),
    ("organ, that is which tissue, of the protein from gene {}", ("tissue",), "EXPRESSED_IN", "expressed_in"),
    ("protein translated from gene {}", (), "HAS_FUNCTION", "has_function"),
)
BY_RELATION = {relation: kind for _, relation, kind, _ in ASKED if kind}
#: Answers of a multi-hop question, and of one that no template answers.
MOST_ANSWERS, MOST_EXPANDED = 50, 100


def accession(key: Column) -> Column:
    """A protein's accession, with an isoform number where five digits don't suffice."""
    digits = F.lpad((key % 100_000).cast("string"), 5, "0")
    return F.concat(F.lit("P"), digits, F.when(key >= 100_000, F.concat(F.lit("-"), F.floor(key / 100_000))).otherwise(""))


def chosen(key: Column, templates: list[str], *entities: Column) -> Column:
    """The template by the key, with the entities in its places."""
    out = F.lit(None)
    for i, template in enumerate(templates):
        parts = template.split("{}")
        text = F.concat(*[c for j, part in enumerate(parts) for c in ((F.lit(part), entities[j]) if j < len(parts) - 1 else (F.lit(part),))])
        out = F.when(key % len(templates) == i, text).otherwise(out)
    return out


def questions(s: Star) -> DataFrame:
    """(id, question): one-hop questions of proteins, conjunctions of a protein and the next, and questions of genes."""
    key = F.col("s_suppkey")
    proteins = s.table("supplier").select(key)
    one = proteins.select(F.concat(F.lit("p"), key).alias("id"), chosen(key, [a[0] for a in ASKED], accession(key)).alias("question"))
    pairs = proteins.join(proteins.select((key - 1).alias("before")), key == F.col("before"), "left_semi")
    both = [a[0].replace("{}", "both {} and {}") for a in ASKED if a[2]]
    two = pairs.select(F.concat(F.lit("c"), key).alias("id"), chosen(key, both, accession(key), accession(key + 1)).alias("question"))
    gene = F.col("p_partkey")
    genes = s.table("part").select(F.concat(F.lit("g"), gene).alias("id"), chosen(gene, [f"What is the {a[0]}?" for a in ASKED_OF_GENES], F.concat(F.lit("X"), gene)).alias("question"))
    return one.unionByName(two).unionByName(genes)


def parsed(rows: DataFrame) -> DataFrame:
    """Kind, relation, target and entities of (id, question)."""
    q = F.col("question")
    read = rows.withColumns({"kind": P.kind(q), "relation": P.relation(q), "proteins": P.proteins(q), "gene": P.gene(q)})
    return read.withColumn("target", P.target(F.col("relation"), q))


def dispatched(rows: DataFrame) -> DataFrame:
    """Add ``route``, how a question is to be answered, and ``type``, by which edges: both null where no template fits."""
    low, by_words = F.lower("question"), F.lit("HAS_FUNCTION")
    for _, words, kind, _ in reversed(ASKED_OF_GENES):
        for word in words:
            there = low.contains(word) & ~low.contains("biological") if word == "function" else low.contains(word)
            by_words = F.when(there, kind).otherwise(by_words)
    entries = [F.lit(x) for item in BY_RELATION.items() for x in item]
    by_relation = F.try_element_at(F.create_map(*entries), F.col("relation"))
    route = (
        F.when((F.col("kind") == "conjunction") & (F.size("proteins") == 2) & by_relation.isNotNull(), "conjunction")
        .when((F.col("kind") == "multi-hop") & F.col("gene").isNotNull(), "multi-hop")
        .when((F.size("proteins") > 0) & by_relation.isNotNull(), "one-hop")
    )
    return rows.withColumn("route", route).withColumn("type", F.when(F.col("route") == "multi-hop", by_words).when(F.col("route").isNotNull(), by_relation))


def protein_edges(s: Star) -> DataFrame:
    """(type, protein, answer, score) of what can answer a question; a missing score counts one half."""
    names = s.graph.nodes["Protein"].select(F.col("id").alias("src"), accession(F.col("id")).alias("protein"))
    parts = []
    for kind in BY_RELATION.values():
        table = s.graph.edges[kind].table
        score = F.coalesce("score", F.lit(0.5)) if "score" in table.columns else F.lit(0.5)
        parts.append(table.select(F.lit(kind).alias("type"), "src", F.col("dst").cast("string").alias("answer"), score.alias("score")))
    return reduce(DataFrame.unionByName, parts).join(names, "src").drop("src")


def scored(asked: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, answer, score) of what the proteins of (id, type, protein) are tied to by ``edges``, each once: paths aren't rows."""
    kinds = edges.select("type", "answer", "score").distinct()
    kinds = written(ranked(kinds, [F.col("type"), F.desc("score"), F.col("answer")], "number"))
    k = kinds.withColumnsRenamed({"type": "_type", "answer": "_answer", "score": "_score"})
    numbers = edges.join(k, (F.col("type") == F.col("_type")) & F.col("answer").eqNullSafe(F.col("_answer")) & (F.col("score") == F.col("_score"))).select("type", "protein", "number")
    return reached_numbers(asked, numbers, "id", ["type", "protein"]).join(kinds, "number").select("id", "answer", "score")


def answered(s: Star, rows: DataFrame) -> DataFrame:
    """(id, route, answer): all questions of a route are answered in one join; those without an answer are expanded."""
    # written once, as each route reads them again, and so that no route parses them anew
    edges, asked = written(protein_edges(s)), written(dispatched(written(parsed(rows))))
    one = asked.filter("route = 'one-hop'").select("id", "type", F.element_at("proteins", 1).alias("protein")).join(edges, ["type", "protein"]).select("id", "answer").distinct()
    two = asked.filter("route = 'conjunction'").select("id", "type", F.explode("proteins").alias("protein")).join(edges, ["type", "protein"])
    two = two.groupBy("id", "answer").agg(F.count_distinct("protein").alias("n")).filter("n = 2").select("id", "answer")
    translated = s.graph.edges["TRANSLATED_INTO"].table.select(F.concat(F.lit("X"), "src").alias("gene"), accession(F.col("dst")).alias("protein"))
    more = scored(asked.filter("route = 'multi-hop'").select("id", "type", "gene").join(translated, "gene"), edges)
    more = top(more.groupBy("id", "answer").agg(F.max("score").alias("score")), ["id"], [F.desc("score"), F.col("answer")], MOST_ANSWERS).select("id", "answer")
    ruled = written(reduce(DataFrame.unionByName, (t.withColumn("route", F.lit(r)) for t, r in ((one, "one-hop"), (two, "conjunction"), (more, "multi-hop")))))
    rest = asked.filter(F.size("proteins") > 0).join(ruled, "id", "left_anti").select("id", F.element_at("proteins", 1).alias("protein"))
    expanded = top(rest.join(edges, "protein").select("id", "type", "answer").distinct(), ["id"], [F.col("type"), F.col("answer")], MOST_EXPANDED)
    return ruled.select("id", "route", "answer").unionByName(expanded.select("id", F.lit("fallback").alias("route"), "answer"))


def _case(key: str, values: list[str]) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_NAME = "('P' || lpad(CAST({0} % 100000 AS VARCHAR), 5, '0') || CASE WHEN {0} >= 100000 THEN '-' || ({0} // 100000) ELSE '' END)"
_PAIRED = [a for a in ASKED if a[2]]
_PARSED = f"""SELECT 'p' || s_suppkey AS id, 'one-hop' AS kind, {_case('s_suppkey', [f"'{a[1]}'" for a in ASKED])} AS relation, {_NAME.format('s_suppkey')} AS entities FROM supplier
UNION ALL SELECT 'c' || a.s_suppkey, 'conjunction', {_case('a.s_suppkey', [f"'{a[1]}'" for a in _PAIRED])}, {_NAME.format('a.s_suppkey')} || ',' || {_NAME.format('b.s_suppkey')} FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1
UNION ALL SELECT 'g' || p_partkey, 'multi-hop', {_case('p_partkey', ["'gene_molecular_function'", "'protein_biological_process'", "'protein_cellular_component'", "'protein_disease'", "'protein_pathway'", "'protein_tissue'", "'gene_protein'"])}, 'X' || p_partkey FROM part"""


@query(_PARSED)
def question_parse(s: Star) -> DataFrame:
    """Kind, relation and entities, as they were put into the questions."""
    named = F.when(F.col("gene").isNotNull(), F.col("gene")).otherwise(F.array_join("proteins", ","))
    return parsed(questions(s)).select("id", "kind", "relation", named.alias("entities"))


_EDGES = " UNION ALL ".join(f"SELECT '{a[2]}' AS type, src, CAST(dst AS VARCHAR) AS answer, {'coalesce(score, 0.5)' if a[3] == 'associated' else '0.5'} AS score FROM {a[3]}" for a in _PAIRED)
_ANSWERS = f"""WITH edges AS ({_EDGES}), ruled AS (
SELECT DISTINCT 'p' || src AS id, 'one-hop' AS route, answer FROM edges WHERE type = {_case('src', [f"'{a[2]}'" if a[2] else 'NULL' for a in ASKED])}
UNION ALL SELECT DISTINCT 'c' || a.src, 'conjunction', a.answer FROM edges a JOIN edges b ON b.src = a.src + 1 AND b.type = a.type AND b.answer = a.answer WHERE a.type = {_case('a.src', [f"'{a[2]}'" for a in _PAIRED])}
UNION ALL SELECT id, route, answer FROM (SELECT 'g' || t.src AS id, 'multi-hop' AS route, e.answer, row_number() OVER (PARTITION BY t.src ORDER BY max(e.score) DESC, e.answer) AS n FROM translated t JOIN edges e ON e.src = t.dst WHERE e.type = {_case('t.src', [f"'{a[2]}'" for a in ASKED_OF_GENES])} GROUP BY t.src, e.answer) WHERE n <= {MOST_ANSWERS}),
asked AS (SELECT 'p' || s_suppkey AS id, s_suppkey AS src FROM supplier UNION ALL SELECT 'c' || a.s_suppkey, a.s_suppkey FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1)
SELECT id, route, answer FROM ruled UNION ALL SELECT id, 'fallback', answer FROM (SELECT q.id, e.answer, row_number() OVER (PARTITION BY q.id ORDER BY e.type, e.answer) AS n FROM asked q JOIN (SELECT DISTINCT type, src, answer FROM edges) e ON e.src = q.src WHERE q.id NOT IN (SELECT id FROM ruled)) WHERE n <= {MOST_EXPANDED}"""


@query(_ANSWERS)
def question_dispatch(s: Star) -> DataFrame:
    """Answers of all questions by their routes; those that no template answers are expanded."""
    return answered(s, questions(s))


@query(f"WITH answered AS ({_ANSWERS}), asked AS ({_PARSED}) SELECT coalesce(kind, 'all') AS kind, count(*) AS questions, count(n) AS answered, CAST(sum(coalesce(n, 0)) AS BIGINT) AS answers, count(CASE WHEN route = 'fallback' THEN 1 END) AS expanded FROM asked LEFT JOIN (SELECT id, count(*) AS n, min(route) AS route FROM answered GROUP BY 1) USING (id) GROUP BY ROLLUP (kind)")
def question_dispatch_rollup(s: Star) -> DataFrame:
    """Questions by kind: how many are answered, by a template or by expansion."""
    found = answered(s, questions(s)).groupBy("id").agg(F.count("*").alias("n"), F.min("route").alias("route"))
    rows = parsed(questions(s)).select("id", "kind").join(found, "id", "left")
    counts = [F.count("*").alias("questions"), F.count("n").alias("answered"), F.sum(F.coalesce("n", F.lit(0))).alias("answers"), F.count_if(F.col("route") == "fallback").alias("expanded")]
    return rows.rollup("kind").agg(*counts).withColumn("kind", F.coalesce("kind", F.lit("all")))


@query("SELECT conv_id, turn, CASE WHEN text = '' THEN 'unknown' WHEN contains(lower(text), 'how many') OR contains(lower(text), 'count') OR contains(lower(text), 'number of') THEN 'count' WHEN regexp_matches(lower(text), '^(is|are|does|do|can|has|have) ') THEN 'boolean' WHEN contains(lower(text), 'list') OR contains(lower(text), 'all the') OR contains(lower(text), 'name all') THEN 'list' ELSE 'entity' END AS class FROM conversations WHERE role = 'user'")
def question_answer_class(s: Star) -> DataFrame:
    """What kind of answer the users' turns ask for."""
    return s.table("conversations").filter("role = 'user'").select("conv_id", "turn", P.answer_class(F.col("text")).alias("class"))


#: Letters beyond ASCII count as parts of words, which DuckDB's word boundaries leave out.
_PLAIN = r"regexp_replace(regexp_replace(text, '[^\p{L}\p{N}_:\-]', ' ', 'g'), '[^\x00-\x7F]', '_', 'g')"
_NO_GENES = "['" + "', '".join(P.NO_GENES) + "']"


@query(rf"SELECT doc_id, len(list_filter(regexp_extract_all(t, '\b[A-Z]{{2,6}}[0-9]*\b'), lambda x: NOT list_contains({_NO_GENES}, x))) AS genes, len(regexp_extract_all(t, 'GO:[0-9]{{7}}')) AS go_terms, len(regexp_extract_all(t, '(?i)\brs[0-9]+\b')) AS rsids, len(regexp_extract_all(t, '\b[PQO][0-9][A-Z0-9]{{3}}[0-9](?:-[0-9]+)?\b')) AS proteins FROM (SELECT doc_id, {_PLAIN} AS t FROM documents)")
def question_entities(s: Star) -> DataFrame:
    """Identifiers in texts: gene symbols beyond common words, gene-ontology terms, variants and proteins."""
    c = F.col("text")
    counts = {"genes": P.gene_symbols(c), "go_terms": P.go_terms(c), "rsids": P.rsids(c), "proteins": P.proteins(c)}
    return s.table("documents").select("doc_id", *(F.size(v).cast("long").alias(k) for k, v in counts.items()))


@query(f"SELECT src, dst, CASE (src + dst) % 5 WHEN 3 THEN q || ' LIMIT 5' WHEN 4 THEN NULL ELSE q END AS found FROM (SELECT src, dst, 'MATCH (g:Gene {{name: \"g[' || src || '\"}})-[r:INCREASES_RISK_OF]->(d {{id: ' || dst || '}}) RETURN collect(r.risk_score)[0..3]' AS q FROM risk)")
def answer_extracted_queries(s: Star) -> DataFrame:
    """Graph queries taken out of responses about each gene and disease: in actions with nested brackets and a bracket in
    quotes, in nested JSON, after a label in a code block, and bare with a limit."""
    risk = s.risk.select("src", "dst")
    q = F.concat(F.lit('MATCH (g:Gene {name: "g['), "src", F.lit('"})-[r:INCREASES_RISK_OF]->(d {id: '), "dst", F.lit("}) RETURN collect(r.risk_score)[0..3]"))
    kinds = [
        F.concat(F.lit("Thought: look\nAction: query_kg["), q, F.lit("]\nObservation: [x]")),
        F.concat(F.lit('Sure. {"steps": [1, {"cypher": "'), F.replace(q, F.lit('"'), F.lit('\\"')), F.lit('"}]} done')),
        F.concat(F.lit("Cypher: ```cypher\n"), q, F.lit("\n```\nAnswer: gene")),
        F.concat(F.lit("I would run "), q, F.lit(" LIMIT 5 and read it")),
        F.concat(F.lit("no query here for "), "src"),
    ]
    text, which = F.lit(None), (F.col("src") + F.col("dst")) % 5
    for i, kind in enumerate(kinds):
        text = F.when(which == i, kind).otherwise(text)
    return risk.select("src", "dst", A.extract_query(text).alias("found"))


def answer_entities(s: Star) -> DataFrame:
    """What the answers name; the rule's order of parts is beyond SQL."""
    named = A.entities(F.col("predicted"))
    return s.answers.select("conv_id", "turn", F.size(named).cast("long").alias("n"), F.array_join(named, "|").alias("entities"))


register("answer_entities", lambda spark, folder: answer_entities(Star(spark, folder)))


@query(f"SELECT type, count(*) AS answers, round(avg(CASE WHEN len(p) = 0 OR len(gd) = 0 THEN 0.0 ELSE n / len(gd) END), 9) AS partial, round(avg(n / greatest(len(gd), 1)), 9) AS open_recall, count(CASE WHEN len(list_filter(gd, lambda g: contains(lower(predicted), g))) > 0 THEN 1 END) AS containing FROM (SELECT l.*, a.predicted FROM {LISTS} l JOIN answers a USING (conv_id, turn)) GROUP BY 1")
def answer_partial(s: Star) -> DataFrame:
    """Partial matches, recall of open answers, and answers that hold a gold word, by type."""
    words = s.answers.select("type", "predicted", X.words(F.col("predicted")).alias("p"), X.words(F.col("gold")).alias("g"))
    p, g = F.col("p"), F.col("g")
    return words.groupBy("type").agg(
        F.count("*").alias("answers"), F.round(F.avg(A.partial_match(p, g)), 9).alias("partial"), F.round(F.avg(A.open_recall(p, g)), 9).alias("open_recall"), F.count_if(A.contains_gold(F.col("predicted"), g)).alias("containing")
    )


#: Matches are by containment in either direction, as answers are names; predictions and gold answers are lists of words.
_MATCHED = "list_filter({0}, lambda x: len(list_filter({1}, lambda y: contains(y, x) OR contains(x, y))) > 0)"
_RESULTS = f"(SELECT type, predicted IS NOT NULL AS success, list_distinct(p) AS p, g, len({_MATCHED.format('list_distinct(p)', 'g')}) AS hits, list_min(list_filter(list_transform(p, lambda x, i: CASE WHEN len(list_filter(g, lambda y: contains(y, x) OR contains(x, y))) > 0 THEN i END), lambda i: i IS NOT NULL)) AS place FROM (SELECT type, predicted, {WORDS.format('predicted')} AS p, list_distinct({WORDS.format('gold')}) AS g FROM answers))"
_SHARE = "round({0} / nullif(CAST({1} AS DOUBLE), 0), 9)"
_N, _DONE = "count(*)", "count(CASE WHEN len(p) > 0 THEN 1 END)"


def results(s: Star) -> DataFrame:
    """Each question's success, how many distinct predictions match, and the place of the first match."""
    words = s.answers.select("type", F.col("predicted").isNotNull().alias("success"), X.words(F.col("predicted")).alias("all"), F.array_distinct(X.words(F.col("gold"))).alias("g"))

    def match(x: Column) -> Column:
        return F.exists("g", lambda y: y.contains(x) | x.contains(y))

    places = F.filter(F.transform("all", lambda x, i: F.when(match(x), i + 1)), lambda i: i.isNotNull())
    p = F.array_distinct("all")
    return words.select("type", "success", p.alias("p"), "g", F.size(F.filter(p, match)).alias("hits"), F.try_element_at(places, F.lit(1)).alias("place"))


def _share(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part, whole), 9)


@query(f"SELECT coalesce(type, 'all') AS type, {_N} AS total, {_DONE} AS answered, {_SHARE.format(_DONE, _N)} AS coverage, {_SHARE.format('count(CASE WHEN success THEN 1 END)', _N)} AS executability, " + ", ".join(f"{_SHARE.format(f'count(CASE WHEN place <= {k} THEN 1 END)', _DONE)} AS hits_{k}" for k in (1, 5, 10)) + f", {_SHARE.format('sum(CASE WHEN place <= 10 THEN 1.0 / place ELSE 0 END)', _DONE)} AS mrr, {_SHARE.format('sum(CASE WHEN hits > 0 AND len(g) > 0 THEN 2.0 * (hits / len(p)) * (hits / len(g)) / (hits / len(p) + hits / len(g)) ELSE 0 END)', _N)} AS f1, {_SHARE.format('count(CASE WHEN hits > 0 THEN 1 END)', _N)} AS em FROM {_RESULTS} GROUP BY ROLLUP (type)")
def answer_corpus_metrics(s: Star) -> DataFrame:
    """Coverage, executability, F1 and exact match over all questions; hits and reciprocal ranks (up to the tenth place) over
    the answered ones; by type and overall."""
    rows, total, done = results(s), F.count("*"), F.count_if(F.size("p") > 0)
    precision, recall = F.try_divide(F.col("hits"), F.size("p")), F.try_divide(F.col("hits"), F.size("g"))
    f1 = F.when((F.col("hits") > 0) & (F.size("g") > 0), 2.0 * precision * recall / (precision + recall)).otherwise(0.0)
    hits = [_share(F.count_if(F.col("place") <= k), done).alias(f"hits_{k}") for k in (1, 5, 10)]
    out = rows.rollup("type").agg(
        total.alias("total"), done.alias("answered"), _share(done, total).alias("coverage"), _share(F.count_if("success"), total).alias("executability"), *hits,
        _share(F.sum(F.when(F.col("place") <= 10, 1.0 / F.col("place")).otherwise(0.0)), done).alias("mrr"), _share(F.sum(f1), total).alias("f1"), _share(F.count_if(F.col("hits") > 0), total).alias("em"),
    )
    return out.withColumn("type", F.coalesce("type", F.lit("all")))


@query(f"SELECT coalesce(type, 'all') AS type, {_N} AS total, {_DONE} AS answered, {_SHARE.format(_DONE, _N)} AS coverage, {_SHARE.format('sum(coalesce(1.0 / place, 0))', _DONE)} AS mrr, {_SHARE.format('count(place)', _N)} AS accuracy FROM {_RESULTS} GROUP BY ROLLUP (type)")
def answer_corpus_accuracy(s: Star) -> DataFrame:
    """The older figures: ranks at any place, and the share of all questions that are correct."""
    total, done = F.count("*"), F.count_if(F.size("p") > 0)
    out = results(s).rollup("type").agg(total.alias("total"), done.alias("answered"), _share(done, total).alias("coverage"), _share(F.sum(F.coalesce(1.0 / F.col("place"), F.lit(0.0))), done).alias("mrr"), _share(F.count("place"), total).alias("accuracy"))
    return out.withColumn("type", F.coalesce("type", F.lit("all")))
