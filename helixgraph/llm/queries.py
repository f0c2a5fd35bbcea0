"""The registered queries of this subpackage: thin calls of the operators with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, clusters, collocations, flac, hilbert, licenses, lines, packing, quantise, simhash, suffix, toxicity
from .common import documents


#: Ids of a packed sequence; the id that ends a document.
CAPACITY, END_ID = 1024, 2


def tokenized(docs: DataFrame) -> DataFrame:
    """Pieces of the documents' ids in the vocabulary of byte_bpe_50k.json (whose ranks are in the rank file)."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return packing.tokenize(docs, "doc_id", "text", path, pattern, {"<|endoftext|>": 50256}, END_ID, CAPACITY)


def op1_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a FLAC stream, read back and described."""
    media = flac.encode_column(documents(spark, sf_dir), "doc_id", "text")
    return flac.features(media, "doc_id", "media", "n_bytes")


def op2_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of each vector whose id is divisible by 100, among all others."""
    return quantise.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, k=10)


def held_out() -> Column:
    """The rows whose labels are never learned from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def toxicity_model(docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """The grammar fitted on the labels outside of the held-out rows."""
    labels = docs.sparkSession.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(~held_out())
    return toxicity.train(docs, labels)


def op3_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity by the composed grammar."""
    docs = documents(spark, sf_dir)
    scored = toxicity.score(docs, toxicity_model(docs, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and conversation -1 full of control strings, from heterogeneous records into the template."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hostile = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", hostile), (-1, 1, "assistant", hostile)], rows.schema)
    turns = chat.canonical_turns(chat.as_records(rows.union(extra), "conv_id", "turn"), ["conv_id", "turn"], "record")
    placed = turns.withColumn("place", F.col("turn") + F.col("part"))
    return chat.digest_conversations(chat.format_turns(placed), "conv_id", ["place"])


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 400-byte strings that also start elsewhere; beside it, how many runs of more
    than 50 words come again, whatever their bytes, and how many words they have."""
    out = suffix.remove_repeats(documents(spark, sf_dir), "doc_id", "text", length=400, passages=51)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "n_passages", "passage_words", F.sha2("kept", 256).alias("kept_sha256"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash of 3-word shingles and its component over links of at most 2 bits."""
    found = simhash.near_duplicates(documents(spark, sf_dir), "doc_id", "text", words=3, radius=2, seed=42)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document on a Hilbert curve over language, source and bytes, cut into 16 shards of equal counts."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang", "source")
    keys = docs.select(
        "doc_id",
        "lang",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    out = hilbert.shard(keys, "doc_id", ["lang", "source", "size"], ["text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("_curve").alias("curve_index"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids packed into sequences of at most 1024."""
    return packing.pack(tokenized(documents(spark, sf_dir)), ["doc_id", "piece", "ids_crc32"], CAPACITY)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded with the ranks of the 50k byte-level vocabulary."""
    return bpe.round_trip(documents(spark, sf_dir), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the paragraphs and lines that came earlier in the corpus."""
    out = lines.remove_repeated_units(documents(spark, sf_dir), "doc_id", "text", ("paragraph", "line"))
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return out.select("doc_id", "n_bytes", "n_units", "n_removed", "n_spans", "longest_words", spans.alias("removed_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster among 40, after five rounds of exact integer arithmetic over bit planes."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    mark = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    return clusters.with_inertia(*clusters.cluster(rows, "vec_id", "embedding", mark, k=40, rounds=5))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license phrases and signatures."""
    found = licenses.summary(licenses.scan(documents(spark, sf_dir), "doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("found").cast("long").alias("n_found"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of two to four words of each language."""
    return collocations.mine(documents(spark, sf_dir, "text", "lang"), "text", "lang", least=30, longest=4, top=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_flac_media": op1_flac_media,
    "op2_additive_quantisation": op2_additive_quantisation,
    "op3_toxicity_grammar": op3_toxicity_grammar,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_hilbert_shards": op7_hilbert_shards,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_line_dedup": op10_line_dedup,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_license_scan": op12_license_scan,
    "op13_collocations": op13_collocations,
}

def _cluster_sql(k: int, rounds: int) -> str:
    """The clustering as SQL: a clause for each round, in long form (vector, component, integer)."""
    clauses = [
        "kept AS (SELECT row_number() OVER () AS v, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(256 * x) AS BIGINT)) AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "cells AS (SELECT v, unnest(e) AS x, generate_subscripts(e, 1) AS j FROM kept)",
        f"first AS (SELECT v, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM kept QUALIFY c < {k})",
        "m0 AS (SELECT c, j, x FROM first JOIN cells USING (v))",
    ]
    for i in range(rounds + 1):
        clauses.append(f"d{i} AS (SELECT v, c, CAST(sum((cells.x - m{i}.x) * (cells.x - m{i}.x)) AS BIGINT) AS d FROM cells JOIN m{i} USING (j) GROUP BY 1, 2)")
        clauses.append(f"a{i} AS (SELECT v, c, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY v ORDER BY d, c) = 1)")
        if i < rounds:
            clauses.append(f"s{i} AS (SELECT c, j, CAST(sum(x) AS BIGINT) AS t, count(*) AS n FROM a{i} JOIN cells USING (v) GROUP BY 1, 2)")
            clauses.append(f"m{i + 1} AS (SELECT m{i}.c, m{i}.j, CASE WHEN n IS NULL THEN x ELSE (t - ((t % n) + n) % n) // n END AS x FROM m{i} LEFT JOIN s{i} USING (c, j))")
    clauses.append(f"marks AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS h FROM m{rounds} GROUP BY 1)")
    last = f"SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM a{rounds} JOIN kept USING (v) JOIN marks USING (c)"
    return f"WITH {', '.join(x.replace(' AS (', ' AS MATERIALIZED (', 1) for x in clauses)} {last}"


def _license_sql() -> str:
    """The scan as SQL: every rule spelled out, tried at the places of its keyword."""
    listed = []
    for n, x in enumerate(licenses.signatures()):
        for f, (prefix, priority, weight) in enumerate(licenses.FORMS):
            if prefix and x.base:
                continue
            body = f"^{prefix}{x.body}( |$)"
            listed.append(f"('{x.keyword}', {x.lead + prefix.count(' ')}, '{body}', '{x.label}', {priority}, {weight}, {n * len(licenses.FORMS) + f}, {x.base})")
    return rf"""
        WITH rules(keyword, lead, body, label, priority, weight, rule, base) AS (VALUES {", ".join(listed)}),
        texts AS (
            SELECT doc_id, row_number() OVER () AS d, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws
            FROM documents
        ),
        places AS (SELECT d, ws, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM texts),
        near AS (SELECT d, i, lead, body, label, priority, weight, rule, base, array_to_string(ws[i - lead + 1 : i - lead + 40], ' ') AS s FROM places JOIN rules ON w = keyword WHERE i >= lead),
        matched AS (SELECT *, trim(regexp_extract(s, body)) AS m FROM near WHERE regexp_matches(s, body)),
        every AS MATERIALIZED (SELECT d, i - lead AS a, i - lead + len(string_split(m, ' ')) AS b, label, priority, weight, rule, base FROM matched),
        one AS MATERIALIZED (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY d, a ORDER BY b DESC, priority, rule) = 1),
        whole AS MATERIALIZED (SELECT * FROM one o WHERE NOT EXISTS (SELECT 1 FROM one e WHERE e.d = o.d AND e.a < o.a AND e.b >= o.b)),
        found AS MATERIALIZED (SELECT * FROM whole o WHERE NOT EXISTS (SELECT 1 FROM whole e WHERE e.d = o.d AND e.a < o.b AND o.a < e.b AND e.priority < o.priority)),
        bases AS (SELECT d, count(*) AS n_base, min(a) AS first_word, max(a) AS last_word, array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels FROM every WHERE base GROUP BY 1),
        said AS (SELECT d, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM (SELECT d, label FROM found UNION ALL SELECT d, label FROM every WHERE base) GROUP BY 1),
        scores AS (SELECT d, max(weight) AS score, count(*) AS n_found FROM found GROUP BY 1)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(CAST(score AS DOUBLE), 0.0) AS score, coalesce(n_found, 0) AS n_found
        FROM texts LEFT JOIN bases USING (d) LEFT JOIN said USING (d) LEFT JOIN scores USING (d)
    """


#: DuckDB SQL for those that SQL can express; it has no CRC-32, codecs, automata or fingerprints for the others.
ORACLE_SQL: dict[str, str] = {
    "op5_suffix_dedup": r"""
        WITH texts AS (SELECT doc_id, encode(coalesce(text, '')) AS e, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
        starts AS (SELECT doc_id, s, md5(array_slice(e, s + 1, s + 400)) AS m FROM (SELECT doc_id, e, unnest(range(0, n - 399)) AS s FROM texts WHERE n >= 400)),
        repeated AS (SELECT doc_id, s FROM starts WHERE m IN (SELECT m FROM starts GROUP BY m HAVING count(*) > 1)),
        marked AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 400 THEN 0 ELSE 1 END AS new FROM repeated),
        numbered AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM marked),
        spans AS (SELECT doc_id, min(s) AS a, max(s) + 400 AS b FROM numbered GROUP BY doc_id, run),
        pieces AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans),
        cut AS (
            SELECT t.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
            FROM pieces p JOIN texts t USING (doc_id) GROUP BY 1
        ),
        words AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
        tokens AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM words WHERE len(ws) >= 51),
        windows AS (SELECT doc_id, i, n, md5(string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 50 FOLLOWING)) AS m FROM tokens),
        full_windows AS (SELECT doc_id, i, m FROM windows WHERE i + 50 <= n),
        again AS (SELECT doc_id, i FROM full_windows WHERE m IN (SELECT m FROM full_windows GROUP BY m HAVING count(*) > 1)),
        jumps AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 51 THEN 0 ELSE 1 END AS new FROM again),
        runs AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM jumps),
        passages AS (SELECT doc_id, count(*) AS n_passages, sum(size) AS passage_words FROM (SELECT doc_id, max(i) - min(i) + 51 AS size FROM runs GROUP BY doc_id, run) GROUP BY 1)
        SELECT t.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
            coalesce(n_passages, 0) AS n_passages, CAST(coalesce(passage_words, 0) AS BIGINT) AS passage_words, sha256(unhex(coalesce(kept, h))) AS kept_sha256
        FROM texts t LEFT JOIN cut USING (doc_id) LEFT JOIN passages USING (doc_id)
    """,
    "op10_line_dedup": r"""
        WITH blocks AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(?s).*?\n(?:[\x20\x09\x0B-\x0D]*\n)+|(?s).+') AS p FROM documents),
        paragraphs AS (SELECT doc_id, generate_subscripts(p, 1) AS b, unnest(p) AS unit FROM blocks),
        judged AS (
            SELECT doc_id, b, unit, words <> '' AND row_number() OVER (PARTITION BY words ORDER BY doc_id, b) > 1 AS cut
            FROM (SELECT *, array_to_string(list_filter(string_split_regex(lower(unit), '[\x20\x09-\x0D]+'), lambda w: w <> ''), ' ') AS words FROM paragraphs WHERE unit <> '')
        ),
        parts AS (SELECT doc_id, b, cut, regexp_extract_all(unit, '[^\n]*\n|[^\n]+') AS p FROM judged),
        numbered AS (SELECT doc_id, cut, row_number() OVER (PARTITION BY doc_id ORDER BY b, j) AS i, unit FROM (SELECT doc_id, b, cut, generate_subscripts(p, 1) AS j, unnest(p) AS unit FROM parts)),
        placed AS (
            SELECT doc_id, i, cut, unit, strlen(unit) AS size, sum(strlen(unit)) OVER (PARTITION BY doc_id ORDER BY i) - strlen(unit) AS start,
                list_filter(string_split_regex(lower(unit), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
            FROM numbered
        ),
        ranked AS (
            SELECT *, cut OR len(words) > 0 AND row_number() OVER (PARTITION BY cut, array_to_string(words, ' ') ORDER BY doc_id, start) > 1 AS gone FROM placed
        ),
        runs AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, gone ORDER BY i) AS run FROM ranked),
        spans AS (
            SELECT doc_id, count(*) AS n_spans, string_agg(a || '-' || b, ',' ORDER BY a) AS removed_spans, sum(b - a) AS n_removed, max(n_words) AS longest_words
            FROM (SELECT doc_id, CAST(min(start) AS BIGINT) AS a, CAST(max(start + size) AS BIGINT) AS b, sum(len(words)) AS n_words FROM runs WHERE gone GROUP BY doc_id, run) GROUP BY 1
        ),
        kept AS (SELECT doc_id, string_agg(unit, '' ORDER BY i) AS text FROM ranked WHERE NOT gone GROUP BY 1),
        totals AS (SELECT doc_id, count(*) AS n_units FROM ranked GROUP BY 1)
        SELECT d.doc_id, CAST(strlen(coalesce(d.text, '')) AS BIGINT) AS n_bytes, coalesce(n_units, 0) AS n_units, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
            coalesce(n_spans, 0) AS n_spans, CAST(coalesce(longest_words, 0) AS BIGINT) AS longest_words, coalesce(removed_spans, '') AS removed_spans, sha256(coalesce(k.text, '')) AS kept_sha256
        FROM documents d LEFT JOIN spans s USING (doc_id) LEFT JOIN kept k USING (doc_id) LEFT JOIN totals t USING (doc_id)
    """,
    "op11_centroid_clusters": _cluster_sql(40, 5),
    "op12_license_scan": _license_sql(),
    "op13_collocations": r"""
        WITH texts AS (
            SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
            FROM documents
        ),
        pieces AS (SELECT lang, list_filter(string_split_regex(unnest(pieces), '[\x20\x09]+'), lambda w: w <> '') AS ws FROM texts),
        totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM pieces GROUP BY 1),
        sizes(m) AS (VALUES (1), (2), (3), (4)),
        places AS (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM pieces, sizes WHERE len(ws) >= m),
        counts AS MATERIALIZED (SELECT lang, m, array_to_string(ws[i : i + m - 1], ' ') AS phrase, count(*) AS f FROM places GROUP BY 1, 2, 3 HAVING count(*) >= 30),
        candidates AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS ws, f AS a FROM counts WHERE m > 1),
        cuts AS (SELECT c.lang, c.phrase, c.a, k, p.f AS l, r.f AS r, CAST(2000000 AS HUGEINT) * c.a // (p.f + r.f) AS score FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) c JOIN counts p ON p.lang = c.lang AND p.phrase = array_to_string(c.ws[1 : k], ' ') JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[k + 1 :], ' ')),
        scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        shorter AS (SELECT lang, a AS f, array_to_string(ws[i : i + s - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM candidates))),
        within AS (SELECT lang, phrase, max(f) AS f FROM shorter GROUP BY 1, 2),
        kept AS (SELECT s.* FROM scored s LEFT JOIN within w USING (lang, phrase) WHERE w.f IS NULL OR 100 * w.f < 80 * s.a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
    """,
}
