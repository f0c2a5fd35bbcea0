"""The star-schema tables as the evidence engine's inputs: a property graph, variants, answers, labels and a call log.

Scores are ratios of integer sums, so that they do not depend on the order of summation.
"""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.pattern import Edge, Graph, bit_of, distinct_numbers
from .session import joinable, ranked, shuffled, written


def hundredths(column: str) -> F.Column:
    return F.round(F.col(column) * 100).cast("long")


#: Line items to a partition of the views that are made of them.
ROWS = 250_000


class Star:
    """Views over one folder of tables; every view is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def _lines(self) -> int:
        return self.table("lineitem").count()

    @cached_property
    def _parts(self) -> int:
        return max(self.spark.sparkContext.defaultParallelism, -(-self._lines // ROWS))

    def spread(self, df: DataFrame, *keys: str) -> DataFrame:
        """df in as many partitions as the line items ask for, so that a task's memory doesn't grow with the tables; joins and
        groups by these keys take them as they lie."""
        return df.repartition(self._parts, *keys)

    @cached_property
    def _customers(self) -> DataFrame:
        customers = self.table("customer")
        return joinable(customers.select("c_custkey", "c_nationkey"), customers.count())

    @cached_property
    def _owners(self) -> DataFrame:
        """The orders with their customers' nations."""
        return self.table("orders").join(self._customers, F.col("o_custkey") == F.col("c_custkey"))

    @cached_property
    def genes(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("brand"))

    @cached_property
    def maps_to(self) -> DataFrame:
        """SNP to gene: the best link score and the least distance of each pair (0: inside the gene)."""
        lines = self.spread(self.table("lineitem").select("l_orderkey", "l_partkey", "l_discount", "l_linenumber"), "l_orderkey")
        return lines.groupBy(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.max("l_discount").alias("link_score"), (F.min("l_linenumber") - 1).cast("long").alias("distance"))

    @cached_property
    def causal(self) -> DataFrame:
        """SNP to disease: causal score and p-value."""
        score = F.least(F.col("o_totalprice") / 500000, F.lit(1.0))
        return self._owners.select(F.col("o_orderkey").alias("src"), F.col("c_nationkey").alias("dst"), score.alias("causal_score"), F.pow(F.lit(10.0), score * -12).alias("pvalue"))

    @cached_property
    def risk(self) -> DataFrame:
        """Gene to disease: risk and evidence scores and the number of SNPs. The orders' side is joined before the sum."""
        owners = self._owners.select("o_orderkey", "c_nationkey")
        lines = self.spread(self.table("lineitem").select("l_orderkey", "l_partkey", "l_discount", "l_tax"), "l_orderkey")
        each = (
            shuffled(lines, self._lines)
            .join(self.spread(owners, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy("l_orderkey", "l_partkey", "c_nationkey")
            .agg(F.sum(hundredths("l_discount")).alias("discount"), F.sum(hundredths("l_tax")).alias("tax"), F.count("*").alias("n"))
        )
        return (
            self.spread(each, "l_partkey")
            .groupBy(F.col("l_partkey").alias("src"), F.col("c_nationkey").alias("dst"))
            .agg(
                (F.sum("discount") / (F.sum("n") * 10)).alias("risk_score"),
                (F.sum("tax") / (F.sum("n") * 8)).alias("evidence_score"),
                F.count("*").alias("snp_count"),  # a row for each order, which the join has made known
            )
        )

    @cached_property
    def graph(self) -> Graph:
        lines = self.table("lineitem")
        supplier, nation, region = self.table("supplier"), self.table("nation"), self.table("region")
        translated = self.spread(lines.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")), "src").distinct()
        parts = self.table("part").select(F.col("p_partkey").alias("id"), "p_type", "p_brand", "p_size")
        made = translated.join(joinable(parts, self.table("part").count()), F.col("src") == F.col("id"))
        score = F.when(F.col("s_acctbal") > 0, F.least(F.col("s_acctbal") / 10000, F.lit(1.0)))
        places = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        after = F.lead("s_suppkey").over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
        nodes = {
            "SNP": self.table("orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("rs"), F.col("o_orderkey")).alias("name")),
            "Gene": self.genes,
            "Protein": supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
            "Disease": nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")),
            "Pathway": region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")),
            "Process": self.table("part").select(F.col("p_type").alias("id"), F.col("p_type").alias("name")).distinct(),
            "Tissue": self.table("part").select(F.col("p_brand").alias("id"), F.col("p_brand").alias("name")).distinct(),
            "Function": self.table("part").select(F.split("p_type", " ")[0].alias("id"), F.split("p_type", " ")[0].alias("name")).distinct(),
            "Component": self.table("part").select(F.col("p_size").alias("id"), F.col("p_size").cast("string").alias("name")).distinct(),
        }
        edges = {
            "MAPS_TO": Edge(self.maps_to, "SNP", "Gene"),
            "PUTATIVE_CAUSAL_EFFECT": Edge(self.causal, "SNP", "Disease"),
            "INCREASES_RISK_OF": Edge(self.risk, "Gene", "Disease"),
            "TRANSLATED_INTO": Edge(translated, "Gene", "Protein"),
            "ASSOCIATED_WITH": Edge(supplier.select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").alias("dst"), score.alias("score")), "Protein", "Disease"),
            "ANNOTATED_IN_PATHWAY": Edge(places.select(F.col("s_suppkey").alias("src"), F.col("n_regionkey").alias("dst")), "Protein", "Pathway"),
            "HAS_PROCESS": Edge(made.select(F.col("dst").alias("src"), F.col("p_type").alias("dst")).distinct(), "Protein", "Process"),
            "EXPRESSED_IN": Edge(made.select(F.col("dst").alias("src"), F.col("p_brand").alias("dst")).distinct(), "Protein", "Tissue"),
            "HAS_FUNCTION": Edge(made.select(F.col("dst").alias("src"), F.split("p_type", " ")[0].alias("dst")).distinct(), "Protein", "Function"),
            "IN_COMPONENT": Edge(made.select(F.col("dst").alias("src"), F.col("p_size").alias("dst")).distinct(), "Protein", "Component"),
            "INTERACTS_WITH": Edge(supplier.select(F.col("s_suppkey").alias("src"), after.alias("dst")).filter("dst IS NOT NULL"), "Protein", "Protein"),
        }
        return Graph(nodes, edges)

    @cached_property
    def properties(self) -> DataFrame:
        """(src, kind, value), written: the distinct values of a part's properties that a protein has, for all kinds at once.

        Values of all kinds share one numbering and are met as bits, so line items are joined with parts once and no pair of
        protein and value is a row before it is known to be one of its own.
        """
        kinds = ("p_type", "p_brand", "p_size")
        parts = self.table("part").select(F.col("p_partkey").alias("_part"), *(F.col(k).cast("string").alias(k) for k in kinds))
        values = reduce(DataFrame.unionByName, [parts.select(F.lit(k).alias("kind"), F.col(k).alias("value")).distinct() for k in kinds])
        numbers = written(ranked(values, [F.col("kind"), F.asc_nulls_first("value")], "number"))
        for k in kinds:
            own = numbers.filter(F.col("kind") == k).select(F.col("value").alias("_value"), (F.col("number") - 1).alias("_number"))
            coded = parts.join(own, parts[k].eqNullSafe(own["_value"]))
            parts = coded.withColumns({f"{k}_word": F.floor(F.col("_number") / 63), f"{k}_bits": bit_of(F.col("_number"))}).drop(k, "_value", "_number")
        lines = self.spread(self.table("lineitem").select("l_partkey", F.col("l_suppkey").alias("src")), "l_partkey")
        met = lines.join(parts, F.col("l_partkey") == F.col("_part")).groupBy("src", *(f"{k}_word" for k in kinds)).agg(*(F.bit_or(f"{k}_bits").alias(f"{k}_bits") for k in kinds))
        words = met.select("src", F.explode(F.array(*(F.struct(F.col(f"{k}_word").alias("word"), F.col(f"{k}_bits").alias("bits")) for k in kinds))).alias("_")).select("src", "_.*")
        found = distinct_numbers(words, "src").join(numbers.withColumn("number", F.col("number") - 1), "number")
        return written(found.select("src", "kind", "value"))

    @cached_property
    def bare_graph(self) -> Graph:
        """The graph without what edges say, for queries over the ends of all types: proteins' properties are met once for
        the four types made of them, and risk isn't summed."""

        def having(kind: str) -> DataFrame:
            return self.properties.filter(F.col("kind") == kind).select("src", F.col("value").cast(self.table("part").schema[kind].dataType).alias("dst"))

        owners = self._owners.select("o_orderkey", F.col("c_nationkey").alias("dst"))
        lines = self.spread(self.table("lineitem").select("l_orderkey", F.col("l_partkey").alias("src")), "l_orderkey")
        pairs = shuffled(lines, self._lines).join(self.spread(owners, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("src", "dst")
        processes = having("p_type")
        tables = {
            "MAPS_TO": self.maps_to.select("src", "dst"),
            "INCREASES_RISK_OF": self.spread(pairs, "src").distinct(),
            "HAS_PROCESS": processes,
            "EXPRESSED_IN": having("p_brand"),
            "HAS_FUNCTION": processes.select("src", F.split("dst", " ")[0].alias("dst")).distinct(),
            "IN_COMPONENT": having("p_size"),
        }
        return Graph(self.graph.nodes, {k: replace(e, table=tables[k] if k in tables else e.table.select("src", "dst")) for k, e in self.graph.edges.items()})

    @cached_property
    def variants(self) -> DataFrame:
        """Variants with study statistics, one row a line item; two posterior probabilities, -1 where a method failed."""
        tail = F.pow(F.lit(10.0), -F.col("l_extendedprice") / 6000)
        return self.table("lineitem").select(
            F.concat(F.lit("rs"), F.col("l_orderkey")).alias("rsid"),
            F.col("l_suppkey").alias("meta_id"),
            (F.col("l_suppkey") % 22 + 1).cast("int").alias("chr"),
            (F.col("l_partkey") * 1000 + F.col("l_linenumber")).cast("long").alias("bp"),
            F.col("l_tax").alias("maf"),
            (F.round(F.col("l_discount") * 100) - 5).alias("beta"),
            tail.alias("p"),
            (F.col("l_extendedprice") / 6000).alias("neglog10p"),
            F.when(F.col("l_quantity") > 10, F.col("l_quantity") / 50).otherwise(-1.0).alias("susie"),
            F.when(F.col("l_linenumber") > 1, F.col("l_linenumber") / 7).otherwise(-1.0).alias("finemap"),
            F.col("l_partkey").alias("gene"),
            (F.col("l_linenumber") - 1).alias("distance"),
            F.col("l_returnflag").alias("disease"),
            F.col("l_shipdate").alias("seen"),
        )

    @cached_property
    def answers(self) -> DataFrame:
        """Question answering: a user's words are the gold answer, those of the assistant's next turn the prediction."""
        talk = self.table("conversations")
        user = talk.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("gold"))
        reply = talk.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("predicted"))
        kind = F.element_at(F.array(F.lit("one-hop"), F.lit("multi-hop"), F.lit("conjunction")), (F.col("conv_id") % 3 + 1).cast("int"))
        return user.join(reply, ["conv_id", "turn"], "left").withColumn("type", kind)

    @cached_property
    def labelled(self) -> DataFrame:
        """Classification: quality is the truth and toxic the prediction, language and source the strata."""
        docs = self.table("documents").select("doc_id", "lang", "source", "n_chars")
        return self.table("labels").join(docs, "doc_id").select("doc_id", F.col("quality").alias("truth"), F.col("toxic").alias("predicted"), "lang", "source", "n_chars")

    @cached_property
    def calls(self) -> DataFrame:
        """A log of model calls."""
        return self.table("events").select(F.col("event_id").alias("call_id"), "ts", F.col("event_type").alias("model"), F.round("value").cast("long").alias("tokens_in"), F.floor(F.col("value") / 2).cast("long").alias("tokens_out"), "user_id", "props")


#: The same views in DuckDB's SQL, for oracles: WITH clauses by name.
VIEWS = {
    "snp": "SELECT o_orderkey AS id, 'rs' || o_orderkey AS name FROM orders",
    "gene": "SELECT p_partkey AS id, p_name AS name, p_type AS type, p_brand AS brand FROM part",
    "protein": "SELECT s_suppkey AS id, s_name AS name FROM supplier",
    "disease": "SELECT n_nationkey AS id, n_name AS name FROM nation",
    "pathway": "SELECT r_regionkey AS id, r_name AS name FROM region",
    "maps_to": "SELECT l_orderkey AS src, l_partkey AS dst, max(l_discount) AS link_score, CAST(min(l_linenumber) - 1 AS BIGINT) AS distance FROM lineitem GROUP BY 1, 2",
    "causal": "SELECT o_orderkey AS src, c_nationkey AS dst, least(o_totalprice / 500000, 1.0) AS causal_score, pow(10.0, least(o_totalprice / 500000, 1.0) * -12) AS pvalue FROM orders JOIN customer ON o_custkey = c_custkey",
    "risk": "SELECT l_partkey AS src, c_nationkey AS dst, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 10) AS risk_score, CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 8) AS evidence_score, count(DISTINCT l_orderkey) AS snp_count FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
    "translated": "SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem",
    "associated": "SELECT s_suppkey AS src, s_nationkey AS dst, CASE WHEN s_acctbal > 0 THEN least(s_acctbal / 10000, 1.0) END AS score FROM supplier",
    "in_pathway": "SELECT s_suppkey AS src, n_regionkey AS dst FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "has_process": "SELECT DISTINCT l_suppkey AS src, p_type AS dst FROM lineitem JOIN part ON l_partkey = p_partkey",
    "expressed_in": "SELECT DISTINCT l_suppkey AS src, p_brand AS dst FROM lineitem JOIN part ON l_partkey = p_partkey",
    "has_function": "SELECT DISTINCT l_suppkey AS src, string_split(p_type, ' ')[1] AS dst FROM lineitem JOIN part ON l_partkey = p_partkey",
    "in_component": "SELECT DISTINCT l_suppkey AS src, p_size AS dst FROM lineitem JOIN part ON l_partkey = p_partkey",
    "interacts": "SELECT * FROM (SELECT s_suppkey AS src, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS dst FROM supplier) WHERE dst IS NOT NULL",
    "variants": "SELECT 'rs' || l_orderkey AS rsid, l_suppkey AS meta_id, CAST(l_suppkey % 22 + 1 AS INTEGER) AS chr, l_partkey * 1000 + l_linenumber AS bp, l_tax AS maf, round(l_discount * 100) - 5 AS beta, pow(10.0, -l_extendedprice / 6000) AS p, l_extendedprice / 6000 AS neglog10p, CASE WHEN l_quantity > 10 THEN l_quantity / 50 ELSE -1.0 END AS susie, CASE WHEN l_linenumber > 1 THEN l_linenumber / 7 ELSE -1.0 END AS finemap, l_partkey AS gene, l_linenumber - 1 AS distance, l_returnflag AS disease, l_shipdate AS seen FROM lineitem",
    "answers": "SELECT u.conv_id, u.turn, u.text AS gold, a.text AS predicted, ['one-hop', 'multi-hop', 'conjunction'][CAST(u.conv_id % 3 + 1 AS INTEGER)] AS type FROM conversations u LEFT JOIN conversations a ON a.role = 'assistant' AND a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user'",
    "labelled": "SELECT labels.doc_id, quality AS truth, toxic AS predicted, lang, source, n_chars FROM labels JOIN documents USING (doc_id)",
    "calls": "SELECT event_id AS call_id, ts, event_type AS model, CAST(round(value) AS BIGINT) AS tokens_in, CAST(floor(value / 2) AS BIGINT) AS tokens_out, user_id, props FROM events",
}


def with_views(sql: str) -> str:
    """The query after WITH clauses for the views whose names it holds."""
    import re

    words = set(re.findall(r"\w+", sql))
    used = [k for k in VIEWS if k in words]
    if not used:
        return sql
    clauses = ", ".join(f"{k} AS ({VIEWS[k]})" for k in used)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {clauses}, {body[5:]}"
    return f"WITH {clauses} {body}"
