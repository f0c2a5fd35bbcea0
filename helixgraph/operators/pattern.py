"""Property-graph patterns as joins over typed node and edge tables."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.session import ranked, written


def desc_like_graph(column: Column | str) -> Column:
    """Descending order with nulls first, as graph query languages have it (null is the largest value)."""
    return (F.col(column) if isinstance(column, str) else column).desc_nulls_first()


@dataclass(frozen=True)
class Edge:
    """An edge table (src, dst, properties) and the labels of its ends. A pair of ends has one edge of a type, unless the table
    has a column ``edge_no`` that tells parallel ones apart (see ``numbered``). ``reverse`` holds the same rows laid out by dst,
    where a graph is stored so."""

    table: DataFrame
    source: str
    target: str
    reverse: DataFrame | None = None


def numbered(table: DataFrame) -> DataFrame:
    """An edge table with ``edge_no``: parallel edges between two ends by their properties, from 0. Equal rows are edges of their
    own. A pair of ends is one group, so the shuffle is by both."""
    rest = [c for c in table.columns if c not in ("src", "dst")]
    order = [F.col(c) for c in rest] or [F.lit(0)]
    return table.withColumn("edge_no", F.row_number().over(Window.partitionBy("src", "dst").orderBy(*order)) - 1)


@dataclass(frozen=True)
class Graph:
    """Typed node tables (id, name, properties) by label and edge tables by type."""

    nodes: dict[str, DataFrame]
    edges: dict[str, Edge]

    def match(self, label: str, alias: str) -> Pattern:
        """All nodes of a label; their columns are named alias_column."""
        return Pattern(self, _prefixed(self.nodes[label], alias), {alias: label})

    def along(self, start: str, kind: str, edge: str, end: str, direction: str = "out", id_only: bool = False) -> Pattern:
        """All edges of a type as a match of one hop that binds nothing of its first node but the id: for graphs whose edges all
        begin at nodes."""
        side, label = Pattern(self, self.edges[kind].table)._side(kind, edge, end, direction, id_only)
        near = self.edges[kind].target if direction == "in" else self.edges[kind].source
        return Pattern(self, side.withColumn(f"{start}_id", F.col(f"{edge}_here")), {start: near, end: label}, {edge: kind})

    def any_node(self) -> DataFrame:
        """(label, id, name) of the nodes of all labels, ids as strings."""
        parts = [t.select(F.lit(k).alias("label"), F.col("id").cast("string").alias("id"), F.col("name").cast("string").alias("name")) for k, t in self.nodes.items()]
        return reduce(DataFrame.unionByName, parts)

    def any_edge(self) -> DataFrame:
        """(type, source_label, src, target_label, dst) of the edges of all types, ids as strings."""
        parts = [
            e.table.select(F.lit(k).alias("type"), F.lit(e.source).alias("source_label"), F.col("src").cast("string").alias("src"), F.lit(e.target).alias("target_label"), F.col("dst").cast("string").alias("dst"))
            for k, e in self.edges.items()
        ]
        return reduce(DataFrame.unionByName, parts)

    def _ends_of(self, label: str) -> list[DataFrame]:
        """The ids at which edges end at nodes of a label, a table for each end; a self-loop ends once."""
        ends = [e.table.select(F.col("src").alias("id")) for e in self.edges.values() if e.source == label]
        for edge in self.edges.values():
            if edge.target == label:
                loop = F.coalesce(F.col("src").cast("string") == F.col("dst").cast("string"), F.lit(False))
                ends.append((edge.table.filter(~loop) if edge.source == label else edge.table).select(F.col("dst").alias("id")))
        return ends

    def degrees(self) -> DataFrame:
        """(label, id, degree) of every node over edges of all types and both directions; isolated nodes have 0.

        Each label is counted by itself, its ids as they are if all have one type. Nodes take part in the count as rows without
        an edge, so that no join follows it; rows are combined before the one shuffle of each label.
        """
        parts = []
        for label, nodes in self.nodes.items():
            ends = self._ends_of(label)
            id_ = F.col("id") if all(x.schema["id"].dataType == nodes.schema["id"].dataType for x in ends) else F.col("id").cast("string").alias("id")
            rows = [nodes.select(id_, F.lit(1).alias("n"), F.lit(0).cast("long").alias("degree"))]
            rows += [x.select(id_, F.lit(0).alias("n"), F.lit(1).cast("long").alias("degree")) for x in ends]
            counted = reduce(DataFrame.unionByName, rows).groupBy("id").agg(F.sum("n").cast("int").alias("n"), F.sum("degree").alias("degree"))
            degree = F.when(F.col("id").isNull(), 0).otherwise(F.col("degree"))  # no filter: it would reach the scans, and both ends' shuffles differ
            each = F.explode(F.array_repeat(degree, F.col("n")))  # nodes that share an id are rows of their own
            parts.append(counted.filter("n > 0").select(F.lit(label).alias("label"), F.col("id").cast("string").alias("id"), each.alias("degree")))
        return reduce(DataFrame.unionByName, parts)

    def subgraph(self, conditions: dict[str, str]) -> Graph:
        """The same nodes with the edges of the types named that meet their conditions."""
        return Graph(self.nodes, {k: replace(self.edges[k], table=self.edges[k].table.filter(c), reverse=None) for k, c in conditions.items()})


def _prefixed(df: DataFrame, alias: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{alias}_{c}") for c in df.columns))


@dataclass(frozen=True)
class Pattern:
    """Rows that bind nodes and edges by alias; each step is a join, and Catalyst orders and prunes them.

    Within one match an edge is taken once: a hop along a type that the match has taken before leaves out the edges that the
    row holds, in whichever direction they were followed. Opposite and parallel edges are different ones. ``again`` begins
    another match, which may take them anew.
    """

    graph: Graph
    rows: DataFrame
    labels: dict[str, str] = field(default_factory=dict)
    taken: dict[str, str] = field(default_factory=dict)

    def where(self, condition: Column | str) -> Pattern:
        return replace(self, rows=self.rows.filter(condition))

    def again(self) -> Pattern:
        """A further match that shares the bound aliases; its edges may be those of the matches before."""
        return replace(self, taken={})

    def _ends(self, kind: str, direction: str) -> tuple[DataFrame, str]:
        """The edges of a type as (here, there, src, dst, properties), and the label at the far end."""
        edge = self.graph.edges[kind]
        forth = edge.table.withColumns({"here": F.col("src"), "there": F.col("dst")})
        back = (edge.table if edge.reverse is None else edge.reverse).withColumns({"here": F.col("dst"), "there": F.col("src")})
        if direction == "out":
            return forth, edge.target
        if direction == "in":
            return back, edge.source
        return forth.unionByName(back.filter("here <> there")), edge.target  # a self-loop matches once

    def _side(self, kind: str, edge: str, end: str, direction: str, id_only: bool) -> tuple[DataFrame, str]:
        """The edges of a type with the node at the far end, unless that is bound, and its label."""
        ends, label = self._ends(kind, direction)
        side = _prefixed(ends, edge)
        if end in self.labels:
            return side, label
        if id_only:
            return side.withColumn(f"{end}_id", F.col(f"{edge}_there")), label
        return side.join(_prefixed(self.graph.nodes[label], end), F.col(f"{edge}_there") == F.col(f"{end}_id")), label

    def _other_edge(self, kind: str, edge: str) -> Column | None:
        """Whether an edge isn't one of those of its type that the row holds; null if the match has none."""
        mark = ["src", "dst"] + ["edge_no"] * ("edge_no" in self.graph.edges[kind].table.columns)
        others = [a for a, k in self.taken.items() if k == kind]
        return reduce(Column.__and__, (~reduce(Column.__and__, (F.col(f"{a}_{c}").eqNullSafe(F.col(f"{edge}_{c}")) for c in mark)) for a in others)) if others else None

    def hop(self, start: str, kind: str, edge: str, end: str, direction: str = "out", optional: bool = False, condition: Column | str | None = None, id_only: bool = False) -> Pattern:
        """Follow edges of a type from a bound alias; ``condition`` on the edge's and the end's columns belongs to the
        join, so that an optional hop keeps rows without a match. If the end is bound too, both ends are met. ``id_only``
        binds nothing but the end's id and joins no node table: for graphs whose edges all end at nodes."""
        side, label = self._side(kind, edge, end, direction, id_only)
        bound = end in self.labels
        if condition is not None:
            side = side.filter(condition)
        on = self.rows[f"{start}_id"] == side[f"{edge}_here"]
        if bound:
            on = on & (self.rows[f"{end}_id"] == side[f"{edge}_there"])
        other = self._other_edge(kind, edge)
        joined = self.rows.join(side, on if other is None else on & other, "left" if optional else "inner")
        return Pattern(self.graph, joined, self.labels if bound else self.labels | {end: label}, self.taken | {edge: kind})

    def exists(self, start: str, kind: str, direction: str = "out", condition: Column | str | None = None, negate: bool = False) -> Pattern:
        """Keep rows whose node has (or, negated, lacks) an edge of a type."""
        ends, _ = self._ends(kind, direction)
        if condition is not None:
            ends = ends.filter(condition)
        keys = ends.select(F.col("here").alias("_here"))
        return replace(self, rows=self.rows.join(keys, self.rows[f"{start}_id"] == keys["_here"], "left_anti" if negate else "left_semi"))

    def select(self, *columns: Column | str) -> DataFrame:
        return self.rows.select(*columns)


def reach_counts(first: DataFrame, second: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(src, n): how many distinct nodes ``second`` (src, dst) reaches from the far ends of ``first`` (src, dst).

    ``dictionary`` numbers the far nodes (dst, number), a written table. 63 neighbouring numbers are the bits of one word, so
    a node in the middle has a few words instead of a row for each target, and words are or-ed for each source: the product
    of sources and targets isn't made, whatever the fan-out.
    """
    coded = second.join(dictionary, "dst").select("src", F.floor(F.col("number") / 63).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("number") % 63).cast("int")).alias("bit"))
    words = coded.groupBy(F.col("src").alias("middle"), "word").agg(F.bit_or("bit").alias("bits"))
    met = first.select("src", F.col("dst").alias("middle")).join(words, "middle").groupBy("src", "word").agg(F.bit_or("bits").alias("bits"))
    return met.groupBy("src").agg(F.sum(F.bit_count("bits")).alias("n"))


def bit_of(place: Column) -> Column:
    """The bit of a place in its word."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), (place % 63).cast("int"))


def _places(word: Column, bits: Column) -> Column:
    """The places whose bits a word holds, ascending."""
    held = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda i: F.call_function("shiftright", bits, i).bitwiseAND(F.lit(1).cast("long")) == 1)
    return F.transform(held, lambda i: word * 63 + i)


def reached_numbers(first: DataFrame, second: DataFrame, src: str, middle: list[str]) -> DataFrame:
    """(src, number): the numbers that ``second`` (middle, number) gives the middle nodes of ``first`` (src, middle), each once.

    63 neighbouring numbers are the bits of one word, or-ed for each source, so only what is reached becomes rows, not paths.
    """
    words = second.groupBy(*middle, F.floor(F.col("number") / 63).alias("word")).agg(F.bit_or(bit_of(F.col("number"))).alias("bits"))
    return distinct_numbers(first.select(src, *middle).join(words, middle), src)


def distinct_numbers(words: DataFrame, src: str) -> DataFrame:
    """(src, number): the numbers whose bits the words (src, word, bits) of a source hold, each once."""
    met = words.groupBy(src, "word").agg(F.bit_or("bits").alias("bits"))
    return met.select(src, F.explode(_places(F.col("word"), F.col("bits"))).alias("number"))


def reached(first: DataFrame, second: DataFrame, most: int) -> DataFrame:
    """(src, matches, known, found): how many distinct values ``second`` (src, value) gives the far ends of ``first`` (src,
    dst), null among them and without it, and the first ``most`` in order, joined by commas.

    The smaller of both sides is numbered and made bits, 63 to a word: the values, or-ed for each source, or the sources,
    or-ed for each value. So a path isn't a row, whatever the fan-out, and no group is held.
    """
    values, sources = second.select("value").distinct(), first.select("src").distinct()
    values = written(ranked(values, [F.asc_nulls_last("value")], "number"))
    word, second = F.floor((F.col("number") - 1) / 63), second.select(F.col("src").alias("middle"), "value")
    bit = bit_of(F.col("number") - 1)
    if (n_values := values.count()) <= (sources := written(sources)).count():
        last = n_values - 1 if values.filter("value IS NULL").count() else -1
        numbers = values.withColumnRenamed("value", "_value")
        coded = second.join(numbers, second["value"].eqNullSafe(numbers["_value"])).groupBy("middle", word.alias("word")).agg(F.bit_or(bit).alias("bits"))
        met = first.select("src", F.col("dst").alias("middle")).join(coded, "middle").groupBy("src", "word").agg(F.bit_or("bits").alias("bits"))
        place = F.row_number().over(Window.partitionBy("src").orderBy("word"))
        unknown = F.max(F.array_contains(_places(F.col("word"), F.col("bits")), F.lit(last).cast("long")).cast("int")) if last >= 0 else F.lit(0)
        words = met.withColumn("_n", place).groupBy("src").agg(
            F.sum(F.bit_count("bits")).cast("long").alias("matches"), unknown.alias("_unknown"), F.sort_array(F.collect_list(F.when(F.col("_n") <= most, F.struct("word", "bits")))).alias("_words")
        )
        words = written(words.select("src", "matches", (F.col("matches") - F.col("_unknown")).alias("known"), F.slice(F.flatten(F.transform("_words", lambda w: _places(w["word"], w["bits"]))), 1, most).alias("_first")))
        each = words.select("src", F.posexplode("_first").alias("_n", "_place")).join(values, F.col("_place") == F.col("number") - 1)
    else:
        numbers = written(ranked(sources, [F.col("src")], "number"))
        coded = first.join(numbers, "src").groupBy(F.col("dst").alias("middle"), word.alias("word")).agg(F.bit_or(bit).alias("bits"))
        met = written(second.join(coded, "middle").groupBy("value", "word").agg(F.bit_or("bits").alias("bits")))
        pairs = met.select("value", F.explode(_places(F.col("word"), F.col("bits"))).alias("_place"))
        counts = pairs.groupBy("_place").agg(F.count("*").alias("matches"), F.count("value").alias("known"))
        words = counts.join(numbers, F.col("_place") == F.col("number") - 1).select("src", "matches", "known")
        place = F.row_number().over(Window.partitionBy("_place").orderBy(F.asc_nulls_last("value")))
        each = pairs.withColumn("_n", place).filter(F.col("_n") <= most).join(numbers, F.col("_place") == F.col("number") - 1).select("src", "_n", "value")
    listed = each.groupBy("src").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "value"))), lambda x: x["value"]), ",").alias("found"))
    return words.join(listed, "src", "left").select("src", "matches", "known", "found")
