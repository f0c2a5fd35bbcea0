"""Gold answers: stored questions are run against the graph by their tasks, all questions of one shape in one plan.

A task says where a question's path begins and ends (its parameters), the edges in between, and what is answered. Questions
are rows, so a thousand of a kind cost one join. Query texts aren't read: a task's id stands for its query.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.session import dealt, joinable, shuffled, written
from .pattern import Graph, Pattern, _prefixed, reached


@dataclass(frozen=True)
class Task:
    """A kind of question. The path begins at the node of ``label`` that the parameter ``start`` names and follows ``hops``
    (type, direction); with ``end`` its last node is that parameter's. Nodes are n0, n1, ..., edges e1, e2, ...

    ``answer`` is an SQL expression over their columns; rows must meet ``where``. The distinct values are taken in the order
    ``by`` (ascending; a minus sign before a column, or ``-inf`` in its place, gives descending order with nulls first), then
    by value, and the first ``most`` are the answer. ``count`` answers with their number instead, 0 included.

    ``form`` says what of a path of two hops the expressions read, so that not every path need be a row: ``near``, nothing
    beyond n1 (the second hop need only exist); ``far``, nothing but n2, and there is no order (ends are met as sets of bits);
    ``apart``, nothing before n1, and answers of different n1 differ (those of each n1 are told once, its first ``most`` go on).
    """

    id: str
    label: str
    start: str
    hops: tuple[tuple[str, str], ...]
    answer: str
    end: str | None = None
    where: str = "true"
    by: str = "0D"
    most: int = 1
    count: bool = False
    form: str = ""

    @property
    def shape(self) -> tuple:
        return self.label, self.start, self.hops, self.end or "", self.form

    @property
    def taxonomy(self) -> str:
        return self.id[:1]

    @property
    def parameters(self) -> tuple[str, ...]:
        return (self.start, self.end) if self.end else (self.start,)


def falling(column: str) -> str:
    """An ascending key for a descending order in which nulls come first, as graph query languages have it."""
    return f"coalesce(-CAST({column} AS DOUBLE), -CAST('Infinity' AS DOUBLE))"


def rising(column: str) -> str:
    """An ascending key with nulls last."""
    return f"coalesce(CAST({column} AS DOUBLE), CAST('Infinity' AS DOUBLE))"


def _of(tasks: list[Task], column: str, otherwise: str) -> Column:
    """An expression that depends on the row's task."""
    texts: dict[str, list[str]] = {}
    for t in tasks:
        texts.setdefault(getattr(t, column), []).append(t.id)
    if len(texts) == 1:
        return F.expr(next(iter(texts)))
    out = F.expr(otherwise)
    for text, ids in texts.items():
        out = F.when(F.col("task_id").isin(ids), F.expr(text)).otherwise(out)
    return out


def _matched(graph: Graph, tasks: list[Task], questions: DataFrame) -> DataFrame:
    """(question, task_id, value, ord) of all paths of the questions of one shape."""
    first = tasks[0]
    kind = graph.nodes[first.label].schema["id"].dataType
    own = questions.filter(F.col("task_id").isin([t.id for t in tasks])).select(
        "question", "task_id", F.col("parameters")[first.start].try_cast(kind).alias("_start"), *([F.col("parameters")[first.end].alias("_end")] if first.end else [])
    )
    nodes = _prefixed(graph.nodes[first.label], "n0")
    found = Pattern(graph, own.join(nodes, F.col("_start") == F.col("n0_id")), {"n0": first.label})
    for i, (edge, direction) in enumerate(first.hops[:1] if first.form == "near" else first.hops, 1):
        found = found.hop(f"n{i - 1}", edge, f"e{i}", f"n{i}", direction)
    if first.form == "near":
        found = found.exists("n1", *first.hops[1])
    if first.end:
        last = f"n{len(first.hops)}_id"
        found = found.where(F.col("_end").try_cast(found.rows.schema[last].dataType) == F.col(last))
    rows = found.where(_of(tasks, "where", "false")).rows
    text = _of([Task(**{**t.__dict__, "answer": f"CAST({t.answer} AS STRING)"}) for t in tasks], "answer", "CAST(NULL AS STRING)")
    return rows.select("question", "task_id", text.alias("value"), _of(tasks, "by", "0D").alias("ord"))


def _check_form(task: Task) -> None:
    (near, _), (far, _) = task.hops
    if near == far or task.end or task.where != "true" or task.count:
        raise ValueError(f"{task.id}: a path of this form has two types of edges, no end, no condition and no count")


def _told(graph: Graph, task: Task, questions: DataFrame) -> DataFrame:
    """(question, task_id, matches, known, _listed) of a task of the forms ``far`` and ``apart``, by the nodes that begin paths."""
    _check_form(task)
    (near, way), (far, onward) = task.hops
    kind = graph.nodes[task.label].schema["id"].dataType
    own = questions.filter(F.col("task_id") == task.id).select("question", "task_id", F.col("parameters")[task.start].try_cast(kind).alias("_start"))
    begin = Pattern(graph, _prefixed(graph.nodes[task.label], "n0"), {"n0": task.label})
    begin = begin.where(F.col("n0_id").isNotNull()).hop("n0", near, "e1", "n1", way)
    first = begin.rows.join(own.select("_start"), F.col("n0_id") == F.col("_start"), "left_semi").select(F.col("n0_id").alias("src"), F.col("n1_id").alias("dst"))
    ends = graph.match(begin.labels["n1"], "n1").hop("n1", far, "e2", "n2", onward).rows.select(F.col("n1_id").alias("src"), F.expr(task.answer).cast("string").alias("value"), F.expr(task.by).alias("ord"))
    told = reached(first, ends.select("src", "value"), task.most) if task.form == "far" else _apart(first, ends, task.most)
    return own.join(told, F.col("_start") == F.col("src")).select("question", "task_id", "matches", "known", F.col("found").alias("_listed"))


def _apart(first: DataFrame, ends: DataFrame, most: int) -> DataFrame:
    """(src, matches, known, found) as ``reached`` has them, with an order, for values (src, value, ord) of which no two src
    share one but null: each far end of ``first`` (src, dst) carries its counts and its first values, so a path isn't a row that moves."""
    order = [F.col("value").isNull() if most > 1 else F.lit(False), F.col("ord"), F.asc_nulls_last("value")]
    values = ends.groupBy("src", "value").agg(F.min("ord").alias("ord")).withColumn("_n", F.row_number().over(Window.partitionBy("src").orderBy(*order)))
    carried = F.collect_list(F.when(F.col("_n") <= most, F.struct("ord", "value")))
    values = values.groupBy(F.col("src").alias("dst")).agg(F.max(F.col("value").isNull().cast("long")).alias("_null"), F.count("value").alias("known"), carried.alias("_first"))
    met = first.distinct().join(values, "dst").repartition("src")  # from here on all of a src lies in one task, sorted there
    each = met.select("src", "_null", "known", F.posexplode_outer("_first").alias("_i", "_v")).select("src", "_null", "known", F.coalesce("_i", F.lit(0)).alias("_i"), "_v.*")
    each = each.withColumn("_n", F.row_number().over(Window.partitionBy("src").orderBy(*order)))
    known = F.sum(F.when(F.col("_i") == 0, F.col("known")))
    listed = F.sort_array(F.collect_list(F.when(F.col("_n") <= most, F.struct("_n", "value"))))
    return each.groupBy("src").agg((known + F.max("_null")).alias("matches"), known.alias("known"), F.array_join(F.transform(listed, lambda x: x["value"]), ",").alias("found"))


def _listed(tasks: list[Task], values: DataFrame) -> DataFrame:
    """(question, task_id, matches, known, _listed) of (question, task_id, value, ord), a row for each value."""
    lists = [t for t in tasks if not t.count]
    matches = values.groupBy("question", "task_id").agg(F.count("*").alias("matches"), F.count("value").alias("known"))
    if not lists:
        return matches.withColumn("_listed", F.lit(None).cast("string"))
    most = F.lit(0)
    for k in sorted({t.most for t in lists}):
        most = F.when(F.col("task_id").isin([t.id for t in lists if t.most == k]), k).otherwise(most)
    place = F.row_number().over(Window.partitionBy("question", "task_id").orderBy("ord", F.asc_nulls_last("value")))
    listable = F.col("value").isNotNull() | F.col("task_id").isin([t.id for t in tasks if t.most == 1])  # lists skip nulls, a first row may be null
    first = values.filter(F.col("task_id").isin([t.id for t in lists]) & listable).withColumn("_n", place).filter(F.col("_n") <= max(t.most for t in lists)).filter(F.col("_n") <= most)
    listed = first.groupBy("question", "task_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "value"))), lambda x: x["value"]), ",").alias("_listed"))
    return matches.join(listed, ["question", "task_id"], "left")


def answers(graph: Graph, tasks: list[Task], questions: DataFrame) -> DataFrame:
    """(question, task_id, answer, matches) for the questions (question, task_id, parameters map) of known tasks that have a
    path; ``matches`` counts distinct values, null among them, ``answer`` joins the first by commas (null if all are null).

    Tasks of one shape share their joins. Repeated questions are answered once; parameters of the wrong type match nothing.
    """
    asked = questions.select("question", "task_id", "parameters").dropDuplicates(["question", "task_id"])
    whole = sorted((t for t in tasks if t.form not in ("far", "apart")), key=lambda t: t.shape)
    both = [_told(graph, t, asked) for t in tasks if t.form in ("far", "apart")]
    if parts := [_matched(graph, list(own), asked) for _, own in groupby(whole, key=lambda t: t.shape)]:
        values = reduce(DataFrame.unionByName, parts).groupBy("question", "task_id", "value").agg(F.min("ord").alias("ord"))
        both.append(_listed(whole, dealt(written(values), "question", "task_id")))
    counts = [t.id for t in tasks if t.count]
    answer = F.when(F.col("task_id").isin(counts), F.col("known").cast("string")).when(F.col("_listed") != "", F.col("_listed"))
    return reduce(DataFrame.unionByName, both).select("question", "task_id", answer.alias("answer"), "matches")


def validate(graph: Graph, tasks: list[Task], questions: DataFrame) -> DataFrame:
    """The questions with answer, valid and reason: ``unknown_task``, ``missing_parameter``, ``no_results``, ``null_answer`` or
    ``ok``. Counts without a match answer 0."""
    known = questions.sparkSession.createDataFrame([(t.id, list(t.parameters), t.count) for t in tasks], "task_id string, _needs array<string>, _counts boolean")
    found = answers(graph, tasks, questions).withColumnsRenamed({"answer": "_answer", "matches": "_matches"})
    rows = questions.join(F.broadcast(known), "task_id", "left").join(found, ["question", "task_id"], "left")
    lacks = F.exists("_needs", lambda p: F.col("parameters")[p].isNull())
    answer = F.when(F.col("_counts") & ~F.coalesce(lacks, F.lit(True)), F.coalesce("_answer", F.lit("0"))).otherwise(F.col("_answer"))
    reason = (
        F.when(F.col("_needs").isNull(), "unknown_task")
        .when(F.coalesce(lacks, F.lit(True)), "missing_parameter")
        .when(answer.isNotNull(), "ok")
        .when(F.col("_matches").isNull(), "no_results")
        .otherwise("null_answer")
    )
    return rows.withColumn("answer", answer).withColumn("reason", reason).withColumn("valid", F.col("reason") == "ok").drop("_needs", "_counts", "_answer", "_matches")


#: Tasks whose levels one number holds, two bits each.
TOGETHER = 31
#: Questions to a partition in which they meet the levels.
TOLD = 1_000_000


def _signs(tasks: list[Task]) -> dict[str, tuple[Callable, Column]]:
    """What of its values says whether a question has an answer, by column: an aggregate, which partial ones merge by too, and
    its argument. A value is empty (0), a text (1) or null (2). Lists skip nulls, so one text suffices; of a first row its sign
    counts, where the order is given the least key of each sign."""
    out: dict[str, tuple[Callable, Column]] = {}
    for i, t in enumerate(tasks):
        value = f"CAST({t.answer} AS STRING)"
        sign = F.expr(f"CASE WHEN {t.where} THEN CASE WHEN {value} IS NULL THEN 2 WHEN {value} = '' THEN 0 ELSE 1 END END")
        if t.most > 1:
            out[f"_{i}"] = F.max, F.when(sign == 1, 2).when(sign.isNotNull(), 1)
        elif t.by == "0D":
            out[f"_{i}"] = F.min, sign
        else:
            out |= {f"_{i}_{k}": (F.min, F.when(sign == k, F.coalesce(F.expr(t.by).cast("double"), F.lit(float("-inf"))))) for k in range(3)}
    return out


def _level(i: int, task: Task) -> Column:
    """0 without a path, 1 if the answer is null, 2 if there is one, from a task's signs."""
    if task.most > 1:
        return F.coalesce(F.col(f"_{i}"), F.lit(0))
    if task.by == "0D":
        return F.when(F.col(f"_{i}").isNull(), 0).when(F.col(f"_{i}") == 1, 2).otherwise(1)
    empty, text, null = (F.col(f"_{i}_{k}") for k in range(3))
    first = text.isNotNull() & F.coalesce(text < empty, F.lit(True)) & F.coalesce(text <= null, F.lit(True))
    return F.when(F.coalesce(empty, text, null).isNull(), 0).when(first, 2).otherwise(1)


def _reads(tasks: list[Task], node: str) -> bool:
    """Whether tasks read more of a node than its id."""
    return any(re.search(rf"\b{node}_(?!id\b)", text) for t in tasks for text in (t.answer, t.where, t.by))


def _chained(graph: Graph, task: Task) -> bool:
    """Whether the edges of a task's path begin at the label where the one before ends."""
    label = task.label
    for kind, direction in task.hops:
        near, far = graph.edges[kind].source, graph.edges[kind].target
        near, far = (far, near) if direction == "in" else (near, far)
        if label != near or direction not in ("in", "out") and near != far:
            return False
        label = far
    return True


def _bound(graph: Graph, tasks: list[Task], rows: dict[str, int]) -> tuple[Graph, Graph]:
    """The graph with the edges both of whose ends are nodes, written once, as several shapes read them, and the one with all
    edges of the types that need only exist. Node tables are ready to be joined. ``rows`` are the nodes of each label in use."""
    nodes = {k: joinable(graph.nodes[k], n) for k, n in rows.items()}
    loose = {t.hops[1][0] for t in tasks if t.form == "near"}
    tables = {}
    for kind in dict.fromkeys(kind for t in tasks for kind, _ in t.hops):
        out = graph.edges[kind].table
        for end, label in (("src", graph.edges[kind].source), ("dst", graph.edges[kind].target)):
            ids = nodes[label].select(F.col("id").alias("_id"))
            if kind in loose:
                out = out.join(joinable(ids.distinct(), rows[label]), F.col(end) == F.col("_id"), "left").withColumn(f"_{end}", F.col("_id").isNotNull()).drop("_id")
            else:
                out = out.join(ids, F.col(end) == F.col("_id"), "left_semi")
        out = written(out)
        tables[kind] = shuffled(out, out.count())
    both = {k: t.filter("_src AND _dst").drop("_src", "_dst") if k in loose else t for k, t in tables.items()}
    return tuple(Graph(nodes, {k: replace(graph.edges[k], table=t, reverse=None) for k, t in own.items()}) for own in (both, {k: tables[k].drop("_src", "_dst") for k in loose}))


def _levels(graph: Graph, loose: Graph, tasks: list[Task], pairs: DataFrame | None, rows: dict[str, int], whole: bool) -> DataFrame:
    """(_start, _end, _level) of all nodes that begin a path of one shape, or of the ``pairs`` (_start, _end) asked of it; the
    levels of the tasks are two bits each. No answer is listed, and no path of a form is a row. With ``whole`` all edges end at
    nodes, and those of which nothing is read but their ids aren't joined; ``loose`` has the edges that need only exist."""
    first, signs = tasks[0], _signs(tasks)
    own = [f(c).alias(k) for k, (f, c) in signs.items()]
    merged = [f(F.col(k)).alias(k) for k, (f, _) in signs.items()]
    met = first.form in ("near", "far", "apart")  # the second hop is told for each n1, and met by its id
    if met and first.form != "near":
        for t in tasks:
            _check_form(t)
    hops = first.hops[:1] if met else first.hops
    last = f"n{len(hops)}"
    bare = [whole and not _reads(tasks, f"n{i}") for i in range(len(first.hops) + 1)]
    only = [whole and met and first.form != "near" or b for b in bare]
    nodes, found = _prefixed(graph.nodes[first.label], "n0"), None
    if first.end:
        start = F.col("_start").cast(nodes.schema["n0_id"].dataType)
        asked = pairs.select(start.alias("n0_id"), "_end") if bare[0] else pairs.join(nodes, start == F.col("n0_id"))
        found = Pattern(graph, asked, {"n0": first.label})
    elif not only[0]:
        found = Pattern(graph, nodes, {"n0": first.label})
    for i, (edge, direction) in enumerate(hops, 1):
        step = found.hop if found is not None else graph.along
        found = step(f"n{i - 1}", edge, f"e{i}", f"n{i}", direction, id_only=only[i])
    keys = ["n0_id"]
    if first.end:
        found, keys = found.where(F.col("_end").cast(found.rows.schema[f"{last}_id"].dataType) == F.col(f"{last}_id")), ["n0_id", f"{last}_id"]
    if met:
        (far, onward), label = first.hops[1], found.labels["n1"]
        if first.form == "near":
            ends = loose.along("n1", far, "e2", "n2", onward, id_only=True).rows.select("n1_id").distinct()
            found = replace(found, rows=found.rows.join(shuffled(ends, rows[label]), "n1_id", "left_semi"))
        else:
            ends = graph.along("n1", far, "e2", "n2", onward, bare[2]) if bare[1] else graph.match(label, "n1").hop("n1", far, "e2", "n2", onward, id_only=bare[2])
            ends, own = ends.rows.groupBy("n1_id").agg(*own), merged
            found = replace(found, rows=found.rows.select("n0_id", "n1_id").join(shuffled(ends, rows[label]), "n1_id"))
    packed = reduce(Column.__add__, (F.shiftleft(_level(i, t).cast("long"), 2 * i) for i, t in enumerate(tasks)))
    end = F.col(keys[1]).cast("string") if first.end else F.lit("")
    return found.rows.groupBy(*keys).agg(*own).select(F.col("n0_id").cast("string").alias("_start"), end.alias("_end"), packed.alias("_level")).filter("_level > 0")


def reasons(graph: Graph, tasks: list[Task], questions: DataFrame) -> DataFrame:
    """The questions with valid and reason as ``validate`` has them, but no answers. Whether there is one is told for all nodes
    by aggregates of edges, for all tasks of one shape at once; questions then meet a row for each node. No table that grows
    with the graph is sent to all executors, so the driver holds none."""
    task = F.col("task_id")
    lists = sorted((t for t in tasks if not t.count), key=lambda t: t.shape)
    shapes = [own[i : i + TOGETHER] for own in (list(g) for _, g in groupby(lists, key=lambda t: t.shape)) for i in range(0, len(own), TOGETHER)]
    labels = {t.label for t in lists} | {label for t in lists for kind, _ in t.hops for label in (graph.edges[kind].source, graph.edges[kind].target)}
    counted = [graph.nodes[k].select(F.lit(k).alias("label")) for k in sorted(labels)]
    rows = {k: 0 for k in labels} | {r["label"]: r["count"] for r in (reduce(DataFrame.unionByName, counted).groupBy("label").count().collect() if counted else [])}

    def end_of(t: Task, label: str) -> str:
        for edge, direction in t.hops:
            label = graph.edges[edge].source if direction == "in" else graph.edges[edge].target
        return label

    def named(parameter: str, label: str) -> Column:  # as its type writes it; null for a wrong one
        return F.col("parameters")[parameter].try_cast(graph.nodes[label].schema["id"].dataType).cast("string")

    places, starts, ends = {}, {}, {}
    for k, own in enumerate(shapes):
        for i, t in enumerate(own):
            places[t.id] = k, 2 * i
            starts.setdefault((t.start, t.label), []).append(t.id)
            ends.setdefault((t.end, end_of(t, t.label)) if t.end else None, []).append(t.id)
    shape, bits = (F.try_element_at(F.create_map(*(F.lit(x) for id, place in places.items() for x in (id, place[j]))), task) if places else F.lit(None) for j in range(2))
    start, end, lacks = F.lit(None), F.lit(None), F.lit(None)
    for of, ids in starts.items():
        start = F.when(task.isin(ids), named(*of)).otherwise(start)
    for of, ids in ends.items():
        end = F.when(task.isin(ids), named(*of) if of else F.lit("")).otherwise(end)
    for needs in dict.fromkeys(t.parameters for t in tasks):
        missing = reduce(Column.__or__, (F.col("parameters")[p].isNull() for p in needs))
        lacks = F.when(task.isin([t.id for t in tasks if t.parameters == needs]), missing).otherwise(lacks)
    keys = ["_shape", "_start", "_end"]
    named_start = F.when(shape.isNull(), F.col("question")).otherwise(start)  # those that nothing is looked up for needn't meet in one task
    asked = questions.withColumns({"_shape": shape.cast("int"), "_start": named_start.cast("string"), "_end": end.cast("string"), "_bits": bits.cast("int"), "_lacks": lacks.cast("boolean")})
    paired = [k for k, own in enumerate(shapes) if own[0].end]
    if paired:
        pairs = written(asked.filter(F.col("_shape").isin(paired)).select(*keys).distinct())
        n_pairs = {k: 0 for k in paired} | {r["_shape"]: r["count"] for r in pairs.groupBy("_shape").count().collect()}
    whole, loose = _bound(graph, lists, rows)
    told = []
    for k, own in enumerate(shapes):
        wanted = joinable(pairs.filter(F.col("_shape") == k).select("_start", "_end"), n_pairs[k]) if k in paired else None
        chained = _chained(graph, own[0])
        # a shape at a time: in one plan of all of them, each stage that ends would have the driver plan the rest anew
        told.append(written(_levels(whole if chained else graph, loose, own, wanted, rows, chained)).withColumn("_shape", F.lit(k)))
    if told:
        parts = max(questions.sparkSession.sparkContext.defaultParallelism, -(-questions.count() // TOLD))
        found = asked.repartition(parts, *keys).join(reduce(DataFrame.unionByName, told).repartition(parts, *keys).hint("merge"), keys, "left")
    else:
        found = asked.withColumn("_level", F.lit(None).cast("long"))
    level = F.coalesce(F.call_function("shiftright", F.col("_level"), F.col("_bits")), F.lit(0)).bitwiseAND(F.lit(3).cast("long"))
    reason = (
        F.when(F.col("_lacks").isNull(), "unknown_task")
        .when(F.col("_lacks"), "missing_parameter")
        .when(task.isin([t.id for t in tasks if t.count]) | (level == 2), "ok")
        .when(level == 0, "no_results")
        .otherwise("null_answer")
    )
    return found.withColumn("reason", reason).withColumn("valid", F.col("reason") == "ok").drop(*keys, "_bits", "_lacks", "_level")


def shares(validated: DataFrame, by: list[str]) -> DataFrame:
    """Questions, valid ones and their share in per cent for each group, and over all of its first column (null after it)."""
    totals = validated.rollup(*by).agg(F.count("*").alias("questions"), F.count_if("valid").alias("valid"))
    return totals.filter(F.col(by[0]).isNotNull()).withColumn("pct", F.round(100.0 * F.col("valid") / F.col("questions"), 1))
