"""Over-representation of gene sets: hypergeometric upper tails and Benjamini-Hochberg adjustment, as columns.

A term's p-value is the chance that at least as many of its genes are among the genes asked for, were these drawn without
replacement from the universe.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.session import ranked, running_min, written

#: Stirling's series is used from here on; smaller errors are taken from a table.
_SERIES = 16
_ERRORS = [math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) for n in range(1, _SERIES)]


def stirling_error(n: Column) -> Column:
    """ln n! less Stirling's formula, for whole numbers from 1 on; small, so that differences of it lose no digits."""
    x = n.cast("double")
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * x * x)) / (x * x)) / (x * x)) / x
    return F.when(n < _SERIES, F.try_element_at(F.lit(_ERRORS), n.cast("int"))).otherwise(series)


def _log_binomial(x: Column, n: Column, p: Column, q: Column) -> Column:
    """ln of the chance of x hits in n draws, by the deviance from what is expected: no large terms cancel."""

    def deviance(seen: Column, due: Column) -> Column:
        return seen * F.log(seen / due) + due - seen

    inner = stirling_error(n) - stirling_error(x) - stirling_error(n - x) - deviance(x, n * p) - deviance(n - x, n * q) - 0.5 * F.log(2 * math.pi * x * (n - x) / n)
    return F.when(x == 0, n * F.log(q)).when(x == n, n * F.log(p)).otherwise(inner)


def upper_tail(hits: Column, term: Column, drawn: Column, universe: Column) -> Column:
    """P(X >= hits), X the number of a term's genes among ``drawn`` genes of a ``universe``; 1 where no hit is asked for, 0
    where there can't be so many, null where a count is null, negative or larger than the universe. The terms follow from the
    first by ratios, so each row takes one logarithmic sum and as many products as there are terms."""
    most = F.least(term, drawn)
    least = F.greatest(hits, term + drawn - universe, F.lit(0))

    p, q = drawn / universe, (universe - drawn) / universe
    first = F.exp(_log_binomial(least, term, p, q) + _log_binomial(drawn - least, universe - term, p, q) - _log_binomial(drawn, universe, p, q))
    zero = F.struct(F.lit(0.0).alias("total"), F.lit(1.0).alias("factor"))

    def step(state: Column, i: Column) -> Column:
        ratio = (term - i).cast("double") * (drawn - i) / ((i + 1) * (universe - term - drawn + i + 1).cast("double"))
        return F.struct((state["total"] + state["factor"]).alias("total"), (state["factor"] * ratio).alias("factor"))

    total = F.aggregate(F.sequence(least, most), zero, step, lambda s: s["total"])
    sound = (hits >= 0) & (term >= 0) & (drawn >= 0) & (F.greatest(term, drawn) <= universe)
    # sequence() counts downwards where its end lies before its start, so an impossible number of hits is told first
    return F.when(sound, F.when(hits > most, 0.0).when(hits <= F.greatest(term + drawn - universe, F.lit(0)), 1.0).otherwise(F.least(first * total, F.lit(1.0))))


def counted(terms: DataFrame, asked: DataFrame, universe: DataFrame, by: list[str]) -> DataFrame:
    """Sizes for ``upper_tail`` from rows (by..., gene), genes asked for (gene) and the universe (gene): by..., term, hits,
    drawn, universe. Genes outside the universe count nowhere; repeated rows count once; terms without hits are kept."""
    known = universe.select("gene").filter("gene IS NOT NULL").distinct()
    chosen = written(asked.select("gene").distinct().join(known, "gene").withColumn("_hit", F.lit(1)))
    sizes = known.agg(F.count("*").alias("universe")).crossJoin(chosen.agg(F.count("*").alias("drawn")))  # one row
    members = terms.select(*by, "gene").distinct().join(known, "gene").join(chosen, "gene", "left")
    found = members.groupBy(*by).agg(F.count("*").alias("term"), F.coalesce(F.sum("_hit"), F.lit(0)).alias("hits"))
    return found.crossJoin(F.broadcast(sizes))


def adjusted(df: DataFrame, by: str, p: str = "p", key: str = "term_name") -> DataFrame:
    """Benjamini-Hochberg within each group: the least of p * m / rank from each row on, in order of p, then key. A null p takes
    no part: it isn't counted in m and its adjusted value is null. ``by`` must not be null; by, p and key should tell rows apart."""
    order = [F.col(p), F.col(key)]
    tested = ranked(df.filter(F.col(p).isNotNull()), [F.col(by), *order], "_place")
    groups = written(tested.groupBy(by).agg(F.min("_place").alias("_first"), F.count("*").alias("_m")))
    raw = tested.join(groups, by).withColumn("_raw", F.least(F.lit(1.0), F.col(p) * F.col("_m") / (F.col("_place") - F.col("_first") + 1)))
    done = running_min(raw, by, order, "_raw", "adjusted").drop("_place", "_first", "_m", "_raw")
    return done.unionByName(df.filter(F.col(p).isNull()).withColumn("adjusted", F.lit(None).cast("double")))


def enrich(terms: DataFrame, asked: DataFrame, universe: DataFrame, library: str = "library", name: str = "term_name") -> DataFrame:
    """Every term of every library with its sizes, p and adjusted p."""
    sizes = counted(terms, asked, universe, [library, name])
    return adjusted(sizes.withColumn("p", upper_tail(F.col("hits"), F.col("term"), F.col("drawn"), F.col("universe"))), library, "p", name)
