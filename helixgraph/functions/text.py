"""Column functions for answers: normalisation, parsing and overlap. All but ROUGE-L stay in the JVM."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalise_case(c: Column) -> Column:
    """Trimmed lower case."""
    return F.lower(F.trim(c))


def normalise_words(c: Column) -> Column:
    """Lower case, all but letters, digits and underscores to single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def normalise_marks(c: Column) -> Column:
    """Trimmed lower case without punctuation marks."""
    return F.trim(F.translate(F.lower(c), ".,;:!?\"'()", ""))


def words(c: Column) -> Column:
    """The words of the normalised text; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(normalise_words(c), F.lit("")), " "), lambda w: w != "")


def shared(a: Column, b: Column) -> Column:
    """How many distinct words two lists share."""
    return F.size(F.array_intersect(a, b))


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(0.0)


def bleu1_set(predicted: Column, gold: Column) -> Column:
    """Distinct shared words over distinct predicted words."""
    return ratio(shared(predicted, gold), F.size(F.array_distinct(predicted)))


def rouge1_set(predicted: Column, gold: Column) -> Column:
    """Distinct shared words over distinct gold words."""
    return ratio(shared(predicted, gold), F.size(F.array_distinct(gold)))


def jaccard(a: Column, b: Column) -> Column:
    return ratio(shared(a, b), F.size(F.array_union(a, b)))


def token_f1(predicted: Column, gold: Column) -> Column:
    """F1 of distinct shared words over the lengths of the lists, repeats included."""
    n = shared(predicted, gold)
    p, r = ratio(n, F.size(predicted)), ratio(n, F.size(gold))
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def either_contains(a: Column, b: Column) -> Column:
    """Whether one normalised text is in the other; empty texts match nothing."""
    x, y = normalise_case(a), normalise_case(b)
    return F.coalesce((x != "") & (y != "") & (x.contains(y) | y.contains(x)), F.lit(False))


def best_rank(predicted: Column, gold: Column) -> Column:
    """The place of the first predicted answer that is gold, or null."""
    places = F.filter(F.transform(predicted, lambda p, i: F.when(F.array_contains(gold, p), i + 1)), lambda i: i.isNotNull())
    return F.try_element_at(places, F.lit(1))


def parse_choice_prefix(c: Column) -> Column:
    """The first of A, B, C and D (in this order) in the first 20 characters in upper case; else A."""
    head = F.upper(F.substring(F.trim(c), 1, 20))
    out = F.lit("A")
    for letter in "DCBA":
        out = F.when(head.contains(letter), letter).otherwise(out)
    return out


def parse_choice(c: Column) -> Column:
    """The letter after words that announce an answer, or one that stands alone; null if there is neither."""
    said = F.regexp_extract(F.upper(c), r"(?:ANSWER|OPTION|CHOICE)\s*(?:IS)?\s*[:\-]?\s*\(?([A-D])\b", 1)
    alone = F.regexp_extract(F.upper(c), r"(?:^|\s)\(?([A-D])[).:]?(?:\s|$)", 1)
    return F.when(said != "", said).when(alone != "", alone)


def parse_yes_no(c: Column) -> Column:
    """yes or no by substrings, yes first; else maybe. "no" is found within other words too."""
    low = F.lower(c)
    return F.when(low.contains("yes"), "yes").when(low.contains("no"), "no").otherwise("maybe")


def parse_list(c: Column) -> Column:
    """An answer list, split at the first delimiter present of comma, line break, semicolon and " and "; leading numbers
    go, and empty parts."""
    parts = (
        F.when(c.contains(","), F.split(c, ","))
        .when(c.contains("\n"), F.split(c, "\n"))
        .when(c.contains(";"), F.split(c, ";"))
        .when(c.contains(" and "), F.split(c, " and "))
        .otherwise(F.array(c))
    )
    return F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(F.trim(x), r"^[0-9.\-) ]+", ""))), lambda x: x != "")


#: Phrases by which a response declines to answer.
ABSTENTIONS = (
    "i don't know", "i do not know", "unknown", "cannot determine",
    "insufficient information", "not enough information", "unable to",
    "no information", "cannot answer", "not available", "n/a",
)
#: Verbal tiers of confidence, the first that a response holds counts.
CONFIDENT = (
    (0.9, ("certainly", "definitely", "absolutely", "i am sure", "clearly", "without doubt")),
    (0.7, ("likely", "probably", "i think", "i believe", "appears to be")),
    (0.4, ("possibly", "might", "may", "uncertain", "not sure", "perhaps")),
)


def holds_any(c: Column, phrases: tuple[str, ...]) -> Column:
    """Whether the text in small letters holds one of the phrases, within words too."""
    low, out = F.lower(c), F.lit(False)
    for phrase in phrases:
        out = out | low.contains(phrase)
    return out


def abstains(c: Column) -> Column:
    """Whether a response declines to answer; a null or empty one does."""
    return F.coalesce((c == "") | holds_any(c, ABSTENTIONS), F.lit(True))


def stated_confidence(c: Column) -> Column:
    """The number after the word confidence, as a share of 1 (numbers beyond 1 are percentages); null without one."""
    number = F.regexp_extract(F.lower(c), r"confidence[:\s]+([0-9]+(?:\.[0-9]+)?)", 1)
    value = F.when(number != "", number.cast("double"))
    share = F.when(value > 1, value / 100).otherwise(value)
    return F.when(share > 1, 1.0).otherwise(share)


def confidence(c: Column) -> Column:
    """A stated confidence, else a verbal tier, else 0.75; 0.5 for a null or empty response."""
    out = F.lit(0.75)
    for value, phrases in reversed(CONFIDENT):
        out = F.when(holds_any(c, phrases), value).otherwise(out)
    stated = stated_confidence(c)
    return F.when(c.isNull() | (c == ""), 0.5).when(stated.isNotNull(), stated).otherwise(out)


def query_is_balanced(c: Column) -> Column:
    """Whether a graph query has MATCH and RETURN and balanced brackets."""
    def count(x: str) -> Column:
        return F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))

    upper = F.upper(c)
    return upper.contains("MATCH") & upper.contains("RETURN") & (count("(") == count(")")) & (count("[") == count("]")) & (count("{") == count("}"))


def hops(c: Column) -> Column:
    """How many relationships a graph query's pattern has."""
    return F.size(F.regexp_extract_all(c, F.lit(r"-\[.*?\]-"), F.lit(0)))


def rouge_l(predicted: Column, gold: Column) -> Column:
    """F1 of the longest common subsequence of two word lists: the one metric without a built-in form."""

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([lcs_f1(list(x), list(y)) for x, y in zip(a, b)], dtype=float)

    return score(predicted, gold)


def lcs_length(a: list[str], b: list[str]) -> int:
    """The length of the longest common subsequence: a row of the table is one number with a bit for each word of a."""
    where: dict[str, int] = {}
    for i, word in enumerate(a):
        where[word] = where.get(word, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for word in b:
        met = row & where.get(word, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


def lcs_f1(a: list[str], b: list[str]) -> float:
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a and b else 0.0


def library_words(c: Column) -> Column:
    """Words as summary libraries take them: runs of a to z and digits of the text in small letters."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def clipped_f1(a: list[str], b: list[str], n: int) -> float:
    """F1 of n-grams, each counted as often as both sides have it."""
    x, y = (Counter(zip(*(words[i:] for i in range(n)))) for words in (a, b))
    total = x.total() + y.total()
    return 2 * (x & y).total() / total if x and y else 0.0


ROUGE = T.StructType([T.StructField(c, T.DoubleType()) for c in ("rouge1", "rouge2", "rougel")])


def library_rouge(predicted: Column, gold: Column) -> Column:
    """ROUGE-1, ROUGE-2 and ROUGE-L (F1, no stemming) of two word lists, as a struct; 0 where a side has no n-gram."""

    @F.pandas_udf(ROUGE)
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in batches:
            pairs = [(list(x), list(y)) for x, y in zip(a, b)]
            yield pd.DataFrame({"rouge1": [clipped_f1(x, y, 1) for x, y in pairs], "rouge2": [clipped_f1(x, y, 2) for x, y in pairs], "rougel": [lcs_f1(x, y) for x, y in pairs]}, dtype=float)

    return score(predicted, gold)
