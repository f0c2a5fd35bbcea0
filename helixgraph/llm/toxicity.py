"""Toxicity by a weighted finite-state pattern grammar.

Five transducers over the labels of a sentence's words and marks are composed into one machine: insults (a degree word
makes one strong), threats (an intent before a violent verb), negation (softens what comes soon after it), reported
speech (marks what is told or quoted, over commas, colons and quotation marks) and targets (a person on either side
sharpens an insult and makes a threat direct). Insulting words and stems come from labels; cues are fixed lists. A
document's score is a logistic function of the weights that its matched clauses gather, by the kind of clause, so words
count by what is said with them. Speech reported after the quotation ("...", he said) isn't seen, as the machine reads
from left to right; a sentence ends reported speech.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, pieces

#: Labelled rows that are fitted on at most: those whose ids have the least hashes.
TRAIN_ROWS = 20_000
#: Lengths of word beginnings that can be learned as insulting stems.
STEMS = (4, 5, 6, 7)
#: Evidence that a learned word or stem needs (nats of a binomial test against the share of toxic rows), and how many.
EVIDENCE, MOST_LEXEMES = 14.0, 5_000
#: Share of toxic rows among those that hold a learned word or stem, at least.
RATE = 0.8
#: Words over which a negation, an intent or a target reaches.
REACH = 3
CHUNK = 4 << 20

#: Cue words in English, German, French and Spanish.
CUES = {
    "NEG": "not no never isn't aren't wasn't don't doesn't nobody nicht kein keine nie pas jamais aucun nunca ningún tampoco".split(),
    "REPORT": "said says saying told called calls wrote reported quoted sagte sagt nannte schrieb berichtete dit disait appelait écrit dijo dice llamó escribió".split(),
    "TARGET": "you your you're they them their he she him her these those all du dich dir ihr sie euch tu te toi vous eux ils tú ti usted ustedes ellos".split(),
    "VERB": "kill hurt destroy burn beat shoot attack crush töten schlagen verbrennen zerstören tuer frapper brûler détruire matar golpear quemar destruir".split(),
    "INTENT": "will shall gonna going i'll we'll werde werden wird vais vas allons vont voy vamos van".split(),
    "DEGREE": "such so total complete absolute utter real damn so'n total völlig absoluter vrai complet absolu tan verdadero completo".split(),
}
#: What the composed machine says of a word, in the order of the features.
KINDS = ("insult", "strong_insult", "targeted", "negated", "reported", "violence", "threat", "direct_threat")

Label = str


@dataclass(frozen=True)
class Transducer:
    """A letter-to-letter transducer: from a state and a label to a state and a label; other labels pass unchanged."""

    start: int
    arcs: dict[tuple[int, Label], tuple[int, Label]]

    def step(self, state: int, label: Label) -> tuple[int, Label]:
        return self.arcs.get((state, label), (state, label))


def compose(first: Transducer, second: Transducer, labels: set[Label]) -> Transducer:
    """The machine that feeds the first one's output to the second; states are pairs, numbered as they are met."""
    number = {(first.start, second.start): 0}
    arcs: dict[tuple[int, Label], tuple[int, Label]] = {}
    todo = [(first.start, second.start)]
    while todo:
        pair = todo.pop()
        for label in labels:
            a, middle = first.step(pair[0], label)
            b, out = second.step(pair[1], middle)
            if (a, b) not in number:
                number[a, b] = len(number)
                todo.append((a, b))
            arcs[number[pair], label] = (number[a, b], out)
    return Transducer(0, arcs)


#: What the words and marks of a sentence are: SLUR is a learned word, BREAK a comma, semicolon, colon or bracket.
INPUTS = ("WORD", "SLUR", "BREAK", "QUOTE", *CUES)
#: What machines make of them.
OUTPUTS = ("INSULT", "STRONG", "TARGETED", "NEGATED", "REPORTED", "VIOLENCE", "THREAT", "DIRECT")
LABELS = {*INPUTS, *OUTPUTS}


def transducer(start: str, rule: Callable[[str, int, Label], tuple[str, int, Label]]) -> Transducer:
    """The machine whose states are (name, words left); ``rule`` says where a state goes under a label, and what comes out."""
    number, todo = {(start, 0): 0}, [(start, 0)]
    arcs: dict[tuple[int, Label], tuple[int, Label]] = {}
    while todo:
        state = todo.pop()
        for label in LABELS:
            name, left, out = rule(*state, label)
            if (name, left) not in number:
                number[name, left] = len(number)
                todo.append((name, left))
            arcs[number[state], label] = (number[name, left], out)
    return Transducer(0, arcs)


def _fade(name: str, left: int) -> tuple[str, int]:
    """A word on: what was met reaches one word less."""
    return (name, left - 1) if left > 1 else ("none", 0)


def insults(name: str, left: int, label: Label) -> tuple[str, int, Label]:
    """Learned words are insults, strong ones next to a degree word or another insult."""
    if label == "SLUR":
        return "near", 1, "STRONG" if name == "near" else "INSULT"
    return ("near", 1, label) if label == "DEGREE" else ("none", 0, label)


def threats(name: str, left: int, label: Label) -> tuple[str, int, Label]:
    """Violent verbs, which are threats within the reach of an intent."""
    if label == "INTENT":
        return "intent", REACH, label
    if label == "BREAK":
        return "none", 0, label
    return *_fade(name, left), {"VERB": "THREAT" if name == "intent" else "VIOLENCE"}.get(label, label)


def negation(name: str, left: int, label: Label) -> tuple[str, int, Label]:
    """Insults, violence and threats within the reach of a negation in their clause."""
    if label == "NEG":
        return "negated", REACH, label
    if label == "BREAK":
        return "none", 0, label
    soft = name == "negated" and label in ("INSULT", "STRONG", "VIOLENCE", "THREAT")
    return *_fade(name, left), "NEGATED" if soft else label


def reported(name: str, left: int, label: Label) -> tuple[str, int, Label]:
    """What comes after a word of saying: its clause, the next one, and all that is in quotation marks after it."""
    if label == "REPORT" and name != "quoted":
        return "told", 0, label
    if label == "QUOTE":
        return ("none" if name in ("none", "quoted") else "quoted"), 0, label
    if label == "BREAK" and name != "quoted":
        return ("next" if name == "told" else "none"), 0, label
    marks = name != "none" and label in ("INSULT", "STRONG", "VIOLENCE", "THREAT")
    return name, 0, "REPORTED" if marks else label


_SHARPER = {"INSULT": "TARGETED", "STRONG": "TARGETED", "VIOLENCE": "THREAT", "THREAT": "DIRECT"}


def targets(name: str, left: int, label: Label) -> tuple[str, int, Label]:
    """A person before or after sharpens what is said: after, it is the person's word that bears the sharper mark."""
    if label == "TARGET":
        return "TARGET", REACH, _SHARPER.get(name, label)
    if label == "BREAK":
        return "none", 0, label
    if label in _SHARPER:
        return (*_fade(name, left), _SHARPER[label]) if name == "TARGET" else (label, REACH, label)
    return *_fade(name, left), label


@lru_cache(1)
def grammar() -> Transducer:
    """Insults, threats, negation, reported speech and targets, composed in this order."""
    machines = [transducer("none", rule) for rule in (insults, threats, negation, reported, targets)]
    return reduce(lambda a, b: compose(a, b, LABELS), machines)


_KIND = {out: i for i, out in enumerate(OUTPUTS)}
_SOFT = (_KIND["NEGATED"], _KIND["REPORTED"])
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
_TOKEN = re.compile(_WORD.pattern + r"|[,;:()]|[\"“”„«»]")
_MARKS = {**dict.fromkeys(",;:()", "BREAK"), **dict.fromkeys("\"“”„«»", "QUOTE")}


@dataclass
class Model:
    """Lexemes (whole words and stems) with weights, and the coefficients of the logistic function."""

    words: dict[str, float]
    stems: dict[str, float]
    coefficients: list[float] = field(default_factory=lambda: [0.0] * (len(KINDS) + 2))

    def matcher(self) -> "Matcher":
        return Matcher(self)


class Matcher:
    """Finds the sentences that hold a lexeme or a violent verb, and runs the composed machine over them."""

    def __init__(self, model: Model):
        self.model, self.machine = model, grammar()
        self.cue = {w: c for c, words in CUES.items() for w in words} | _MARKS
        self.search = ahocorasick.Automaton()
        for w in {*model.words, *model.stems, *CUES["VERB"]}:
            self.search.add_word(w, len(w))
        self.search.make_automaton()

    def weight(self, word: str) -> float:
        stems = self.model.stems
        return max(self.model.words.get(word, 0.0), *(stems.get(word[:n], 0.0) for n in STEMS if len(word) >= n), 0.0)

    def features(self, text: str) -> list[float]:
        """Weights gathered by kind, and the greatest of one clause: log-damped, so that long texts stay comparable."""
        low = text.lower()
        gathered, most, arcs = [0.0] * len(KINDS), 0.0, self.machine.arcs
        done = 0
        for end, n in self.search.iter(low):
            at = end - n + 1
            if at < done or (at and low[at - 1].isalnum()):
                continue
            start = max(low.rfind(c, done, at) for c in ".!?\n")
            sentence = _SENTENCE.match(low, start + 1 if start >= 0 else done)
            if not sentence:
                continue
            done = sentence.end()
            total, state, last = 0.0, 0, 0.0
            for m in _TOKEN.finditer(sentence[0]):
                word = m[0]
                label = self.cue.get(word)
                w = 0.0 if label else self.weight(word)
                state, out = arcs[state, "SLUR" if w else label or "WORD"]
                kind = _KIND.get(out)
                if kind is not None:
                    # a target after an insult bears the insult's weight
                    last = w or (1.0 if label == "VERB" else last)
                    gathered[kind] += last
                    total += 0.0 if kind in _SOFT else last
            most = max(most, total)
        return [math.log1p(g) for g in gathered] + [math.log1p(most)]

    def score(self, text: str) -> float:
        b = self.model.coefficients
        z = b[0] + sum(c * f for c, f in zip(b[1:], self.features(text)))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _bounded(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from pieces(batch, column, CHUNK)


def lexemes(text: str) -> set[str]:
    """Words, and beginnings of words with a star, each once."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def _marks(text: str) -> tuple[int, int]:
    """Two min-hashes of the text's word triples: copies and near-copies share at least one of them, as a rule."""
    words = _WORD.findall(text.lower())
    triples = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
    return min(xxhash.xxh3_64_intdigest(t, 1) for t in triples) >> 1, min(xxhash.xxh3_64_intdigest(t, 2) for t in triples) >> 1


def _independent(df: DataFrame, id_column: str) -> DataFrame:
    """The labelled rows without near-copies, which would count as evidence of all their words: one row (that of the
    smallest id) of each min-hash stays, for two min-hashes in turn."""
    marked = T.StructType().add(id_column, df.schema[id_column].dataType).add("_text", "string").add("label", "integer").add("m0", "long").add("m1", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _bounded(batches, "_text"):
            marks = [_marks(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64())], marked.names)

    rows = df.select(id_column, "_text", "label").mapInArrow(run, marked)
    for mark in ("m0", "m1"):
        rows = rows.groupBy(mark).agg(F.min_by(F.struct(*marked.names), id_column).alias("x")).select("x.*")
    return rows


def _counts(df: DataFrame) -> DataFrame:
    """(lexeme, toxic, clean): in how many rows of each class each lexeme is, counted in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _bounded(batches, "_text"):
            toxic, clean = Counter(), Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (toxic if label else clean).update(lexemes(text or ""))
            keys = list(toxic | clean)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], ["lexeme", "toxic", "clean"])

    rows = df.select("_text", "label").mapInArrow(run, "lexeme string, toxic long, clean long")
    return rows.groupBy("lexeme").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _featured(df: DataFrame, model: Model) -> DataFrame:
    """(label, features) of labelled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for batch in _bounded(batches, "_text"):
            rows = [matcher.features(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.list_(pa.float64()))], ["label", "features"])

    return df.select("_text", "label").mapInArrow(run, "label int, features array<double>")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Coefficients (the constant first) by Newton's method with a ridge on all but the constant."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Model:
    """Fit the lexemes and the logistic function on at most TRAIN_ROWS labelled rows.

    Rows whose label is null take no part; an id with several labels counts as toxic if most are. Without rows of both
    classes the model knows no insult and gives everything the share of toxic rows.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col(id_column).isNotNull() & F.col(label_column).isNotNull()).groupBy(id_column).agg((F.avg(F.col(label_column).cast("double")) > 0.5).cast("int").alias("label"))
    # TRAIN_ROWS rows at most, so the broadcast is bounded
    chosen = known.orderBy(F.xxhash64(id_column), id_column).limit(TRAIN_ROWS)
    labelled = docs.select(id_column, F.col(text_column).alias("_text")).join(F.broadcast(chosen), id_column)
    rows = materialize(_independent(labelled, id_column), "labelled")
    size = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    prior = math.log((bad + 0.5) / (good + 0.5)) if bad + good else -2.0
    if not bad or not good:
        return Model({}, {}, [prior] + [0.0] * (len(KINDS) + 1))
    share = bad / (bad + good)
    counted = _counts(rows).filter("toxic >= 3")
    rate = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    # the binomial deviance of the lexeme's rows against the share of toxic rows
    clean_part = F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - rate) / (1 - share))).otherwise(0.0)
    deviance = F.col("toxic") * F.log(rate / share) + clean_part
    weight = F.log((F.col("toxic") + 0.5) / (bad + 1)) - F.log((F.col("clean") + 0.5) / (good + 1))
    kept = counted.filter((rate >= RATE) & (rate > share) & (deviance > EVIDENCE)).select("lexeme", weight.alias("w"), deviance.alias("d")).filter("w > 2")
    found = {r["lexeme"]: float(r["w"]) for r in kept.orderBy(F.desc("d"), "lexeme").limit(MOST_LEXEMES).collect()}
    cues = {w for words in CUES.values() for w in words}
    model = Model({k: v for k, v in found.items() if not k.endswith("*") and k not in cues}, {k[:-1]: v for k, v in found.items() if k.endswith("*")})
    sample = _featured(rows, model).toPandas()
    x = np.stack(sample["features"].to_list())
    model.coefficients = logistic(x, sample["label"].to_numpy(float)).tolist()
    return model


def score(df: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score) for every row; null texts count as empty, which score as texts without matches do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for batch in _bounded(batches, "_text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([matcher.score(t or "") for t in batch.column(1).to_pylist()], pa.float64())], ["_id", "score"])

    schema = T.StructType().add("_id", df.schema[id_column].dataType).add("score", "double")
    return df.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text")).mapInArrow(run, schema).withColumnRenamed("_id", id_column)


def keep_clean(df: DataFrame, model: Model, text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that score below the threshold, with their columns as they are."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for batch in _bounded(batches, text_column):
            clean = [matcher.score(t or "") < threshold for t in batch.column(names.index(text_column)).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return df.mapInArrow(run, df.schema)
