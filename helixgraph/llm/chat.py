"""Chat formatting by schema fingerprints.

The fingerprint of a record is a hash of its sorted nested field paths. It selects a declarative mapping, which says
where turns, roles and texts lie, so that messages, shares, prompts and instructions all become canonical turns (role,
text). A template then marks the turns; control strings inside roles and texts are escaped reversibly, and the loss mask
covers the assistant's texts.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from itertools import combinations
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, pieces

#: Bytes of records or texts that a task turns into Python values at a time, or one row's.
CHUNK = 4 << 20
START, END = "<|im_start|>", "<|im_end|>"
#: Strings that templates in use give a meaning.
CONTROLS = (START, END, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>", "<pad>")
_CONTROL = re.compile("(?=" + "|".join(map(re.escape, CONTROLS)) + ").", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """No control string is left: a backslash follows the first character of each, and backslashes are doubled."""
    return _CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> str:
    """A turn in the template; line breaks in roles are escaped too."""
    return f"{START}{escape(role).replace(chr(10), chr(92) + chr(10))}\n{escape(text)}{END}\n"


_TURN = re.compile(re.escape(START) + r"((?:[^\\\n]|\\.)*)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)


def read_turns(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn of formatted text; [start, end) is where the escaped text lies."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("text outside of turns")
        out.append((unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    if at != len(formatted):
        raise ValueError("text outside of turns")
    return out


#: What the path of an empty list ends in.
EMPTY = "[0]"


def field_paths(value: Any, prefix: str = "") -> set[str]:
    """Nested field paths of a parsed record; the elements of a list share the path of the list with []."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{prefix}.{k}" if prefix else k) for k, v in value.items())) if value else {prefix}
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{prefix}[]") for v in value)) if value else {prefix + EMPTY}
    return {prefix}


def schema_paths(kind: T.DataType, prefix: str = "") -> set[str]:
    """Nested field paths of a schema, written like those of records."""
    if isinstance(kind, T.StructType):
        return set().union(*(schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name) for f in kind.fields))
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{prefix}[]")
    return {prefix}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _text(value: Any) -> str:
    """A field as text: null is empty, numbers and truth values are written as JSON writes them."""
    return value if isinstance(value, str) else "" if value is None else json.dumps(value)


class Mapping:
    """Where a layout keeps its turns: (role, fields) pairs, whose texts are joined by a blank line, then one list, whose
    elements hold role and text. Fields that are ``optional`` may be there or not; they are read if a pair names them."""

    def __init__(self, *fixed: tuple[str, tuple[str, ...]], turns: str | None = None, role: str = "", text: str = "", roles: dict[str, str] | None = None, optional: tuple[str, ...] = ("id", "source")):
        self.fixed, self.turns, self.role, self.text, self.roles, self.optional = fixed, turns, role, text, roles or {}, optional

    def fingerprints(self) -> Iterator[str]:
        """Of all records of this layout: with or without the optional fields, with an empty list or one of any length."""
        fields = {f for _, names in self.fixed for f in names} - set(self.optional)
        lists = [{f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"}, {self.turns + EMPTY}] if self.turns else [set()]
        for n in range(len(self.optional) + 1):
            for more in combinations(self.optional, n):
                yield from (fingerprint(fields | paths | set(more)) for paths in lists)

    def extract(self, record: dict) -> list[tuple[str, str]]:
        out = [(role, "\n\n".join(_text(record[f]) for f in names if f in record)) for role, names in self.fixed if any(f in record for f in names)]
        for x in record[self.turns] if self.turns else ():
            role = _text(x[self.role])
            out.append((self.roles.get(role, role), _text(x[self.text])))
        return out


SHARED = {"human": "user", "gpt": "assistant"}
SYSTEM = ("system", ("system",))
_MORE = ("id", "source", "system")
#: Declarative mappings of the known layouts.
LAYOUTS = {
    "messages": Mapping(SYSTEM, turns="messages", role="role", text="content", optional=_MORE),
    "shares": Mapping(SYSTEM, turns="conversations", role="from", text="value", roles=SHARED, optional=_MORE),
    "turns": Mapping(turns="turns", role="speaker", text="utterance"),
    "prompt": Mapping(SYSTEM, ("user", ("prompt",)), ("assistant", ("completion",)), optional=_MORE),
    "response": Mapping(SYSTEM, ("user", ("prompt",)), ("assistant", ("response",)), optional=_MORE),
    "instruction": Mapping(("user", ("instruction", "input")), ("assistant", ("output",)), optional=("id", "source", "input")),
    "question": Mapping(("user", ("question",)), ("assistant", ("answer",))),
    "prompt_only": Mapping(("user", ("prompt",))),
    "completion_only": Mapping(("assistant", ("completion",))),
    "system_only": Mapping(SYSTEM),
}
MAPPINGS = {f: m for m in LAYOUTS.values() for f in m.fingerprints()}


def turns_of(raw: str) -> tuple[list[tuple[str, str]], str | None]:
    """The turns of a JSON record, or why it has none."""
    try:
        parsed = json.loads(raw)
    except ValueError:
        return [], "not JSON"
    paths = field_paths(parsed)
    mapping = MAPPINGS.get(fingerprint(paths))
    return (mapping.extract(parsed), None) if mapping else ([], "fields: " + ", ".join(sorted(paths)))


def canonical_turns(df: DataFrame, keys: list[str], record: str) -> DataFrame:
    """(keys, part, role, text, unmapped): the turns of every JSON record, in order; part counts them in their record.

    A record of an unknown layout, or that isn't JSON, gives one row of nulls whose ``unmapped`` says which fields it has;
    in other rows it is null. A null record, or one with an empty list, has no turns; null roles and texts are empty.
    Other columns are not read. ``keys`` must not be named like the columns added.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, "_record", CHUNK)):
            rows = []
            for i, raw in enumerate(batch.column(len(keys)).to_pylist()):
                if raw is not None:
                    turns, why = turns_of(raw)
                    rows += [(i, p, r, t, None) for p, (r, t) in enumerate(turns)] if why is None else [(i, None, None, None, why)]
            where, *found = zip(*rows) if rows else ([],) * 5
            index = pa.array(where, pa.int64())
            kinds = (pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(index) for i in range(len(keys))), *(pa.array(c, k) for c, k in zip(found, kinds))], schema.names)

    schema = T.StructType([T.StructField(k, df.schema[k].dataType) for k in keys])
    schema = schema.add("part", "integer").add("role", "string").add("text", "string").add("unmapped", "string")
    return df.select(*keys, F.col(record).alias("_record")).mapInArrow(run, schema)


#: Turns of one record at most.
MOST_TURNS = 6
_SHARES = {"user": "human", "assistant": "gpt", "system": "system"}
_PAIRS = (("prompt", "completion"), ("instruction", "output"), ("question", "answer"), ("prompt", "response"))
_ONLY = {"user": "prompt", "assistant": "completion", "system": "system"}


def layout(turns: list[tuple[str, str]], kind: int) -> dict:
    """The turns in one of the layouts that can hold them, ``kind`` choosing."""
    roles = [r for r, _ in turns]
    known = all(r in _SHARES for r in roles)
    if len(turns) == 1 and known and kind % 4 == 2:
        return {_ONLY[roles[0]]: turns[0][1]}
    if roles[-2:] == ["user", "assistant"] and roles[:-2] in ([], ["system"]) and kind % 4:
        ask, answer = _PAIRS[kind // 4 % 4]
        if roles[0] == "system" and ask == "prompt":
            return {"system": turns[0][1], ask: turns[1][1], answer: turns[2][1]}
        if len(roles) == 2:
            first, blank, rest = turns[0][1].partition("\n\n")
            split = ask == "instruction" and blank
            return {ask: first, "input": rest, answer: turns[1][1]} if split else {ask: turns[0][1], answer: turns[1][1]}
    if kind % 4 == 3:
        return {"turns": [{"speaker": r, "utterance": t} for r, t in turns]}
    fixed = {"system": turns[0][1]} if roles[0] == "system" and len(turns) > 1 and kind // 4 % 2 else {}
    rest = turns[len(fixed):]
    if known and kind % 4 == 1:
        return fixed | {"conversations": [{"from": _SHARES[r], "value": t} for r, t in rest]}
    return fixed | {"messages": [{"role": r, "content": t} for r, t in rest]}


def as_records(df: DataFrame, conversation: str, turn: str) -> DataFrame:
    """(conversation, turn, record): rows (conversation, turn, role, text) as JSON records of all layouts, pairs and lists
    included; turn is that of a record's first row.

    Rows that lie one after another in the table and have turns one after another make a record, MOST_TURNS at most, so
    nothing is shuffled or gathered: the place of a text is its record's turn and its part in the record, whatever rows
    share a record. Null roles and texts are empty; a row whose turn is null stays alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, "_text", CHUNK)):
            starts, records, turns = [], [], []
            most = kind = 0
            before = None
            keys, numbers, roles, texts = (c.to_pylist() for c in batch.columns)
            for i, (key, number, role, text) in enumerate(zip(keys, numbers, roles, texts)):
                follows = number is not None and before == (key, number - 1) and len(turns) < most
                if turns and not follows:
                    records.append(json.dumps(layout(turns, kind), ensure_ascii=False))
                if not follows:
                    starts.append(i)
                    turns, kind = [], zlib.crc32(f"{key} {number}".encode())
                    most = 1 + kind // 16 % MOST_TURNS
                turns.append((role or "", text or ""))
                before = (key, number)
            if turns:
                records.append(json.dumps(layout(turns, kind), ensure_ascii=False))
            index = pa.array(starts, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), pa.array(records, pa.string())], schema.names)

    schema = T.StructType().add(conversation, df.schema[conversation].dataType).add(turn, "long").add("record", "string")
    return df.select(conversation, F.col(turn).cast("long"), F.col("role").alias("_role"), F.col("text").alias("_text")).mapInArrow(run, schema)


def format_turns(df: DataFrame) -> DataFrame:
    """Add ``formatted``, the turn in the template, and ``loss_start`` and ``loss_end``, the part of it under the loss mask
    (null for turns of other roles than the assistant). Columns of these names are replaced; others stay. Rows that stand for
    records of unknown layout (``unmapped`` says why) hold no turn and are left out."""
    df = df.drop("formatted", "loss_start", "loss_end")
    if "unmapped" in df.columns:
        df = df.filter(F.col("unmapped").isNull())
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, "text", CHUNK)):
            out, start, end = [], [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                turn = format_turn(role or "", text or "")
                out.append(turn)
                mask = (role == "assistant") or None
                end.append(mask and len(turn) - len(END) - 1)
                start.append(mask and end[-1] - len(escape(text or "")))
            rest = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(out, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], schema.names)

    schema = T.StructType(list(df.schema.fields)).add("formatted", "string").add("loss_start", "long").add("loss_end", "long")
    return df.mapInArrow(run, schema)


def digest_conversations(df: DataFrame, conversation: str, order: list[str]) -> DataFrame:
    """(conversation, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from ``formatted``.

    A task streams through its conversations in order and holds the state of two digests, so that one conversation may
    hold any share of the rows. Rows equal in ``order`` are ordered by their turns in the template.
    """
    kind = df.schema[conversation].dataType
    rows = df.select(F.col(conversation).alias("_key"), *order, "formatted", "loss_start", "loss_end").repartition(partitions(df.sparkSession), "_key").sortWithinPartitions("_key", *order, "formatted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: Any = None
        state: list | None = None

        def done() -> pa.RecordBatch:
            n, turns, chars, loss, formatted = state
            values = [key, n, turns.hexdigest(), chars, loss.hexdigest(), formatted]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], schema.names)

        types = None
        for batch in (piece for whole in batches for piece in pieces(whole, "formatted", CHUNK)):
            types = types or [batch.schema.field("_key").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            cols = (batch.column(c).to_pylist() for c in ("_key", "formatted", "loss_start", "loss_end"))
            for k, formatted, start, end in zip(*cols):
                if state is None or k != key:
                    if state:
                        yield done()
                    key, state = k, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, a, b in read_turns(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    masked = unescape(formatted[start:end])
                    state[2] += len(masked)
                    state[3].update(masked.encode())
                state[4] += len(formatted)
        if state:
            yield done()

    schema = T.StructType().add("_key", kind).add("n_turns", "long").add("turns_sha256", "string").add("loss_chars", "long").add("loss_sha256", "string").add("formatted_chars", "long")
    return rows.mapInArrow(run, schema).withColumnRenamed("_key", conversation)
