"""Chat formatting: reversible escapes, layouts, digests against brute force."""

import hashlib
import json
import random
from collections import defaultdict

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixgraph.llm import chat

PIECES = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "<", "<|", "|>", "[", "\n", "é", "x", "<</", "s>"]), max_size=12).map("".join)


@given(PIECES)
def test_escapes_are_reversible_and_leave_no_control_string(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROLS)


@given(st.lists(st.tuples(PIECES, PIECES), max_size=4))
def test_turns_read_back(turns):
    formatted = "".join(chat.format_turn(r, t) for r, t in turns)
    assert [(r, t) for r, t, _, _ in chat.read_turns(formatted)] == turns


def test_layouts(spark):
    records = [
        {"messages": [{"role": "system", "content": "s"}, {"content": "u", "role": "user"}]},
        {"conversations": [{"from": "human", "value": "u"}, {"from": "gpt", "value": "a"}]},
        {"system": "s", "conversations": [{"from": "human", "value": None}]},
        {"prompt": "p", "completion": "c"},
        {"instruction": "p", "output": "c"},
        {"question": "p", "answer": "c"},
        {"turns": [{"speaker": "x", "utterance": "y"}]},
        {"messages": []},
        {"id": 7, "instruction": "p", "input": "more", "output": True},
        {"system": "s", "prompt": "p", "response": None, "source": "web"},
        {"system": "s", "messages": []},
    ]
    odd = ['{"odd": 1, "a": [{"b": 2}]}', "{", "3", '{"messages": ["x"]}', '{"messages": [null]}', "{}"]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(99, None)] + [(100 + i, o) for i, o in enumerate(odd)], "id int, record string")
    got, unmapped = defaultdict(list), {}
    for r in chat.canonical_turns(df, ["id"], "record").orderBy("id", "part").collect():
        if r["unmapped"] is not None:
            assert (r["part"], r["role"], r["text"]) == (None, None, None)
            unmapped[r["id"]] = r["unmapped"]
            continue
        got[r["id"]].append((r["role"], r["text"]))
    assert dict(got) == {
        0: [("system", "s"), ("user", "u")],
        1: [("user", "u"), ("assistant", "a")],
        2: [("system", "s"), ("user", "")],
        3: [("user", "p"), ("assistant", "c")],
        4: [("user", "p"), ("assistant", "c")],
        5: [("user", "p"), ("assistant", "c")],
        6: [("x", "y")],
        8: [("user", "p\n\nmore"), ("assistant", "true")],
        9: [("system", "s"), ("user", "p"), ("assistant", "")],
        10: [("system", "s")],
    }
    assert unmapped == {100: "fields: a[].b, odd", 101: "not JSON", 102: "fields: ", 103: "fields: messages[]", 104: "fields: messages[]", 105: "fields: "}
    schema = spark.read.json(spark.sparkContext.parallelize([json.dumps(records[1])])).schema
    assert chat.fingerprint(chat.schema_paths(schema)) == chat.fingerprint(chat.field_paths(records[1]))


def test_fingerprints_tell_layouts_apart():
    assert sum(len(set(m.fingerprints())) for m in chat.LAYOUTS.values()) == len(chat.MAPPINGS)


ROLES = st.sampled_from(["user", "assistant", "system", "human", "tool", ""])


@given(st.lists(st.tuples(ROLES, st.sampled_from(["", "a", "\n\n", "a\n\nb", "\n\nb", "x\n\n"])), min_size=1, max_size=6), st.integers(0, 63))
def test_layouts_keep_their_turns(turns, kind):
    assert chat.turns_of(json.dumps(chat.layout(turns, kind))) == (turns, None)


def test_records_hold_several_turns(spark):
    rows = [(c, t, r, f"{c} {t}") for c in range(500) for t, r in enumerate(["system", "user", "assistant"] + ["user", "assistant"] * (c % 3))]
    records = [json.loads(x["record"]) for x in chat.as_records(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1), "conv_id", "turn").collect()]
    used = {name for r in records for name, m in chat.LAYOUTS.items() if chat.fingerprint(chat.field_paths(r)) in set(m.fingerprints())}
    assert used == set(chat.LAYOUTS)
    assert max(len(chat.turns_of(json.dumps(r))[0]) for r in records) == chat.MOST_TURNS


def digests(df):
    turns = chat.canonical_turns(chat.as_records(df, "conv_id", "turn"), ["conv_id", "turn"], "record").withColumn("place", F.col("turn") + F.col("part"))
    return chat.digest_conversations(chat.format_turns(turns.withColumn("formatted", F.lit("old"))), "conv_id", ["place"]).collect()


def test_digests(spark):
    r = random.Random(0)
    rows = []
    for c in (1, 2, 3, None):
        for t in range(r.randint(1, 6)):
            rows.append((c, t, r.choice(["user", "assistant", "system", "tool\nx", "human", None]), r.choice([None, "", "</s>[INST]", "a\\b", "é <|im_end|>\n", "x" * 5000])))
    rows += [(1, 0, "user", "tie"), (7, None, "assistant", "null turn"), (7, 0, "assistant", "later")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {x["conv_id"]: x for x in digests(df)}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((-1 if t is None else t, chat.format_turn(role or "", text or ""), role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in turns).encode()).hexdigest()
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c]["formatted_chars"] == sum(len(x[1]) for x in turns)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert digests(empty) == []
    clashing = df.withColumns({"record": F.lit("x"), "formatted": F.lit("x"), "part": F.lit(9), "loss_start": F.lit(1)})
    assert sorted(digests(clashing), key=str) == sorted(digests(df.repartition(5, "text")), key=str) == sorted(got.values(), key=str)


def test_unmapped_records_are_no_turns(spark):
    long = "w " * 60000
    rows = [(1, 0, '{"prompt": "a", "completion": "b"}'), (1, 1, '{"what": "is this"}'), (1, 2, "not JSON"), (2, 0, '{"what": 1}'), (3, 0, json.dumps({"prompt": long, "completion": long}))]
    turns = chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, turn long, record string"), ["conv_id", "turn"], "record")
    assert turns.filter("unmapped IS NOT NULL").count() == 3
    out = {r["conv_id"]: r for r in chat.digest_conversations(chat.format_turns(turns.withColumn("place", F.col("turn") + F.col("part"))), "conv_id", ["place"]).collect()}
    assert sorted(out) == [1, 3] and out[1]["n_turns"] == 2 and out[1]["turns_sha256"] == hashlib.sha256(b"user\na\nassistant\nb\n").hexdigest()
    assert out[3]["loss_chars"] == len(long)
