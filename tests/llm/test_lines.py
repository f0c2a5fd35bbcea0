"""Unit dedup against brute force."""

import random
import re

import pytest

from helixgraph.llm import lines


def split(text, level):
    if level == "line":
        return re.findall(r"[^\n]*\n|[^\n]+", text)
    out, unit = [], ""
    for token in re.findall(r"\n|[.!?]+[ \t]+|[。！？]+[ \t]*|.", text):
        unit += token
        if token == "\n" or re.fullmatch(r"[.!?]+[ \t]+|[。！？]+[ \t]*", token):
            out.append(unit)
            unit = ""
    return out + [unit] * bool(unit)


def brute(rows, level):
    seen, out = set(), []
    for d, text in sorted(rows, key=lambda x: x[0]):
        kept, longest, now = [], 0, 0
        for unit in split(text or "", level):
            form = tuple(unit.lower().encode().split())
            if form and form in seen:
                now += len(form)
                longest = max(longest, now)
                continue
            seen.add(form)
            kept.append(unit)
            now = 0
        out.append((d, "".join(kept), longest))
    return sorted(out)


@pytest.mark.parametrize("level", ["line", "sentence"])
def test_matches_brute_force(spark, level):
    r = random.Random(2)
    pool = [" ".join(r.choices(["Aé", "b", "C", "dd.", "e!? ", "f。"], k=r.randint(1, 9))) for _ in range(25)]
    rows = [(i, "\n".join(r.choice(pool) + " " * r.randint(0, 2) for _ in range(r.randint(0, 12)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "x y z w. \n" * 2000), (104, "�. �"), (105, "。。 x"), (106, "... ")]
    df = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, kept string")
    out = lines.remove_repeated_units(df, "doc_id", "text", (level,)).collect()
    assert sorted((r["doc_id"], r["kept"], r["longest_words"]) for r in out) == brute(rows, level)
    texts = dict(rows)
    for r in out:
        raw = (texts[r["doc_id"]] or "").encode()
        assert b"".join(raw[u["start"] : u["end"]] for u in r["kept_units"]).decode() == r["kept"]
        assert r["n_removed"] == sum(u["end"] - u["start"] for u in r["removed"]) == len(raw) - len(r["kept"].encode())
    left = [tuple(u.lower().split()) for r in out for u in split(r["kept"], level) if u.strip()]
    assert len(left) == len(set(left))


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (None, "one two three"), (2, "ONE  two three\nrest")], "doc_id long, text string")
    out = lines.remove_repeated_units(df, "doc_id", "text").collect()
    assert sorted((r["doc_id"] or 0, r["kept"]) for r in out) == [(0, "one two three"), (1, ""), (1, ""), (2, "rest")]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lines.remove_repeated_units(empty, "doc_id", "text").collect() == []


def test_paragraphs(spark):
    raw = b"a\nb\n\nc\n \n\nd"
    spans = lines.units(raw, "paragraph")
    assert [raw[a:b] for a, b in spans] == [b"a\nb\n\n", b"c\n \n\n", b"d"]
    df = spark.createDataFrame([(1, "a b\nc\n\nd"), (2, "x\n\nA  b C"), (3, "a b\nc d")], "doc_id long, text string")
    out = lines.remove_repeated_units(df, "doc_id", "text", ("paragraph",)).collect()
    assert sorted((r["doc_id"], r["kept"]) for r in out) == [(1, "a b\nc\n\nd"), (2, "x\n\n"), (3, "a b\nc d")]


def both(rows):
    """Paragraphs first; lines of those that stay."""
    seen, stay, out = set(), {}, []
    for d, text in sorted(rows):
        stay[d] = []
        for p in re.findall(r"(?s).*?\n(?:[ \t]*\n)+|.+", text or ""):
            form = tuple(p.lower().split())
            if not form or form not in seen:
                stay[d].append(p)
            seen.add(form)
    seen = set()
    for d in sorted(stay):
        kept = ""
        for line in (x for p in stay[d] for x in split(p, "line")):
            form = tuple(line.lower().split())
            if not form or form not in seen:
                kept += line
            seen.add(form)
        out.append((d, kept))
    return out


def test_paragraphs_then_lines(spark):
    r = random.Random(7)
    pool = [" ".join(r.choices(["a", "B", "c", "d"], k=r.randint(1, 4))) for _ in range(15)]
    rows = [(i, "".join(r.choice(pool) + r.choice(["\n", "\n", "\n\n", "\n \n\n", " "]) for _ in range(r.randint(0, 14)))) for i in range(60)]
    rows += [(100, "new one\nb two\n\nlast"), (101, "new\none b two\n\nend"), (102, "one b two\n")]
    df = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, gone string")
    out = lines.remove_repeated_units(df, "doc_id", "text").collect()
    assert sorted((x["doc_id"], x["kept"]) for x in out) == both(rows)
    texts = dict(rows)
    for x in out:
        raw = texts[x["doc_id"]].encode()
        assert b"".join(raw[u["start"] : u["end"]] for u in x["kept_units"]).decode() == x["kept"]
        assert x["n_removed"] == sum(u["end"] - u["start"] for u in x["removed"]) == len(raw) - len(x["kept"])
    assert {x["doc_id"]: x["kept"] for x in out}[101] == "end"  # the same words in other lines are the same paragraph
