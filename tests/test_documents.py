"""JSON documents in pieces: any layout of white space, strings that look like structure, small splits, files cut short."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException

from helixgraph.sources import documents, readers

TEXTS = st.text(alphabet=st.sampled_from(list('ab"\\{}[],: \né')), max_size=6)
VALUES = st.recursive(TEXTS | st.integers(-9, 9) | st.none() | st.booleans(), lambda v: st.lists(v, max_size=2) | st.dictionaries(TEXTS, v, max_size=2), max_leaves=5)
RECORDS = st.lists(st.dictionaries(TEXTS, VALUES, max_size=3), max_size=6)


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(lists=st.lists(st.tuples(RECORDS, st.sampled_from([None, 1]), st.booleans()), min_size=8, max_size=12))
def test_any_document_comes_back(spark, small_splits, tmp_path_factory, lists):
    folder = tmp_path_factory.mktemp("lists")
    for i, (records, indent, named) in enumerate(lists):
        meta = {"n": 1, "words": ["a", "]"], "meta": {"x": {"y": [{"z": 1}]}}, "other": [{"q": 1}], "questions": records, "more": [{"r": 2}]}
        (folder / f"{i}.json").write_text(json.dumps(meta if named else records, indent=indent, ensure_ascii=False))
    rows = documents.question_records(spark, str(folder)).selectExpr("file", "n", "to_json(record) AS text").collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["n"]):
        got.setdefault(int(r["file"].rsplit("/", 1)[1][:-5]), []).append(json.loads(r["text"]))
    assert got == {i: records for i, (records, _, _) in enumerate(lists) if records}


def test_a_file_in_many_splits(spark, small_splits, tmp_path):
    cache = {f'gene "{i}" {{': {"start": i, "note": "} , {" * (i % 5), "also": {"deep": [{"x": i}]}} for i in range(60)}
    (tmp_path / "cache.json").write_text(json.dumps(cache))
    rows = documents.cache_records(spark, str(tmp_path / "cache.json"), "gene")
    assert documents.json_objects(spark, str(tmp_path / "cache.json")).count() == 60
    assert {r["gene"]: json.loads(r["t"]) for r in rows.selectExpr("gene", "to_json(record) AS t").collect()} == cache


def test_empty_repeated_and_cut(spark, tmp_path):
    for name, text in {"empty": "", "blank": " \n", "none": "[]", "named": '{"questions": []}', "twice": '[{"a": 1}, {"a": 1}]'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    rows = documents.question_records(spark, str(tmp_path))
    assert [r["n"] for r in rows.orderBy("n").collect()] == [0, 1]
    (tmp_path / "cut.json").write_text('[{"a": 1}, {"a": 2')
    with pytest.raises(PySparkException, match="ends amid its brackets"):
        documents.question_records(spark, str(tmp_path)).selectExpr("to_json(record)").collect()


def test_keys_and_schema(spark, tmp_path):
    (tmp_path / "q.json").write_text('[{"question": "a", "options": ["x"]}, {"question": 7, "new": {"k": 1}}]')
    records = documents.question_records(spark, str(tmp_path))
    assert sorted(tuple(r) for r in documents.keys_of(records, "n").select("n", "key").collect()) == [(0, "options"), (0, "question"), (1, "new"), (1, "question")]
    assert "new" in documents.schema_of(records)
    rows = {r["question"]: r for r in documents.typed(records, readers.QUESTION_SCHEMA).collect()}
    assert rows["a"]["options"] == ["x"] and rows["7"]["cypher"] is None


def test_written_lists_are_documents(spark, tmp_path):
    df = spark.range(100, numPartitions=3).selectExpr("id", "if(id % 2 = 0, id, null) AS even")
    documents.write_json_lists(df, str(tmp_path / "out"), "questions")
    parts = [json.loads(p.read_text()) for p in (tmp_path / "out").glob("part-*")]
    assert sorted(r["id"] for p in parts for r in p["questions"]) == list(range(100))
    assert documents.question_records(spark, str(tmp_path / "out")).count() == 100
    documents.write_json_lists(df.filter("id < 0").coalesce(1), str(tmp_path / "nothing"))
    assert documents.question_records(spark, str(tmp_path / "nothing")).count() == 0


def test_a_failed_writer_leaves_no_document(spark, tmp_path):
    bad = spark.range(100, numPartitions=4).selectExpr("if(id = 99, raise_error('lost'), id) AS id")
    with pytest.raises(PySparkException):
        documents.write_json_lists(bad, str(tmp_path / "out"))
    assert not list((tmp_path / "out").glob("part-*")) and not (tmp_path / "out" / "_SUCCESS").exists()
