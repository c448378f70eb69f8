"""Readers, sinks and streams on files."""

from __future__ import annotations

import gzip
import json

from pyspark.sql import functions as F

from querygrove.operators import measures, units
from querygrove.sources import io
from querygrove.functions import text as X


def test_text_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n007,"x, ""y"""\n')
    assert io.csv(spark, str(tmp_path / "a.csv")).first().asDict() == {"id": "007", "name": 'x, "y"'}
    with gzip.open(tmp_path / "a.tab.gz", "wt") as f:
        f.write("p\tq\tr\n")
    assert io.tsv(spark, str(tmp_path / "a.tab.gz"), {0: "a", 2: "c"}).first().asDict() == {"a": "p", "c": "r"}
    (tmp_path / "q.json").write_text(json.dumps({"questions": [{"id": "1", "body": "b"}, {"id": "2", "body": "c"}]}))
    assert io.questions(spark, str(tmp_path / "q.json")).count() == 2


def test_last_line_of_a_key_counts(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"k":"a","v":1}\n{"k":"b","v":2}\n{"k":"a","v":3}\n')
    got = io.json_lines(spark, str(tmp_path / "e.jsonl"), "k string, v long", "k")
    assert {r["k"]: r["v"] for r in got.collect()} == {"a": 3, "b": 2}


def test_logs_and_caches(spark, tmp_path):
    (tmp_path / "x.log").write_text('Metrics: {\n "calls": 1\n}\nMetrics: {\n "calls": 7,\n "prompt_tokens": 12,\n "completion_tokens": 3\n}\nend')
    r = io.log_usage(spark, str(tmp_path / "*.log"), "Metrics:").first()
    assert (r["calls"], r["prompt_tokens"], r["completion_tokens"]) == (7, 12, 3)
    for i in range(3):
        (tmp_path / f"c{i}.json").write_text(json.dumps({"result": {"usage": {"prompt_tokens": i, "completion_tokens": 1}}}))
    assert tuple(io.cache_usage(spark, str(tmp_path / "c*.json")).first()) == (3, 3, 3)


def test_responses_by_path(spark, tmp_path):
    for q, code in (("q1", 0), ("q2", 1)):
        (tmp_path / q).mkdir()
        (tmp_path / q / "r.json").write_text(json.dumps({"answer": "x", "code": code}))
    got = io.responses(spark, str(tmp_path / "*" / "r.json"), "answer string, code int", r"/([^/]+)/r\.json$", {"question": 1})
    assert [r["question"] for r in got.collect()] == ["q1"]


def test_read_through_makes_once(spark, tmp_path):
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    for _ in range(2):
        assert io.read_through(spark, str(tmp_path / "t"), make).count() == 3
    assert len(calls) == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"])], "k string, v array<string>")
    for form in ("csv", "json", "parquet"):
        io.write(df, str(tmp_path / form), form)
    assert io.csv(spark, str(tmp_path / "csv")).first()["v"] == "x|y"
    assert spark.read.json(str(tmp_path / "json")).first()["v"] == ["x", "y"]


def test_shortened(spark):
    df = spark.createDataFrame([("One two. Three four five. Six.",), ("a b c d e f",), (None,)], "t string")
    assert [r[0] for r in df.select(X.shortened(F.col("t"), 3)).collect()] == ["One two.", "a b c", None]


def test_normalised_drops_what_isnt_ascii(spark):
    df = spark.createDataFrame([("Éøa-B",), (None,)], "t string")
    assert [r[0] for r in df.select(X.normalised("t")).collect()] == ["ea b", None]


def test_titles_of_equal_names(spark):
    n = spark.createDataFrame([("Gene", "1", "x"), ("Gene", "2", "X"), ("Drug", "3", "x"), ("Drug", "4", "y")], "label string, id string, name string")
    assert {r["id"]: r["title"] for r in units.titles(n).collect()} == {"1": "X (GENE) [1]", "2": "X (GENE) [2]", "3": "X (DRUG)", "4": "Y"}


def test_bootstrap_is_the_same_again(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(20)], "c string, v double")
    a, b = (measures.bootstrap(df, ["c"], "v", 500).first() for _ in range(2))
    assert a == b and a["low"] < a["mean"] < a["high"]


def test_gold_of_questions_is_nested(spark, tmp_path):
    q = [{"id": "1", "type": "factoid", "exact_answer": ["a", "b"]}, {"id": "2", "type": "list", "exact_answer": [["a"], ["b", "c"]]}, {"id": "3", "type": "yesno", "exact_answer": "yes"}, {"id": "4", "type": "summary"}]
    (tmp_path / "q.json").write_text(json.dumps({"questions": q}))
    got = {r["id"]: r["gold_items"] for r in io.questions(spark, str(tmp_path / "q.json")).collect()}
    assert got == {"1": [["a", "b"]], "2": [["a"], ["b", "c"]], "3": None, "4": None}


def test_abstentions_are_marked(spark, tmp_path):
    for k, a in (("a", "yes"), ("b", "I can't say"), ("c", None)):
        (tmp_path / k).mkdir()
        (tmp_path / k / "r.json").write_text(json.dumps({"answer": a, "code": 0}))
    got = io.responses(spark, str(tmp_path / "*" / "r.json"), "answer string, code int", r"/([^/]+)/r\.json$", {"question": 1}, abstention="can't say")
    assert {r["question"]: r["abstains"] for r in got.collect()} == {"a": False, "b": True, "c": False}


def test_cells_are_pruned(spark, tmp_path):
    io.write(spark.createDataFrame([("x", 1), ("y", 2), ("y", 3)], "cell string, n int"), str(tmp_path / "t"), partition=["cell"])
    assert {r["n"] for r in io.cells(spark, str(tmp_path / "t"), only=["y"]).collect()} == {2, 3}
    assert io.cells(spark, str(tmp_path / "t")).count() == 3


def test_static_index_cost(spark, tmp_path):
    (tmp_path / "index.json").write_text('{"seconds_total": 12.5}')
    (tmp_path / "log.txt").write_text('x\nMETRICS\n{\n "calls": 3, "prompt_tokens": 10, "completion_tokens": 4\n}\n')
    assert io.static_index(spark, str(tmp_path / "index.json"), str(tmp_path / "log.txt"), "METRICS").collect() == [(12.5, 3, 14)]
