"""Calls to models by the offline stand-in, and streams."""

from __future__ import annotations

import sys

import numpy as np
from pyspark.sql import functions as F

from querygrove.functions.text import ABSTENTION, level_suffix, run_name
from querygrove.operators import calibrate, linking, measures, models
from querygrove.streaming import windows

from .conftest import DATA


class Broken:
    name = "broken"

    def generate(self, prompt, as_json=False, most_tokens=None):
        raise OSError("down")


def test_mentions_are_extracted(spark):
    q = spark.createDataFrame([("q1", "Does Brand#12 bind P53 ?"), ("q2", "nothing")], "question string, body string")
    got = linking.mentions(models.extract(q, models.StubModel()), "answer")
    assert {(r["question"], r["text"]) for r in got.collect()} == {("q1", "Brand#12"), ("q1", "P53")}


def test_failed_calls_have_a_code(spark):
    q = spark.createDataFrame([("q1", "x")], "question string, body string")
    assert models.ask(q, "body", Broken(), retries=1).first()["code"] == 1


def test_answers_abstain_without_reports(spark):
    q = spark.createDataFrame([("q1", "k1", "which protein interacts"), ("q2", "none", "anything")], "question string, key string, body string")
    r = spark.createDataFrame([("k1", "The protein A interacts with B."), ("k1", "Nothing here")], "key string, report string")
    got = {x["question"]: x["answer"] for x in models.global_answers(q, r, models.StubModel()).collect()}
    assert "protein A" in got["q1"] and got["q2"] == ABSTENTION


def test_settings_without_reports():
    assert "community_prop: 0.0" in models.settings("m", "e", with_reports=False)
    assert "create_community_reports" in models.settings("m", "e")


def test_windows_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema.fields)
    stream = windows.windowed(windows.read_events(spark, str(tmp_path / "in"), schema), "1 day")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").start.alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert {(r["start"], r["event_type"], r["n"]) for r in spark.table("w").collect()} == {tuple(r) for r in want.collect()}


def test_resumed_work_runs_once(spark, tmp_path):
    work = str(tmp_path / "work")
    run = lambda df: df.select("event_id", F.lit(1).alias("done"))
    for k in range(2):
        spark.range(4 * (k + 1)).select(F.col("id").alias("event_id")).coalesce(1).write.mode("append").parquet(work)
        windows.resume_into(spark.readStream.schema("event_id long").parquet(work), str(tmp_path / "done"), ["event_id"], run, str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "done")).collect()) == list(range(8))


def test_local_answers_read_what_is_named(spark):
    q = spark.createDataFrame([("q1", "k", "what does TP53 bind?"), ("q2", "k", "anything else?")], "question string, key string, body string")
    e = spark.createDataFrame([("k", "1", "TP53", "Gene TP53."), ("k", "2", "BRCA1", "Gene BRCA1.")], "key string, id string, title string, description string")
    u = spark.createDataFrame([("k", "1", "TP53 binds MDM2.")], "key string, id string, text string")
    r = spark.createDataFrame([("k", "a report")], "key string, report string")
    got = {x["question"]: x["answer"] for x in models.local_answers(q, e, u, r, models.StubModel()).collect()}
    assert "TP53 binds MDM2." in got["q1"] and "BRCA1" not in got["q1"] and got["q2"] == ABSTENTION


def test_subgraphs_without_edges_abstain(spark):
    todo = spark.createDataFrame([("q1", "k1", "a", "x"), ("q2", "k2", "a", "y")], "question string, key string, configuration string, body string")
    edges = spark.createDataFrame([("k1",)], "key string")
    say = lambda df: df.select("question", "configuration", F.lit("said").alias("answer"), F.lit(0).alias("code"))
    assert {(r["question"], r["answer"], r["empty"]) for r in models.respond(todo, edges, say).collect()} == {("q1", "said", False), ("q2", ABSTENTION, True)}


def test_a_query_without_an_answer_fails():
    quiet, loud = [sys.executable, "-c", ""], [sys.executable, "-c", "print('yes')"]
    assert models.run_tool(quiet, answers=True)["code"] == 1 and models.run_tool(quiet, answers=False)["code"] == 0
    assert models.run_tool(loud, answers=True)["answer"] == "yes"
    assert models.run_tool([sys.executable, "-c", "raise SystemExit(3)"], answers=True)["code"] == 3


def test_prompts_follow_the_form():
    assert models.reduce_prompt("exacta_list", "usual").startswith("Take") and models.FORMS["prosa"] in models.reduce_prompt("prosa", "usual")
    assert models.reduce_prompt("exacta_list", "usual", "own") == "own"
    assert "LLM: verify" in models.task_prompt("yesno", True) and "LLM: verify" not in models.task_prompt("yesno", False)


def test_linking_costs(spark):
    q = spark.createDataFrame([("q1", "Does P53 bind ?"), ("q2", "nothing")], "question string, body string")
    want = spark.createDataFrame([("q1", "Gene", "other")], "question string, label string, id string")
    link = lambda said: linking.mentions(said, "answer").select("question", F.lit("Gene").alias("label"), F.col("text").alias("id"))
    got, seconds = models.linking_costs(q, models.StubModel(), link, want)
    assert {(r["question"], r["same"]) for r in got.collect()} == {("q1", False), ("q2", True)} and seconds > 0


class Lengths:
    measures = ("length", "n")

    def score(self, answer, references):
        return {"length": float(len(answer)), "n": float(len(references))}


def test_judges_skip_abstentions(spark):
    a = spark.createDataFrame([("q1", "abc", False, ["x", "y"]), ("q2", "abcd", True, ["x"])], "question string, answer string, abstains boolean, references array<string>")
    assert {(r["question"], r["length"], r["n"]) for r in models.judged(a, Lengths()).collect()} == {("q1", 3.0, 2.0), ("q2", 0.0, 0.0)}


def test_project_is_written(spark, tmp_path):
    models.write_project(str(tmp_path), models.settings("m", "e"), {"entities": spark.range(3), "text_units": spark.range(2)})
    assert spark.read.parquet(str(tmp_path / "output" / "entities.parquet")).count() == 3
    assert "cluster_graph" in "\n".join(r[0] for r in spark.read.text(str(tmp_path / "settings.yaml")).collect())


def test_run_names():
    assert run_name(250, 200, 400, 5000, 20, True) == "reportes250_map200_respuesta400_lotes5000_comunidades20_texto"
    assert level_suffix(1, 1) == "" and level_suffix(2, 1) == "_nivel2"


def test_evaluation_from_responses_to_tables(spark, tmp_path):
    rows = [(q, c, r) for q in "abcd" for c in ("alone", "graph") for r in range(2) if (q, c) != ("d", "graph")]
    said = spark.createDataFrame(rows, "question string, configuration string, rep int")
    value = {(q, c, r): (ord(q) - 97) / 4 + (0.5 if c == "graph" else 0) + r / 10 for q, c, r in rows}
    measured = spark.createDataFrame([(*k, v) for k, v in value.items()], "question string, configuration string, rep int, f1 double")
    m, tables = measures.evaluate(said, measured, ["f1"], 2, ["alone"], str(tmp_path))
    got = {r["configuration"]: r for r in tables["f1"].collect()}
    assert m.count() == len(rows) and got["graph"]["questions"] == 3  # d lacks a configuration
    assert np.isclose(got["graph"]["difference"], 0.5) and np.isclose(got["graph"]["low"], 0.5) and np.isclose(got["graph"]["high"], 0.5)
    assert spark.read.option("header", True).csv(str(tmp_path / "comparison_f1")).count() == 2


def test_intervals_of_differences(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 1, 30), rng.normal(1, 1, 30)
    means = spark.createDataFrame([(i, c, float(x[i])) for c, x in (("a", a), ("b", b)) for i in range(30)], "question int, configuration string, value double")
    row = measures.compare_intervals(means, ["a"], draws=1000).where("configuration = 'b'").first()
    d = np.sort(b - a)
    draws = [d[i].mean() for i in np.random.default_rng(42).integers(0, 30, (500, 30))]
    assert row["low"] < d.mean() < row["high"] and abs(row["low"] - np.percentile(draws, 2.5)) < 0.1


def test_plan_names_what_it_leaves_out(spark):
    rows = [("big", f"e{i:03}", 2 + i % 40) for i in range(60)] + [("small", f"e{i}", 5) for i in range(4)] + [("big", "huge", 900)]
    p = calibrate.plan(spark.createDataFrame(rows, "cell string, entity string, n_seeds int"), spark.createDataFrame([("big", 1000), ("small", 1000)], "cell string, population int"), least=2, n_per_bin=5)
    assert p["cases"].groupBy("cell", "bin").count().collect() and p["cases"].count() == 15
    assert [r["cell"] for r in p["too_few"].collect()] == ["small"] and [r["entity"] for r in p["without_controls"].collect()] == ["huge"]
    assert [r["eligible"] for r in p["cells"].collect()] == [60]
