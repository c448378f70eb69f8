"""Language models behind an interface: mention extraction, map and reduce answers, index settings.

Models are outside services. Whatever has `generate` serves; the offline stand-in answers from the
prompt by fixed rules, so that all that surrounds the calls can be run and tested.
"""

from __future__ import annotations

import json
import re
import subprocess
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import ABSTENTION
from ..storage import materialise
from .linking import same_sets

#: Temperature and seed of every call.
TEMPERATURE, SEED = 0, 42


#: What an answer has to look like, by the form's name.
FORMS = {
    "prosa": "Several paragraphs of prose.",
    "lista": "Nothing but names that answer, the likeliest on top, each on its own line, with neither introduction nor comment.",
    "lista_anterior": "Names that answer, each on its own line, without comment.",
    "exacta_factoid": "At most five names that answer, from the surest down, each on its own line in its shortest usual form and only once; no other words. If there is none: None",
    "exacta_list": "Every name that answers and no other, each on its own line in its shortest usual form and only once; no other words. If there is none: None",
}
#: The form, and what the last call is told, for each kind of question.
TASKS = {
    "factoid": FORMS["exacta_factoid"],
    "list": FORMS["exacta_list"],
    "yesno": "One word in lower case, yes or no, even when unsure.",
    "summary": "One plain paragraph of 200 words or fewer with what matters most.",
}
MARKED = " Mark what the reports don't say with [LLM: verify]."


def task_prompt(task: str, with_graph: bool) -> str:
    """What a question of a kind asks for: with a graph, knowledge from elsewhere has to be marked."""
    return TASKS[task] + (MARKED if with_graph else "")


def reduce_prompt(form: str, usual: str, own: str | None = None) -> str:
    """The last call's prompt: the caller's own if given, else the form's for exact answers, which the
    usual prompt's prose would contradict, else the usual one."""
    if own is not None:
        return own
    return f"Take the names that answer from the points.\n{FORMS[form]}" if form.startswith("exacta") else f"{usual}\n{FORMS[form]}"


class Model(Protocol):
    name: str

    def generate(self, prompt: str, as_json: bool = False, most_tokens: int | None = None) -> dict: ...


@dataclass(frozen=True)
class HttpModel:
    """A model behind an HTTP endpoint that takes a prompt and gives back a whole answer."""

    name: str
    url: str
    timeout: float = 600

    def generate(self, prompt: str, as_json: bool = False, most_tokens: int | None = None) -> dict:
        options = {"temperature": TEMPERATURE, "seed": SEED} | ({"num_predict": most_tokens} if most_tokens else {})
        body = {"model": self.name, "prompt": prompt, "stream": False, "options": options} | ({"format": "json"} if as_json else {})
        request = urllib.request.Request(f"{self.url}/api/generate", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as r:
            got = json.load(r)
        return {"text": got["response"], "prompt_tokens": got.get("prompt_eval_count", 0), "completion_tokens": got.get("eval_count", 0)}


@dataclass(frozen=True)
class StubModel:
    """Names in capitals are mentions of genes, reports that share a word with the question score, and
    an answer repeats the best points."""

    name: str = "stub"

    def generate(self, prompt: str, as_json: bool = False, most_tokens: int | None = None) -> dict:
        question = prompt.rpartition("Question: ")[2].strip()
        if as_json and "menciones" in prompt:
            names = dict.fromkeys(re.findall(r"\b[A-Z][A-Za-z0-9#]*[0-9][A-Za-z0-9#]*\b", question))
            text = json.dumps({"menciones": [{"texto": n, "tipo": "Gene", "nombre_en_ingles": n} for n in names]})
        elif as_json:
            report = prompt.partition("Report: ")[2].partition("\n")[0]
            shared = set(re.findall(r"\w{4,}", question.lower())) & set(re.findall(r"\w{4,}", report.lower()))
            text = json.dumps({"points": [{"description": report[:200], "score": min(100, 20 * len(shared))}]})
        else:
            points = re.findall(r"^- (.*)$", prompt, re.M)
            text = "\n".join(points[:5]) or ABSTENTION
        words = lambda s: len(s.split())
        return {"text": text, "prompt_tokens": words(prompt), "completion_tokens": words(text)}


_CALL = "answer string, code int, prompt_tokens long, completion_tokens long, seconds double"


def ask(df: DataFrame, prompt: str, model: Model, as_json: bool = False, retries: int = 3, most_tokens: int | None = None) -> DataFrame:
    """df with the model's answer to a prompt column, side by side over partitions; a call that fails
    on every try has code 1 and no answer."""
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p in pdf[prompt]:
                began, got = time.perf_counter(), None
                for k in range(retries):
                    try:
                        got = model.generate(p, as_json, most_tokens)
                        break
                    except (OSError, ValueError, KeyError):
                        time.sleep(min(2**k, 30) if k < retries - 1 else 0)
                rows.append((got["text"], 0, got["prompt_tokens"], got["completion_tokens"], time.perf_counter() - began) if got else (None, 1, 0, 0, time.perf_counter() - began))
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(rows, columns=[c.split()[0] for c in _CALL.split(", ")])], axis=1)[[*names, *(c.split()[0] for c in _CALL.split(", "))]]

    return df.mapInPandas(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, {_CALL}")


def extract(questions: DataFrame, model: Model, template: str = 'Give the mentions as {"menciones": [...]}.\nQuestion: ') -> DataFrame:
    """questions(question, body) with the mentions in answer."""
    return ask(questions.withColumn("prompt", F.concat(F.lit(template), "body")), "prompt", model, as_json=True).drop("prompt")


def global_answers(questions: DataFrame, reports: DataFrame, model: Model, form: str = "", general_knowledge: bool = False) -> DataFrame:
    """Map and reduce: points from every report, best first, then one answer for each question.

    questions(question, key, body) read the reports(key, report) of their subgraph. A question
    without reports, or without a point that scores, gets the abstention.
    """
    mapped = questions.join(reports, "key").withColumn("prompt", F.concat(F.lit("Score what helps.\nReport: "), F.regexp_replace("report", r"\s+", " "), F.lit("\nQuestion: "), "body"))
    points = ask(mapped, "prompt", model, as_json=True)
    got = F.explode(F.from_json("answer", "points array<struct<description:string,score:int>>")["points"])
    points = points.where("code = 0").select("question", "prompt_tokens", "completion_tokens", got.alias("p")).where("p.score > 0")
    best = points.groupBy("question").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("p.score")).alias("s"), F.col("p.description").alias("d")))), 1, 20).alias("best"))
    say = "You may add general knowledge and mark it.\n" if general_knowledge else ""
    text = F.concat(F.lit(say + form + "\n"), F.array_join(F.transform("best", lambda x: F.concat(F.lit("- "), x["d"])), "\n"), F.lit("\nQuestion: "), "body")
    reduced = ask(questions.join(best, "question").select("question", "body", text.alias("prompt")), "prompt", model)
    out = questions.join(reduced.drop("body", "prompt"), "question", "left")
    return out.select("question", F.coalesce("answer", F.lit(ABSTENTION)).alias("answer"), F.coalesce("code", F.lit(0)).alias("code"), F.coalesce("prompt_tokens", F.lit(0)).alias("prompt_tokens"), F.coalesce("completion_tokens", F.lit(0)).alias("completion_tokens"))


def local_answers(questions: DataFrame, entities: DataFrame, units: DataFrame, reports: DataFrame, model: Model, form: str = "prosa", most_units: int = 10) -> DataFrame:
    """One call for each question, over the texts around the entities that it names.

    questions(question, key, body), entities(key, id, title, description), units(key, id, text, where
    id is the entity's), reports(key, report). Entities count as named if the question has their title;
    the most_units with the longest titles are read. A question that names none abstains."""
    named = questions.join(entities, "key").where(F.contains(F.lower("body"), F.lower("title")))
    place = F.row_number().over(W.partitionBy("question").orderBy(F.desc(F.length("title")), "id"))
    top = named.withColumn("place", place).where(F.col("place") <= most_units)
    own = top.join(units.select("key", "id", "text"), ["key", "id"], "left").groupBy("question").agg(F.array_sort(F.collect_list(F.struct("place", F.concat_ws(" ", "description", "text").alias("say")))).alias("u"))
    around = reports.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("report")), "\n").alias("around"))
    text = F.concat(F.lit(FORMS[form] + "\n"), F.array_join(F.transform("u", lambda x: F.concat(F.lit("- "), F.regexp_replace(x["say"], r"\s+", " "))), "\n"), F.lit("\n"), F.coalesce("around", F.lit("")), F.lit("\nQuestion: "), "body")
    asked = ask(questions.join(own, "question").join(around, "key", "left").select("question", text.alias("prompt")), "prompt", model)
    out = questions.select("question").join(asked.drop("prompt", "seconds"), "question", "left")
    return out.select("question", F.coalesce("answer", F.when(F.coalesce("code", F.lit(0)) == 0, ABSTENTION)).alias("answer"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("code", "prompt_tokens", "completion_tokens")))


def alone(questions: DataFrame, model: Model, task: str) -> DataFrame:
    """(question, answer, code, ...): the model's own answer to questions(question, body), without a graph."""
    prompt = F.concat(F.lit(task_prompt(task, False) + "\n\nQuestion: "), "body")
    return ask(questions.select("question", prompt.alias("prompt")), "prompt", model).drop("prompt")


def respond(todo: DataFrame, edges: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(question, key, configuration, answer, code, empty) of todo(question, key, configuration, body):
    a subgraph without an edge in edges(key, ...) abstains without a call; the others are answered by
    `answer`, which keeps question and configuration."""
    full = todo.join(edges.select("key").distinct(), "key", "left_semi")
    said = answer(full).select("question", "configuration", "answer", "code")
    none = todo.join(edges.select("key").distinct(), "key", "left_anti")
    return full.select("question", "key", "configuration").join(said, ["question", "configuration"]).withColumn("empty", F.lit(False)).unionByName(none.select("question", "key", "configuration", F.lit(ABSTENTION).alias("answer"), F.lit(0).alias("code"), F.lit(True).alias("empty")))


def linking_costs(questions: DataFrame, model: Model, link: Callable[[DataFrame], DataFrame], expected: DataFrame) -> tuple[DataFrame, float]:
    """(question, prompt_tokens, completion_tokens, seconds, same) of questions(question, body), and the
    seconds of linking all of them: `link` takes the model's answers to (question, label, id), and
    `same` says whether these are the expected ones. A question with neither has the same."""
    said = materialise(extract(questions, model), "mentions")
    began = time.perf_counter()
    found = materialise(link(said), "linked")
    took = time.perf_counter() - began
    out = said.select("question", "prompt_tokens", "completion_tokens", "seconds").join(same_sets(found, expected), "question", "left")
    return out.withColumn("same", F.coalesce("same", F.lit(True))), took


def run_tool(command: list[str], answers: bool, kept: int = 3000) -> dict:
    """An outside indexing or query program: its answer, code, seconds and the end of what it printed.
    A query that ends well without an answer is an error, code 1."""
    began = time.perf_counter()
    done = subprocess.run(command, capture_output=True, text=True, check=False)
    text = done.stdout.strip()
    failed = answers and not text and done.returncode == 0
    return {"answer": text if answers else None, "code": 1 if failed else done.returncode, "seconds": round(time.perf_counter() - began, 1), "output": (done.stderr if answers else done.stdout + done.stderr)[-kept:]}


class Judge(Protocol):
    """An outside scorer of an answer against reference texts, such as similarity of embeddings or
    claims that a second model checks."""

    measures: tuple[str, ...]

    def score(self, answer: str, references: list[str]) -> dict[str, float]: ...


def judged(answers: DataFrame, judge: Judge) -> DataFrame:
    """answers(question, answer, abstains, references array) with the judge's measures: an abstention
    has 0 in all and isn't sent."""
    names = list(judge.measures)
    kinds = {f.name: f.dataType.simpleString() for f in answers.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [dict.fromkeys(names, 0.0) if a.abstains else judge.score(a.answer, list(a.references)) for a in pdf.itertuples(index=False)]
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    return answers.mapInPandas(run, ", ".join([*(f"`{c}` {k}" for c, k in kinds.items()), *(f"{n} double" for n in names)]))


def write_project(folder: str, config: str, tables: dict[str, DataFrame]) -> None:
    """A subgraph's indexing project: the settings and a Parquet file set for each table of units."""
    df = next(iter(tables.values()))
    df.sparkSession.createDataFrame([(config,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/settings.yaml")
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/output/{name}.parquet")


def settings(model: str, embeddings: str, with_reports: bool = True, community_size: int = 10, report_words: int = 1000, batch_tokens: int = 2500) -> str:
    """The index's settings as YAML; without reports their workflow goes and their share is 0."""
    flows = ["create_communities", *(["create_community_reports"] if with_reports else []), "generate_text_embeddings"]
    lines = ["models:", f"  chat: {{model: {model}, temperature: {TEMPERATURE}, seed: {SEED}}}", f"  embedding: {{model: {embeddings}}}", "workflows: [" + ", ".join(flows) + "]", f"cluster_graph: {{max_cluster_size: {community_size}}}", f"community_reports: {{max_length: {report_words}}}", f"global_search: {{data_max_tokens: {batch_tokens}}}"]
    return "\n".join([*lines, *([] if with_reports else ["local_search: {community_prop: 0.0}"])]) + "\n"
