"""Measures of answers, paired comparisons, intervals and costs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.io import write
from ..storage import materialise, slices
from .joins import number_from

#: Places of resamples that a task makes, and that numpy holds at a time.
PLACES_A_TASK, PLACES_AT_ONCE = 1_000_000, 2_000_000


def factoid(answers: DataFrame, gold: DataFrame, item_nodes: DataFrame | None = None, gold_nodes: DataFrame | None = None) -> DataFrame:
    """answers(question, items array) and gold(question, synonym) to strict (first item), lax (any of
    five) and mrr (1 / place of the first hit), and lax_synonyms, lax by synonyms alone. Where
    item_nodes(item, node) and gold_nodes(question, gold, node) are given, a shared node is a hit too."""
    p = answers.select("question", F.posexplode(F.slice("items", 1, 5)).alias("pos", "item"))
    hit = p.join(gold.select("question", F.col("synonym").alias("item")).distinct(), ["question", "item"], "left_semi").select("question", "pos", F.lit(1).alias("synonym"))
    if item_nodes is not None and gold_nodes is not None:
        by_node = p.join(item_nodes, "item").join(gold_nodes.select("question", "node").distinct(), ["question", "node"], "left_semi")
        hit = hit.unionByName(by_node.select("question", "pos", F.lit(0).alias("synonym")))
    m = answers.select("question").join(hit.groupBy("question").agg(F.min("pos").alias("pos"), F.max("synonym").alias("synonym")), "question", "left")
    return m.select("question", F.coalesce((F.col("pos") == 0).cast("int"), F.lit(0)).alias("strict"), F.col("pos").isNotNull().cast("int").alias("lax"), F.coalesce(1.0 / (F.col("pos") + 1), F.lit(0.0)).alias("mrr"), F.coalesce("synonym", F.lit(0)).alias("lax_synonyms"))


def hits(answers: DataFrame, gold: DataFrame, item_nodes: DataFrame | None = None, gold_nodes: DataFrame | None = None) -> DataFrame:
    """(question, item, gold): an item hits a gold one by a synonym or, where nodes are given, a node
    that both have."""
    i = answers.select("question", F.explode("items").alias("item")).distinct()
    h = i.join(gold.select("question", "gold", F.col("synonym").alias("item")), ["question", "item"]).select("question", "item", "gold")
    if item_nodes is not None and gold_nodes is not None:
        h = h.unionByName(i.join(item_nodes, "item").join(gold_nodes, ["question", "node"]).select("question", "item", "gold"))
    return h.distinct()


def _prf(answers: DataFrame, gold: DataFrame, hit: DataFrame) -> DataFrame:
    h = hit.groupBy("question").agg(F.countDistinct("item").alias("hit"), F.countDistinct("gold").alias("found"))
    n = gold.groupBy("question").agg(F.countDistinct("gold").alias("golds"))
    m = answers.select("question", F.size(F.array_distinct("items")).alias("n")).join(n, "question", "left").join(h, "question", "left").na.fill(0)
    m = m.withColumn("precision", F.when(F.col("n") > 0, F.col("hit") / F.col("n")).otherwise(0.0)).withColumn("recall", F.when(F.col("golds") > 0, F.col("found") / F.col("golds")).otherwise(0.0))
    return m.select("question", "precision", "recall", f1(F.col("precision"), F.col("recall")).alias("f1"))


def lists(answers: DataFrame, gold: DataFrame, item_nodes: DataFrame | None = None, gold_nodes: DataFrame | None = None) -> DataFrame:
    """precision (items that hit), recall (gold items hit) and f1 of each question; with nodes also
    f1_synonyms, the f1 that synonyms alone give."""
    m = _prf(answers, gold, hits(answers, gold, item_nodes, gold_nodes))
    if item_nodes is None or gold_nodes is None:
        return m
    return m.join(_prf(answers, gold, hits(answers, gold)).select("question", F.col("f1").alias("f1_synonyms")), "question")


def dictionary_only(answers: DataFrame, gold: DataFrame, item_nodes: DataFrame, gold_nodes: DataFrame) -> DataFrame:
    """(question, item, gold): hits of the gold items that no item of the answer hits by a synonym."""
    by_name = hits(answers, gold).select("question", "gold").distinct()
    return hits(answers, gold, item_nodes, gold_nodes).join(by_name, ["question", "gold"], "left_anti").select("question", "item", "gold")


def accuracy(df: DataFrame, by: list[str], predicted: str, actual: str) -> DataFrame:
    """(by, accuracy, answers): a null prediction is wrong."""
    right = F.coalesce((F.col(predicted) == F.col(actual)).cast("int"), F.lit(0))
    return df.groupBy(*by).agg(F.avg(right).alias("accuracy"), F.count("*").alias("answers"))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def macro_f1(df: DataFrame, by: list[str], predicted: str, actual: str, classes: tuple) -> DataFrame:
    """Mean of the classes' F1; a null prediction counts against recall."""
    parts = []
    for c in classes:
        tp, p, a = (F.sum(F.when(x, 1).otherwise(0)) for x in ((F.col(predicted) == F.lit(c)) & (F.col(actual) == F.lit(c)), F.col(predicted) == F.lit(c), F.col(actual) == F.lit(c)))
        parts.append(F.when((p > 0) & (a > 0) & (tp > 0), 2 * tp / (p + a)).otherwise(0.0))
    total = parts[0]
    for x in parts[1:]:
        total = total + x
    return df.groupBy(*by).agg((total / len(classes)).alias("macro_f1"))


def gram_array(w: Column, skip: int, singles: bool = False) -> Column:
    """Ordered pairs of words with up to skip words between them, and the words themselves if singles."""
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(skip + 1)), lambda d: F.when(F.size(w) > d, F.zip_with(F.slice(w, F.lit(1), F.size(w) - d), F.slice(w, d + 1, F.size(w) - d), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))))
    return F.concat(pairs, w) if singles else pairs


def grams(texts: DataFrame, key: list[str], words: str, skip: int, singles: bool = False) -> DataFrame:
    """(key, gram, n): ordered pairs of words with up to skip words between them, counted, and the
    words themselves if singles."""
    return texts.select(*key, F.explode(gram_array(F.col(words), skip, singles)).alias("gram")).groupBy(*key, "gram").agg(F.count("*").alias("n"))


def rouge(pairs: DataFrame, answer: DataFrame, ideal: DataFrame) -> DataFrame:
    """pairs(question, reference) with recall and f1 of clipped overlaps, from answer(question, gram, n)
    and ideal(question, reference, gram, n)."""
    both = answer.withColumnRenamed("n", "a").join(ideal.withColumnRenamed("n", "b"), ["question", "gram"]).groupBy("question", "reference").agg(F.sum(F.least("a", "b")).alias("both"))
    na, nb = answer.groupBy("question").agg(F.sum("n").alias("na")), ideal.groupBy("question", "reference").agg(F.sum("n").alias("nb"))
    m = pairs.join(na, "question", "left").join(nb, ["question", "reference"], "left").join(both, ["question", "reference"], "left").na.fill(0)
    m = m.withColumn("precision", F.when(F.col("na") > 0, F.col("both") / F.col("na")).otherwise(0.0)).withColumn("recall", F.when(F.col("nb") > 0, F.col("both") / F.col("nb")).otherwise(0.0))
    return m.select("question", "reference", "recall", f1(F.col("precision"), F.col("recall")).alias("f1"))


def rouge_dealt(answers: DataFrame, references: DataFrame, skip: int, singles: bool = False, small: bool = False) -> DataFrame:
    """rouge of answers(question, reference, w) against references(reference, w): grams that the
    reference lacks are dropped before they are counted, their number follows from the words. With
    small, the references are broadcast."""
    w = F.size("w")
    n = sum((F.greatest(w - d, F.lit(0)) for d in range(1, skip + 2)), F.greatest(w, F.lit(0)) if singles else F.lit(0))
    ideal = grams(references, ["reference"], "w", skip, singles).withColumnRenamed("n", "b")
    nb = ideal.groupBy("reference").agg(F.sum("b").alias("nb"))
    shared = answers.select("question", "reference", F.explode(gram_array(F.col("w"), skip, singles)).alias("gram")).join(F.broadcast(ideal) if small else ideal, ["reference", "gram"])
    shared = shared.groupBy("question", "reference", "gram").agg(F.least(F.count("*"), F.max("b")).alias("both"))
    both = shared.groupBy("question", "reference").agg(F.sum("both").alias("both"))
    m = answers.groupBy("question", "reference").agg(F.sum(n).alias("na")).join(nb, "reference", "left").join(both, ["question", "reference"], "left").na.fill(0)
    precision, recall = F.when(F.col("na") > 0, F.col("both") / F.col("na")).otherwise(0.0), F.when(F.col("nb") > 0, F.col("both") / F.col("nb")).otherwise(0.0)
    return m.select("question", "reference", recall.alias("recall"), f1(precision, recall).alias("f1"))


def best_of(scores: DataFrame, measures: list[str]) -> DataFrame:
    """Each measure's largest over the references, on its own."""
    return scores.groupBy("question").agg(*(F.max(m).alias(m) for m in measures))


def rouge_ideals(answers: DataFrame, ideals: DataFrame, references: DataFrame, skip: int, singles: bool = False, small: bool = False) -> DataFrame:
    """(question, recall, f1, f1_first): each measure's largest over a question's ideals, on its own,
    and f1 against the first. answers(question, abstains, w), ideals(question, reference, first);
    an abstention, and an answer without words, has 0 in all."""
    said = answers.where(~F.col("abstains")).select("question", "w").join(ideals.select("question", "reference"), "question")
    scores = rouge_dealt(said, references, skip, singles, small).join(ideals, ["question", "reference"])
    best = scores.groupBy("question").agg(F.max("recall").alias("recall"), F.max("f1").alias("f1"), F.max(F.when(F.col("first"), F.col("f1"))).alias("f1_first"))
    return answers.select("question").join(best, "question", "left").na.fill(0.0, ["recall", "f1", "f1_first"])


def coverage(gold_nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """(question, configuration, share): gold items with a node in the subgraph, of gold_nodes(question,
    gold, node) and chosen(question, configuration, node)."""
    n = gold_nodes.groupBy("question").agg(F.countDistinct("gold").alias("golds"))
    c = chosen.select("question", "configuration").distinct()
    h = gold_nodes.join(chosen, ["question", "node"]).groupBy("question", "configuration").agg(F.countDistinct("gold").alias("found"))
    return c.join(n, "question").join(h, ["question", "configuration"], "left").select("question", "configuration", (F.coalesce("found", F.lit(0)) / F.col("golds")).alias("share"))


def per_question(facts: DataFrame, value: str = "value") -> DataFrame:
    """Mean over repetitions."""
    return facts.groupBy("question", "configuration").agg(F.avg(value).alias(value))


def complete(means: DataFrame, configurations: int) -> DataFrame:
    """Questions that have all configurations."""
    full = means.groupBy("question").agg(F.countDistinct("configuration").alias("n")).where(F.col("n") == configurations).select("question")
    return means.join(full, "question", "left_semi")


def compare(means: DataFrame, references: list[str], value: str = "value") -> DataFrame:
    """(configuration, reference, questions, mean, difference) over the same questions."""
    ref = means.where(F.col("configuration").isin(*references)).select("question", F.col("configuration").alias("reference"), F.col(value).alias("ref"))
    both = means.join(ref, "question")
    return both.groupBy("configuration", "reference").agg(F.count("*").alias("questions"), F.avg(value).alias("mean"), F.avg(F.col(value) - F.col("ref")).alias("difference"))


def compare_intervals(means: DataFrame, references: list[str], value: str = "value", draws: int = 10_000, seed: int = 42) -> DataFrame:
    """compare with low and high, the percentile interval of the paired difference."""
    ref = means.where(F.col("configuration").isin(*references)).select("question", F.col("configuration").alias("reference"), F.col(value).alias("ref"))
    d = means.join(ref, "question").select("configuration", "reference", (F.col(value) - F.col("ref")).alias("difference"))
    spread = bootstrap(d, ["configuration", "reference"], "difference", draws, seed).select("configuration", "reference", "low", "high")
    return compare(means, references, value).join(spread, ["configuration", "reference"])


def compare_groups(means: DataFrame, groups: DataFrame, references: list[str], inside: DataFrame, value: str = "value") -> DataFrame:
    """(group, configuration, reference, questions, mean, difference, inside) of each group of
    questions, groups(question, group); inside(question, configuration, share) is the share of the
    gold in a subgraph, null where a configuration has none of its own."""
    ref = means.where(F.col("configuration").isin(*references)).select("question", F.col("configuration").alias("reference"), F.col(value).alias("ref"))
    m = means.join(groups, "question").join(inside.select("question", "configuration", "share"), ["question", "configuration"], "left").join(ref, "question")
    return m.groupBy("group", "configuration", "reference").agg(F.count("*").alias("questions"), F.avg(value).alias("mean"), F.avg(F.col(value) - F.col("ref")).alias("difference"), F.avg("share").alias("inside"))


def evaluate(responses: DataFrame, measured: DataFrame, values: list[str], configurations: int, references: list[str], folder: str | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Measures beside their responses, and for each value the comparison over the questions that have
    all configurations. Both share (question, configuration, rep). With a folder, measures and
    comparisons are written there as csv. Without responses the tables are empty."""
    m = responses.join(measured, ["question", "configuration", "rep"])
    out = {v: compare_intervals(complete(per_question(m.select("question", "configuration", F.col(v).cast("double").alias("value"))), configurations), references) for v in values}
    if folder:
        write(m, f"{folder}/measures", "csv")
        for v, c in out.items():
            write(c, f"{folder}/comparison_{v}", "csv")
    return m, out


def with_backoff(facts: DataFrame, alone: str, value: str = "value") -> DataFrame:
    """Means per question and configuration, replaced by the model's alone where any repetition abstains."""
    m = facts.groupBy("question", "configuration").agg(F.avg(value).alias(value), F.avg("abstains").alias("abstains"))
    solo = m.where(F.col("configuration") == alone).select("question", F.col(value).alias("solo"))
    return m.join(solo, "question", "left").select("question", "configuration", F.when(F.col("abstains") == 0, F.col(value)).otherwise(F.col("solo")).alias(value))


def resampled(x: np.ndarray, rng: np.random.Generator, draws: int) -> np.ndarray:
    """Means of `draws` resamples. As many at a time as PLACES_AT_ONCE allows, which doesn't change
    what the generator gives."""
    each = max(1, PLACES_AT_ONCE // len(x))
    return np.concatenate([x[rng.integers(0, len(x), (min(each, draws - i), len(x)))].mean(axis=1) for i in range(0, draws, each)])


def bootstrap(df: DataFrame, by: list[str], value: str, draws: int = 10_000, seed: int = 42) -> DataFrame:
    """(by, mean, low, high): percentile intervals of the mean of each group, by numpy in chunks of
    draws. A group is one comparison's questions."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, rng = np.sort(pdf[value].to_numpy(np.float64)), np.random.default_rng(seed)
        low, high = np.percentile(resampled(x, rng, draws), [2.5, 97.5])
        return pd.DataFrame([[*key, x.mean(), low, high]], columns=[*by, "mean", "low", "high"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", mean double, low double, high double"
    return df.select(*by, value).where(F.col(value).isNotNull()).groupBy(*by).applyInPandas(one, schema)


def interaction(df: DataFrame, value: str, inside: str, draws: int = 10_000, seed: int = 42) -> DataFrame:
    """(difference, low, high) between the means of two groups, from one generator: all resamples of
    the first, then all of the second. Each group, the questions of one comparison, is sorted first,
    so it doesn't matter in which order its rows come. Null values take no part."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (np.sort(pdf.loc[pdf[inside] == k, value].to_numpy(np.float64)) for k in (True, False))
        if not len(a) or not len(b):
            return pd.DataFrame([], columns=["difference", "low", "high"])
        rng = np.random.default_rng(seed)
        first = resampled(a, rng, draws)
        low, high = np.percentile(first - resampled(b, rng, draws), [2.5, 97.5])
        return pd.DataFrame([[a.mean() - b.mean(), low, high]], columns=["difference", "low", "high"])

    return df.select(F.lit(1).alias("one"), value, inside).where(F.col(value).isNotNull()).groupBy("one").applyInPandas(one, "difference double, low double, high double")


def hash_bootstrap(df: DataFrame, key: str, value: str, draws: int = 200) -> DataFrame:
    """(draw, mean): resampled means whose picks follow from a digest of draw and place, so SQL can
    check them."""
    numbered = materialise(number_from(df.select(key, value), 1, key, into="i").select("i", value), "numbered")
    spark, n = df.sparkSession, numbered.count()
    # a row for each draw and place, made where it is used; no array of all places, and no table at the driver
    places = spark.range(0, draws * n, 1, slices(spark, draws * n, PLACES_A_TASK)).select(F.floor(F.col("id") / F.lit(max(n, 1))).alias("draw"), (F.col("id") % F.lit(max(n, 1)) + 1).alias("place"))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("draw").cast("string"), F.col("place").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % max(n, 1) + 1
    return places.select("draw", pick.alias("i")).join(numbered.hint("shuffle_hash"), "i").groupBy("draw").agg(F.avg(value).alias("mean"))


def centred(df: DataFrame, by: list[str], value: str) -> Column:
    return F.col(value) - F.avg(value).over(W.partitionBy(*by))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Correlation of average ranks in each group."""

    def rank(c: str) -> Column:
        w = W.partitionBy(*by)
        return F.rank().over(w.orderBy(c)) + (F.count("*").over(W.partitionBy(*by, c)) - 1) / 2

    r = df.withColumn("rx", rank(x)).withColumn("ry", rank(y))
    return r.groupBy(*by).agg(F.corr("rx", "ry").alias("rho"))


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts by row and column with totals of both, as null-free text keys."""
    c = df.cube(row, column).agg(F.grouping(row).alias("gr"), F.grouping(column).alias("gc"), F.count("*").alias("n"))
    c = c.select(F.when(F.col("gr") == 1, "All").otherwise(F.col(row)).alias(row), F.when(F.col("gc") == 1, "All").otherwise(F.col(column)).alias(column), "n")
    return c.groupBy(row).pivot(column, [*values, "All"]).agg(F.sum("n")).na.fill(0)


def total_cost(questions: DataFrame, query: DataFrame, index: DataFrame, linking: DataFrame, without_selection: list[str]) -> DataFrame:
    """questions(question, key, configuration) with query cost, index cost of the key, linking cost;
    configurations without selection have neither of the last two."""
    c = questions.join(query, ["question", "configuration"], "left").join(index, ["key", "configuration"], "left").join(linking, "question", "left")
    none = F.col("configuration").isin(*without_selection)
    zero = lambda col: F.when(none, 0.0).otherwise(F.coalesce(col, F.lit(0.0)))
    c = c.withColumn("index_cost", zero(F.col("index_cost"))).withColumn("link_cost", zero(F.col("link_cost"))).withColumn("query_cost", F.coalesce("query_cost", F.lit(0.0)))
    return c.withColumn("total", F.col("query_cost") + F.col("index_cost") + F.col("link_cost"))


def subgraph_costs(selection: DataFrame, index: DataFrame, logs: DataFrame) -> DataFrame:
    """(key, configuration, seconds_selection, seconds, calls, tokens): an empty subgraph's index costs
    nothing; one that was used again (origin) has its origin's log; one without a log has null.

    selection(key, configuration, seconds_selection), index(key, configuration, seconds, empty,
    origin), logs(key, configuration, calls, tokens)."""
    i = index.withColumn("log", F.coalesce("origin", "key")).drop("origin")
    use = i.join(logs.withColumnRenamed("key", "log"), ["log", "configuration"], "left")
    cost = lambda c: F.when(F.col("empty"), F.lit(0)).otherwise(F.col(c)).alias(c)
    return selection.join(use.select("key", "configuration", cost("seconds"), cost("calls"), cost("tokens")), ["key", "configuration"], "left")


def amortised(costs: DataFrame) -> DataFrame:
    """(configuration, cost): an index counts once for its key, a query each time, over the questions."""
    index = costs.groupBy("configuration", "key").agg(F.max("index_cost").alias("index_cost")).groupBy("configuration").agg(F.sum("index_cost").alias("i"))
    q = costs.groupBy("configuration").agg(F.sum("query_cost").alias("q"), F.countDistinct("question").alias("n"))
    return q.join(index, "configuration").select("configuration", ((F.col("q") + F.col("i")) / F.col("n")).alias("cost"))


def break_even(costs: DataFrame, whole: str, static: float) -> DataFrame:
    """Questions after which a static index pays: its cost over what a configuration costs more than
    the whole graph's; null unless it costs more."""
    ref = costs.where(F.col("configuration") == whole).select(F.col("cost").alias("ref")).first()
    d = F.col("cost") - F.lit(ref["ref"] if ref else None)
    return costs.where(F.col("configuration") != whole).select("configuration", F.when(d > 0, F.round(F.lit(static) / d)).alias("questions"))


def funnel(df: DataFrame, conditions: list[tuple[str, Column]]) -> DataFrame:
    """(step, name, left): rows that pass all conditions so far."""
    passed, sums = F.lit(True), []
    for name, c in conditions:
        passed = passed & F.coalesce(c, F.lit(False))
        sums.append(F.sum(passed.cast("long")).alias(name))
    row = df.agg(*sums)
    pairs = F.array(*(F.struct(F.lit(i).alias("step"), F.lit(n).alias("name"), F.col(n).alias("left")) for i, (n, _) in enumerate(conditions)))
    return row.select(F.explode(pairs).alias("x")).select("x.*")
