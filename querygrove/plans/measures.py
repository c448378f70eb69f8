"""Measures of answers, comparisons and costs.

The facts are events: the configuration is the event's type, the question its user and the
repetition its id modulo three. Answers are conversations, ideals the benchmark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import measures as M
from ..operators.joins import number_from
from ..sources.star import Star
from .registry import query

_FACTS = "x_f AS (SELECT user_id AS question, event_type AS configuration, event_id % 3 AS rep, value, CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS abstains FROM events WHERE value IS NOT NULL), x_m AS (SELECT question, configuration, avg(value) AS value FROM x_f GROUP BY 1, 2), x_types AS (SELECT count(DISTINCT configuration) AS n FROM x_f), x_c AS (SELECT * FROM x_m WHERE question IN (SELECT question FROM x_m GROUP BY 1 HAVING count(*) = (SELECT n FROM x_types)))"


def facts(s: Star) -> DataFrame:
    e = s.table("events").where("value IS NOT NULL")
    return e.select(F.col("user_id").alias("question"), F.col("event_type").alias("configuration"), (F.col("event_id") % 3).alias("rep"), "value", F.when(F.col("event_id") % 97 == 0, 1).otherwise(0).alias("abstains"))


def _complete(s: Star) -> DataFrame:
    f = facts(s)
    return M.complete(M.per_question(f), f.select("configuration").distinct().count())


_ANS = """x_a AS (SELECT o_custkey AS question, list(DISTINCT l_partkey ORDER BY l_partkey) AS items FROM g_sold GROUP BY 1), x_i AS (SELECT question, items[i] AS item, i - 1 AS pos FROM (SELECT question, items, unnest(range(1, len(items) + 1)) AS i FROM x_a)),
x_g AS (SELECT DISTINCT o_custkey AS question, l_suppkey AS gold, l_partkey AS synonym FROM g_sold WHERE l_quantity >= 45)"""


def _answers(s: Star) -> tuple[DataFrame, DataFrame]:
    a = s.sold.groupBy(F.col("o_custkey").alias("question")).agg(F.array_sort(F.collect_set("l_partkey")).alias("items"))
    return a, s.sold.where("l_quantity >= 45").select(F.col("o_custkey").alias("question"), F.col("l_suppkey").alias("gold"), F.col("l_partkey").alias("synonym")).distinct()


@query(_ANS + """, x_h AS (SELECT i.question, min(pos) AS pos FROM x_i i JOIN (SELECT DISTINCT question, synonym FROM x_g) g ON g.question = i.question AND g.synonym = i.item WHERE pos < 5 GROUP BY 1)
SELECT question, CASE WHEN pos = 0 THEN 1 ELSE 0 END AS strict, CASE WHEN pos IS NOT NULL THEN 1 ELSE 0 END AS lax, coalesce(1.0::DOUBLE / (pos + 1), 0) AS mrr FROM x_a LEFT JOIN x_h USING (question)""")
def factoid_scores(s: Star) -> DataFrame:
    return M.factoid(*_answers(s)).drop("lax_synonyms")


@query(_ANS + """, x_h AS (SELECT i.question, count(DISTINCT item) AS hit, count(DISTINCT gold) AS found FROM x_i i JOIN x_g g ON g.question = i.question AND g.synonym = i.item GROUP BY 1), x_n AS (SELECT question, count(DISTINCT gold) AS golds FROM x_g GROUP BY 1),
x_p AS (SELECT question, coalesce(hit, 0) / len(items)::DOUBLE AS p, CASE WHEN golds > 0 THEN coalesce(found, 0) / golds::DOUBLE ELSE 0 END AS r FROM x_a LEFT JOIN x_h USING (question) LEFT JOIN x_n USING (question))
SELECT question, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM x_p""")
def list_prf(s: Star) -> DataFrame:
    m = M.lists(*_answers(s))
    return m.select("question", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


#: The dictionary knows the even items; answers hold what was sold in smaller numbers than the gold.
_NODES = _ANS.replace("FROM g_sold GROUP BY 1)", "FROM g_sold WHERE l_quantity < 45 GROUP BY 1)") + """, x_n AS (SELECT DISTINCT item, item % 25 AS node FROM x_i WHERE item % 2 = 0), x_gn AS (SELECT DISTINCT o_custkey AS question, l_suppkey AS gold, l_partkey % 25 AS node FROM g_sold WHERE l_quantity >= 45),
x_hs AS (SELECT DISTINCT i.question, i.item, i.pos, g.gold FROM x_i i JOIN x_g g ON g.question = i.question AND g.synonym = i.item), x_hn AS (SELECT DISTINCT i.question, i.item, i.pos, g.gold FROM x_i i JOIN x_n n ON n.item = i.item JOIN x_gn g ON g.question = i.question AND g.node = n.node), x_hb AS (SELECT * FROM x_hs UNION SELECT * FROM x_hn)"""


def _with_nodes(s: Star) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    _, g = _answers(s)
    a = s.sold.where("l_quantity < 45").groupBy(F.col("o_custkey").alias("question")).agg(F.array_sort(F.collect_set("l_partkey")).alias("items"))
    items = a.select(F.explode("items").alias("item")).distinct().where("item % 2 = 0")
    return a, g, items.select("item", (F.col("item") % 25).alias("node")), g.select("question", "gold", (F.col("synonym") % 25).alias("node")).distinct()


@query(_NODES + """, x_first AS (SELECT question, min(pos) AS pos FROM x_hb WHERE pos < 5 GROUP BY 1), x_syn AS (SELECT DISTINCT question, 1 AS y FROM x_hs WHERE pos < 5)
SELECT question, CASE WHEN pos = 0 THEN 1 ELSE 0 END AS strict, CASE WHEN pos IS NOT NULL THEN 1 ELSE 0 END AS lax, coalesce(1.0::DOUBLE / (pos + 1), 0) AS mrr, coalesce(y, 0) AS lax_synonyms FROM x_a LEFT JOIN x_first USING (question) LEFT JOIN x_syn USING (question)""")
def factoid_node_hits(s: Star) -> DataFrame:
    """First answers that hit by a synonym or by a node."""
    return M.factoid(*_with_nodes(s))


def _prf_sql(hits: str) -> str:
    return f"SELECT question, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM (SELECT question, coalesce(hit, 0) / len(items)::DOUBLE AS p, CASE WHEN golds > 0 THEN coalesce(found, 0) / golds::DOUBLE ELSE 0 END AS r FROM x_a LEFT JOIN (SELECT question, count(DISTINCT item) AS hit, count(DISTINCT gold) AS found FROM {hits} GROUP BY 1) USING (question) LEFT JOIN (SELECT question, count(DISTINCT gold) AS golds FROM x_g GROUP BY 1) USING (question))"


@query(_NODES + f" SELECT question, round(b.p, 9) AS precision, round(b.r, 9) AS recall, round(b.f, 9) AS f1, round(y.f, 9) AS f1_synonyms FROM ({_prf_sql('x_hb')}) b JOIN ({_prf_sql('x_hs')}) y USING (question)")
def list_node_hits(s: Star) -> DataFrame:
    """Lists that hit by a synonym or by a node, beside synonyms alone."""
    m = M.lists(*_with_nodes(s))
    return m.select("question", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "f1_synonyms")))


@query(_NODES + " SELECT DISTINCT question, item, gold FROM x_hn WHERE (question, gold) NOT IN (SELECT (question, gold) FROM x_hs)")
def list_dictionary_only(s: Star) -> DataFrame:
    """Gold items that only the dictionary finds in an answer."""
    return M.dictionary_only(*_with_nodes(s))


@query("""SELECT lang, round(avg(CASE WHEN p = quality THEN 1.0::DOUBLE ELSE 0 END), 9) AS accuracy, count(*) AS answers FROM (SELECT lang, quality, CASE WHEN n_chars > 2000 THEN 1 WHEN n_chars > 300 THEN 0 END AS p FROM documents JOIN labels USING (doc_id)) GROUP BY 1""", graph=False)
def yesno_accuracy(s: Star) -> DataFrame:
    """Share of right answers; none given is wrong."""
    d = s.table("documents").select("doc_id", "lang", F.when(F.col("n_chars") > 2000, 1).when(F.col("n_chars") > 300, 0).alias("predicted")).join(s.table("labels"), "doc_id")
    return M.accuracy(d, ["lang"], "predicted", "quality").withColumn("accuracy", F.round("accuracy", 9))


@query("""SELECT lang, round(((CASE WHEN tp1 > 0 THEN 2.0::DOUBLE * tp1 / (p1 + a1) ELSE 0 END) + (CASE WHEN tp0 > 0 THEN 2.0::DOUBLE * tp0 / (p0 + a0) ELSE 0 END)) / 2, 9) AS macro_f1 FROM (
SELECT lang, count(*) FILTER (p = 1 AND quality = 1) AS tp1, count(*) FILTER (p = 1) AS p1, count(*) FILTER (quality = 1) AS a1, count(*) FILTER (p = 0 AND quality = 0) AS tp0, count(*) FILTER (p = 0) AS p0, count(*) FILTER (quality = 0) AS a0
FROM (SELECT lang, quality, CASE WHEN n_chars > 2000 THEN 1 WHEN n_chars > 300 THEN 0 END AS p FROM documents JOIN labels USING (doc_id)) GROUP BY 1)""", graph=False)
def yesno_macro_f1(s: Star) -> DataFrame:
    d = s.table("documents").select("doc_id", "lang", F.when(F.col("n_chars") > 2000, 1).when(F.col("n_chars") > 300, 0).alias("predicted")).join(s.table("labels"), "doc_id")
    return M.macro_f1(d, ["lang"], "predicted", "quality", (1, 0)).withColumn("macro_f1", F.round("macro_f1", 9))


#: Items of the benchmark up to which their grams are broadcast.
SMALL = 2000


def _rouge(skip: int, singles: bool) -> str:
    pairs = "SELECT {k}, ws[i] || ' ' || ws[j] AS gram FROM (SELECT {k}, ws, i, unnest(range(i + 1, least(i + 1 + {s}, len(ws)) + 1)) AS j FROM (SELECT {k}, ws, unnest(range(1, len(ws) + 1)) AS i FROM {t}))"
    extra = " UNION ALL SELECT {k}, unnest(ws) FROM {t}" if singles else ""
    grams = lambda k, t: (pairs + extra).format(k=k, t=t, s=skip)
    return f"""x_w AS (SELECT conv_id * 1000 + turn AS question, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM conversations), x_b AS (SELECT item_id AS reference, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM benchmark),
x_ga AS (SELECT question, gram, count(*) AS a FROM ({grams("question", "x_w")}) GROUP BY 1, 2), x_gb AS (SELECT reference, gram, count(*) AS b FROM ({grams("reference", "x_b")}) GROUP BY 1, 2),
x_na AS (SELECT question, sum(a) AS na FROM x_ga GROUP BY 1), x_nb AS (SELECT reference, sum(b) AS nb FROM x_gb GROUP BY 1), x_both AS (SELECT question, reference, sum(least(a, b)) AS both_ FROM x_ga JOIN x_gb USING (gram) GROUP BY 1, 2),
x_s AS (SELECT w.question, x.reference, coalesce(both_, 0) / nullif(na, 0)::DOUBLE AS p, coalesce(both_, 0) / nullif(nb, 0)::DOUBLE AS r FROM x_w w JOIN x_b x ON (w.question // 1000) % (SELECT count(*) FROM benchmark) = x.reference LEFT JOIN x_na USING (question) LEFT JOIN x_nb ON x_nb.reference = x.reference LEFT JOIN x_both o ON o.question = w.question AND o.reference = x.reference)
SELECT question, round(max(coalesce(r, 0)), 9) AS recall, round(max(CASE WHEN coalesce(p, 0) + coalesce(r, 0) > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 9) AS f1 FROM x_s GROUP BY 1"""


def _rouge_scores(s: Star, skip: int, singles: bool) -> DataFrame:
    """Every turn against one item of the benchmark, dealt in turn by conversation."""
    a = s.table("conversations").select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("question"), X.words(F.col("text")).alias("w"))
    b = s.table("benchmark").select(F.col("item_id").alias("reference"), X.words(F.col("text")).alias("w"))
    n = max(b.count(), 1)
    place = number_from(b.select("reference"), 0, "reference", into="place").withColumn("place", F.col("place").cast("long"))
    dealt = a.withColumn("place", F.pmod("conv_id", F.lit(n)).cast("long")).join(place, "place").select("question", "reference", "w")
    scores = M.best_of(M.rouge_dealt(dealt, b, skip, singles, small=n <= SMALL), ["recall", "f1"])
    return scores.select("question", F.round("recall", 9).alias("recall"), F.round("f1", 9).alias("f1"))


@query(_rouge(0, False))
def rouge_2(s: Star) -> DataFrame:
    """Pairs of neighbouring words, best over the ideals."""
    return _rouge_scores(s, 0, False)


@query(_rouge(4, True))
def rouge_su4(s: Star) -> DataFrame:
    """Pairs with up to four words between, and words."""
    return _rouge_scores(s, 4, True)


#: Ideals of a question.
IDEALS = 3


def _rouge_ideals(skip: int, singles: bool) -> str:
    head = _rouge(skip, singles).rpartition("x_s AS (")[0]
    return head + f"""x_id AS (SELECT question, (question // 1000 + k) % (SELECT count(*) FROM benchmark) AS reference, min(k) = 0 AS first_ FROM x_w, (SELECT unnest(range(0, {IDEALS})) AS k) WHERE (question // 1000) % 11 <> 0 GROUP BY 1, 2),
x_s AS (SELECT i.question, first_, coalesce(both_, 0) / nullif(na, 0)::DOUBLE AS p, coalesce(both_, 0) / nullif(nb, 0)::DOUBLE AS r FROM x_id i JOIN x_b b USING (reference) LEFT JOIN x_na USING (question) LEFT JOIN x_nb ON x_nb.reference = i.reference LEFT JOIN x_both o ON o.question = i.question AND o.reference = i.reference),
x_f1 AS (SELECT question, first_, coalesce(r, 0) AS r, CASE WHEN coalesce(p, 0) + coalesce(r, 0) > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM x_s)
SELECT question, round(coalesce(max(r), 0), 9) AS recall, round(coalesce(max(f), 0), 9) AS f1, round(coalesce(max(f) FILTER (first_), 0), 9) AS f1_first FROM x_w LEFT JOIN x_f1 USING (question) GROUP BY 1"""


@query(_rouge_ideals(4, True))
def rouge_several_ideals(s: Star) -> DataFrame:
    """Every turn against three items of the benchmark, each measure's best on its own, and against the
    first; the turns of every eleventh conversation abstain."""
    a = s.table("conversations").select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("question"), X.words(F.col("text")).alias("w"), (F.col("conv_id") % 11 == 0).alias("abstains"))
    b = s.table("benchmark").select(F.col("item_id").alias("reference"), X.words(F.col("text")).alias("w"))
    n = max(b.count(), 1)
    place = number_from(b.select("reference"), 0, "reference", into="place").withColumn("place", F.col("place").cast("long"))
    dealt = a.select("question", "conv_id", F.explode(F.sequence(F.lit(0), F.lit(IDEALS - 1))).alias("k")).withColumn("place", F.pmod(F.col("conv_id") + F.col("k"), F.lit(n)).cast("long"))
    ideals = dealt.join(place, "place").groupBy("question", "reference").agg((F.min("k") == 0).alias("first"))
    m = M.rouge_ideals(a, ideals, b, 4, True, small=n <= SMALL)
    return m.select("question", *(F.round(c, 9).alias(c) for c in ("recall", "f1", "f1_first")))


@query("""x_gold AS (SELECT DISTINCT o_custkey AS question, l_suppkey AS gold, l_partkey AS node FROM g_sold WHERE l_quantity >= 40), x_ch AS (SELECT DISTINCT o_custkey AS question, l_returnflag AS configuration, l_partkey AS node FROM g_sold)
SELECT c.question, configuration, round(coalesce(found, 0) / golds::DOUBLE, 9) AS share FROM (SELECT DISTINCT question, configuration FROM x_ch) c JOIN (SELECT question, count(DISTINCT gold) AS golds FROM x_gold GROUP BY 1) USING (question)
LEFT JOIN (SELECT question, configuration, count(DISTINCT gold) AS found FROM x_gold JOIN x_ch USING (question, node) GROUP BY 1, 2) USING (question, configuration)""")
def gold_coverage(s: Star) -> DataFrame:
    """Share of the gold items that a subgraph holds."""
    gold = s.sold.where("l_quantity >= 40").select(F.col("o_custkey").alias("question"), F.col("l_suppkey").alias("gold"), F.col("l_partkey").alias("node")).distinct()
    chosen = s.sold.select(F.col("o_custkey").alias("question"), F.col("l_returnflag").alias("configuration"), F.col("l_partkey").alias("node")).distinct()
    return M.coverage(gold, chosen).withColumn("share", F.round("share", 9))


@query(_FACTS + " SELECT question, configuration, round(value, 6) AS value FROM x_c")
def complete_means(s: Star) -> DataFrame:
    return _complete(s).withColumn("value", F.round("value", 6))


@query(_FACTS + " SELECT a.configuration, b.configuration AS reference, count(*) AS questions, round(avg(a.value), 6) AS mean, round(avg(a.value - b.value), 6) AS difference FROM x_c a JOIN x_c b USING (question) WHERE b.configuration IN (SELECT min(configuration) FROM x_f UNION ALL SELECT max(configuration) FROM x_f) GROUP BY 1, 2")
def paired_comparison(s: Star) -> DataFrame:
    """Means and paired differences to two references."""
    r = facts(s).agg(F.min("configuration"), F.max("configuration")).first()
    out = M.compare(_complete(s), list(r))
    return out.select("configuration", "reference", "questions", F.round("mean", 6).alias("mean"), F.round("difference", 6).alias("difference"))


@query(_FACTS + """, x_cov AS (SELECT user_id AS question, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0 END)::DOUBLE AS share FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT CASE WHEN share <= 0.5 THEN 'hasta_la_mitad' ELSE 'mas_de_la_mitad' END AS stratum, configuration, count(*) AS questions, round(avg(value), 6) AS mean FROM x_c JOIN x_cov USING (question) GROUP BY 1, 2""")
def strata_comparison(s: Star) -> DataFrame:
    """Means by strata of coverage."""
    cov = s.table("events").where("value IS NOT NULL").groupBy(F.col("user_id").alias("question")).agg(F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)).alias("share"))
    j = _complete(s).join(cov, "question").groupBy(X.coverage_group(F.col("share")).alias("stratum"), "configuration")
    return j.agg(F.count("*").alias("questions"), F.round(F.avg("value"), 6).alias("mean"))


@query("""x_s AS (SELECT user_id AS question, avg(CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0 END)::DOUBLE AS share FROM events GROUP BY 1)
SELECT question, CASE WHEN share = 0 THEN 'nada' WHEN share < 0.5 THEN 'menos_de_la_mitad' ELSE 'la_mitad_o_mas' END AS gold_group, CASE WHEN share <= 0.5 THEN 'hasta_la_mitad' ELSE 'mas_de_la_mitad' END AS coverage_group FROM x_s""")
def share_groups(s: Star) -> DataFrame:
    """Both ways to cut shares; a half falls on different sides."""
    d = s.table("events").groupBy(F.col("user_id").alias("question")).agg(F.avg(F.when(F.col("event_id") % 2 == 0, 1.0).otherwise(0.0)).alias("share"))
    return d.select("question", X.share_group(F.col("share")).alias("gold_group"), X.coverage_group(F.col("share")).alias("coverage_group"))


@query(_FACTS + ", x_b AS (SELECT question, configuration, avg(value) AS value, avg(abstains) AS ab FROM x_f GROUP BY 1, 2) SELECT b.question, b.configuration, round(CASE WHEN ab = 0 THEN b.value ELSE s.value END, 6) AS value FROM x_b b LEFT JOIN (SELECT question, value FROM x_b WHERE configuration = (SELECT min(configuration) FROM x_f)) s USING (question)")
def backoff(s: Star) -> DataFrame:
    """Where a repetition abstains, the model alone answers."""
    f = facts(s)
    return M.with_backoff(f, f.agg(F.min("configuration")).first()[0]).withColumn("value", F.round("value", 6))


@query(_FACTS + """, x_gr AS (SELECT question, CASE WHEN share = 0 THEN 'nada' WHEN share < 0.5 THEN 'menos_de_la_mitad' ELSE 'la_mitad_o_mas' END AS "group" FROM (SELECT user_id AS question, avg(CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0 END)::DOUBLE AS share FROM events GROUP BY 1)),
x_sub AS (SELECT user_id AS question, event_type AS configuration, avg(CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0 END)::DOUBLE AS share FROM events WHERE event_type <> (SELECT min(event_type) FROM events) GROUP BY 1, 2)
SELECT "group", a.configuration, b.configuration AS reference, count(*) AS questions, round(avg(a.value), 6) AS mean, round(avg(a.value - b.value), 6) AS difference, round(avg(share), 6) AS inside FROM x_c a JOIN x_c b USING (question) JOIN x_gr USING (question) LEFT JOIN x_sub ON x_sub.question = a.question AND x_sub.configuration = a.configuration
WHERE b.configuration IN (SELECT min(configuration) FROM x_f UNION ALL SELECT max(configuration) FROM x_f) GROUP BY 1, 2, 3""")
def gold_group_comparison(s: Star) -> DataFrame:
    """Means, paired differences and the gold inside of the subgraph, by groups of questions."""
    e, even = s.table("events"), F.avg(F.when(F.col("event_id") % 2 == 0, 1.0).otherwise(0.0)).alias("share")
    low, high = facts(s).agg(F.min("configuration"), F.max("configuration")).first()
    groups = e.groupBy(F.col("user_id").alias("question")).agg(even).select("question", X.share_group(F.col("share")).alias("group"))
    inside = e.where(F.col("event_type") != low).groupBy(F.col("user_id").alias("question"), F.col("event_type").alias("configuration")).agg(even)
    m = M.compare_groups(_complete(s), groups, [low, high], inside)
    return m.select("group", "configuration", "reference", "questions", *(F.round(c, 6).alias(c) for c in ("mean", "difference", "inside")))


@query()
def comparison_intervals(s: Star) -> DataFrame:
    """Paired differences to two references with their intervals."""
    return M.compare_intervals(_complete(s), list(facts(s).agg(F.min("configuration"), F.max("configuration")).first()))


@query(_FACTS + """, x_d AS (SELECT question, value, row_number() OVER (ORDER BY question) AS i, count(*) OVER () AS n FROM x_c WHERE configuration = (SELECT min(configuration) FROM x_f)),
x_pl AS (SELECT draw, unnest(range(1, (SELECT max(n) FROM x_d) + 1)) AS place FROM (SELECT unnest(range(0, 200)) AS draw))
SELECT draw, round(avg(value), 6) AS mean FROM (SELECT draw, CAST('0x' || substr(md5(draw || ':' || place), 1, 8) AS BIGINT) % (SELECT max(n) FROM x_d) + 1 AS i FROM x_pl) JOIN x_d USING (i) GROUP BY 1""")
def bootstrap_hash(s: Star) -> DataFrame:
    """Resampled means by digest picks."""
    low = facts(s).agg(F.min("configuration")).first()[0]
    return M.hash_bootstrap(_complete(s).where(F.col("configuration") == low), "question", "value").withColumn("mean", F.round("mean", 6))


@query()
def bootstrap_intervals(s: Star) -> DataFrame:
    """Percentile intervals of each configuration's mean."""
    return M.bootstrap(_complete(s), ["configuration"], "value")


@query()
def interaction_interval(s: Star) -> DataFrame:
    return M.interaction(_complete(s).withColumn("inside", F.col("question") % 2 == 0), "value", "inside", draws=2000)


@query(_FACTS + """, x_v AS (SELECT question, configuration, value - avg(value) OVER (PARTITION BY question) AS cx, rep - avg(rep) OVER (PARTITION BY question, configuration) AS cy FROM (SELECT question, configuration, CAST(round(value) AS DOUBLE) AS value, CAST(rep AS DOUBLE) AS rep FROM x_f)),
x_r AS (SELECT configuration, rank() OVER (PARTITION BY configuration ORDER BY round(cx, 6)) + (count(*) OVER (PARTITION BY configuration, round(cx, 6)) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY configuration ORDER BY round(cy, 6)) + (count(*) OVER (PARTITION BY configuration, round(cy, 6)) - 1) / 2.0 AS ry FROM x_v)
SELECT configuration, round(corr(rx, ry), 6) AS rho FROM x_r GROUP BY 1""")
def spearman_centered(s: Star) -> DataFrame:
    """Rank correlation after centring within the question and the configuration."""
    f = facts(s).withColumn("value", F.round("value")).withColumn("rep", F.col("rep").cast("double"))
    f = f.withColumn("cx", F.round(M.centred(f, ["question"], "value"), 6)).withColumn("cy", F.round(M.centred(f, ["question", "configuration"], "rep"), 6))
    return M.spearman(f, ["configuration"], "cx", "cy").withColumn("rho", F.round("rho", 6))


_COSTS = """x_q AS (SELECT DISTINCT user_id AS question, user_id % 20 AS key, event_type AS configuration FROM events), x_qc AS (SELECT user_id AS question, event_type AS configuration, avg(value) AS query_cost FROM events GROUP BY 1, 2), x_ic AS (SELECT user_id % 20 AS key, event_type AS configuration, max(value) * 10 AS index_cost FROM events GROUP BY 1, 2),
x_lc AS (SELECT user_id AS question, min(value) AS link_cost FROM events GROUP BY 1), x_cost AS (SELECT x_q.*, coalesce(query_cost, 0) AS query_cost, CASE WHEN configuration = (SELECT min(event_type) FROM events) THEN 0 ELSE coalesce(index_cost, 0) END AS index_cost, CASE WHEN configuration = (SELECT min(event_type) FROM events) THEN 0 ELSE coalesce(link_cost, 0) END AS link_cost
FROM x_q LEFT JOIN x_qc USING (question, configuration) LEFT JOIN x_ic USING (key, configuration) LEFT JOIN x_lc USING (question)),
x_am AS (SELECT configuration, (q + i) / n AS cost FROM (SELECT configuration, sum(query_cost) AS q, count(DISTINCT question) AS n FROM x_cost GROUP BY 1) JOIN (SELECT configuration, sum(ic) AS i FROM (SELECT configuration, key, max(index_cost) AS ic FROM x_cost GROUP BY 1, 2) GROUP BY 1) USING (configuration))"""


def _costs(s: Star) -> DataFrame:
    e = s.table("events").select(F.col("user_id").alias("question"), (F.col("user_id") % 20).alias("key"), F.col("event_type").alias("configuration"), "value")
    low = e.agg(F.min("configuration")).first()[0]
    q, ic = e.groupBy("question", "configuration").agg(F.avg("value").alias("query_cost")), e.groupBy("key", "configuration").agg((F.max("value") * 10).alias("index_cost"))
    return M.total_cost(e.select("question", "key", "configuration").distinct(), q, ic, e.groupBy("question").agg(F.min("value").alias("link_cost")), [low])


@query(_COSTS + " SELECT question, key, configuration, round(query_cost, 6) AS query_cost, round(index_cost, 6) AS index_cost, round(link_cost, 6) AS link_cost, round(query_cost + index_cost + link_cost, 6) AS total FROM x_cost")
def cost_total(s: Star) -> DataFrame:
    """What each question cost with each configuration."""
    return _costs(s).select("question", "key", "configuration", *(F.round(c, 6).alias(c) for c in ("query_cost", "index_cost", "link_cost", "total")))


@query("""SELECT s.key, s.configuration, seconds_selection, CASE WHEN empty THEN 0 ELSE seconds END AS seconds, CASE WHEN empty THEN 0 ELSE coalesce(calls, -1) END AS calls, CASE WHEN empty THEN 0 ELSE coalesce(tokens, -1) END AS tokens
FROM (SELECT user_id % 50 AS key, event_type AS configuration, max(event_id) AS seconds_selection, min(event_id) AS seconds, min(event_id) % 5 = 0 AS empty, CASE WHEN user_id % 50 % 4 = 1 THEN user_id % 50 - 1 ELSE user_id % 50 END AS log FROM events GROUP BY user_id % 50, event_type) s
LEFT JOIN (SELECT user_id % 50 AS log, event_type AS configuration, count(*) AS calls, CAST(sum(event_id % 100) AS BIGINT) AS tokens FROM events WHERE user_id % 50 % 7 <> 3 GROUP BY 1, 2) l ON l.log = s.log AND l.configuration = s.configuration""", graph=False)
def subgraph_costs(s: Star) -> DataFrame:
    """What indexes cost: nothing for empty ones, the origin's log where one was used again, -1 without
    a log."""
    e = s.table("events").select((F.col("user_id") % 50).alias("key"), F.col("event_type").alias("configuration"), "event_id")
    one = e.groupBy("key", "configuration").agg(F.max("event_id").alias("seconds_selection"), F.min("event_id").alias("seconds"))
    index = one.select("key", "configuration", "seconds", (F.col("seconds") % 5 == 0).alias("empty"), F.when(F.col("key") % 4 == 1, F.col("key") - 1).alias("origin"))
    logs = e.where("key % 7 <> 3").groupBy("key", "configuration").agg(F.count("*").alias("calls"), F.sum(F.col("event_id") % 100).alias("tokens"))
    return M.subgraph_costs(one.drop("seconds"), index, logs).na.fill(-1, ["calls", "tokens"])


@query(_COSTS + " SELECT configuration, round(cost, 6) AS cost FROM x_am")
def cost_amortized(s: Star) -> DataFrame:
    return M.amortised(_costs(s)).withColumn("cost", F.round("cost", 6))


@query(_COSTS + " SELECT configuration, CASE WHEN cost > ref THEN round(100000 / (cost - ref)) END AS questions FROM x_am JOIN (SELECT cost AS ref FROM x_am WHERE configuration = (SELECT min(event_type) FROM events)) ON true WHERE configuration <> (SELECT min(event_type) FROM events)")
def break_even(s: Star) -> DataFrame:
    """Questions after which a static index pays."""
    a = M.amortised(_costs(s))
    low = s.table("events").agg(F.min("event_type")).first()[0]
    return M.break_even(a, low, 100000.0)


@query("SELECT event_type AS configuration, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3 FROM events GROUP BY 1 UNION ALL SELECT 'todas', round(avg(value), 6), round(median(value), 6), round(quantile_cont(value, 0.25), 6), round(quantile_cont(value, 0.75), 6) FROM events", graph=False)
def cost_summary(s: Star) -> DataFrame:
    """Mean, median and quartiles of each configuration and of all."""
    r = s.table("events").rollup("event_type").agg(F.grouping("event_type").alias("g"), *(F.round(x, 6).alias(n) for n, x in (("mean", F.avg("value")), ("median", F.median("value")), ("q1", F.percentile("value", 0.25)), ("q3", F.percentile("value", 0.75)))))
    return r.select(F.when(F.col("g") == 1, "todas").otherwise(F.col("event_type")).alias("configuration"), "mean", "median", "q1", "q3")


@query("SELECT coalesce(c_mktsegment, 'All') AS segment, coalesce(n_name, 'All') AS nation, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY CUBE (c_mktsegment, n_name)", graph=False)
def crosstab_margins(s: Star) -> DataFrame:
    """Counts with totals of rows and columns."""
    c = s.table("customer").join(s.table("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    out = M.crosstab(c.select(F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation")), "segment", "nation", [r[0] for r in s.table("nation").select("n_name").distinct().orderBy("n_name").collect()])
    return out.unpivot("segment", [c for c in out.columns if c != "segment"], "nation", "n").where("n > 0").select("segment", "nation", F.col("n").cast("long").alias("n"))


@query("""SELECT event_type AS configuration, round(avg(CASE WHEN event_id % 3 = 0 THEN value END), 6) AS r0, round(avg(CASE WHEN event_id % 3 = 1 THEN value END), 6) AS r1, round(avg(CASE WHEN event_id % 3 = 2 THEN value END), 6) AS r2 FROM events GROUP BY 1""", graph=False)
def pivot_mean(s: Star) -> DataFrame:
    p = facts(s).groupBy("configuration").pivot("rep", [0, 1, 2]).agg(F.avg("value"))
    return p.select("configuration", *(F.round(F.col(str(k)), 6).alias(f"r{k}") for k in range(3)))


@query("""SELECT * FROM (VALUES (0, 'has_text'), (1, 'long'), (2, 'english'), (3, 'good')) v(step, name) JOIN (SELECT 0 AS step, count(*) FILTER (text IS NOT NULL) AS "left" FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 1, count(*) FILTER (n_chars > 500) FROM documents LEFT JOIN labels USING (doc_id)
UNION ALL SELECT 2, count(*) FILTER (n_chars > 500 AND lang = 'en') FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 3, count(*) FILTER (n_chars > 500 AND lang = 'en' AND quality = 1) FROM documents LEFT JOIN labels USING (doc_id)) USING (step)""", graph=False)
def question_funnel(s: Star) -> DataFrame:
    """Rows left after each condition."""
    d = s.table("documents").join(s.table("labels"), "doc_id", "left")
    return M.funnel(d, [("has_text", F.col("text").isNotNull()), ("long", F.col("n_chars") > 500), ("english", F.col("lang") == "en"), ("good", F.col("quality") == 1)])


@query("""SELECT role, split_part(text, ' ', 1) AS word, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1, 2 ORDER BY n DESC, word LIMIT 25""", graph=False)
def top_values(s: Star) -> DataFrame:
    """The commonest values."""
    c = s.table("conversations").where("role = 'user'").groupBy("role", F.split("text", " ")[0].alias("word")).agg(F.count("*").alias("n"))
    return c.orderBy(F.desc("n"), "word").limit(25)


@query(r"""x_r AS (SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'Items:' || chr(10) || '- ' || a || chr(10) || '2. ' || upper(b) || ' (note)' || chr(10) || '* ' || a || '.' || chr(10) || chr(10) || 'after' WHEN 1 THEN a || ' [Data: Reports (1)]' || chr(10) || 'None' || chr(10) || b || ' [LLM: verify]' ELSE a || ';' END AS t FROM (SELECT conv_id, turn, 'w' || conv_id AS a, 'v' || turn || ' z' AS b FROM conversations)),
x_e AS (SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'w' || conv_id || '|v' || turn || ' z' WHEN 1 THEN 'w' || conv_id || '|v' || turn || ' z' ELSE 'w' || conv_id END AS items FROM conversations) SELECT conv_id, turn, items FROM x_e""")
def clean_items(s: Star) -> DataFrame:
    """Items of an answer's first block."""
    a, b = F.concat(F.lit("w"), "conv_id"), F.concat(F.lit("v"), "turn", F.lit(" z"))
    t = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("Items:\n- "), a, F.lit("\n2. "), F.upper(b), F.lit(" (note)\n* "), a, F.lit(".\n\nafter")))
    t = t.when(F.col("conv_id") % 3 == 1, F.concat(a, F.lit(" [Data: Reports (1)]\nNone\n"), b, F.lit(" [LLM: verify]"))).otherwise(F.concat(a, F.lit(";")))
    return s.table("conversations").select("conv_id", "turn", F.array_join(X.items(t), "|").alias("items"))


@query("""SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'yes' WHEN role = 'system' THEN 'no' END AS predicted FROM conversations""", graph=False)
def yesno_parse(s: Star) -> DataFrame:
    """The first word of an answer, if it is yes or no."""
    t = F.when(F.col("role") == "user", F.concat(F.lit(" **Yes**, "), "text")).when(F.col("role") == "system", F.lit("No [LLM: verify].")).otherwise(F.concat(F.lit("yes "), F.lit(X.ABSTENTION)))
    return s.table("conversations").select("conv_id", "turn", X.yes_no(t).alias("predicted"))


@query("""SELECT conv_id, max(CASE WHEN length(text) % 5 > 0 THEN 1 ELSE 0 END) AS any_scored, max(CASE WHEN length(text) % 7 = 0 THEN 1 ELSE 0 END) AS any_empty, CAST(sum(length(text) % 5) AS BIGINT) AS score FROM conversations GROUP BY 1""", graph=False)
def answer_origin(s: Star) -> DataFrame:
    """Whether any point scored and any batch was empty, from nested answers."""
    n = F.length("text")
    a = s.table("conversations").groupBy("conv_id").agg(F.collect_list(F.struct((n % 5).alias("score"), (n % 7).alias("tokens"))).alias("p"))
    return a.select("conv_id", F.exists("p", lambda x: x["score"] > 0).cast("int").alias("any_scored"), F.exists("p", lambda x: x["tokens"] == 0).cast("int").alias("any_empty"), F.aggregate("p", F.lit(0).cast("long"), lambda t, x: t + x["score"]).alias("score"))


@query("""SELECT l_orderkey, r AS place FROM (SELECT l_orderkey, l_suppkey % 3 AS src, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey % 3, l_linenumber) AS r, l_linenumber FROM lineitem) WHERE r = 1""", graph=False)
def dedup_across_sets(s: Star) -> DataFrame:
    """One row per key, from the first set that has it."""
    from ..operators.joins import first_per

    li = s.table("lineitem").select("l_orderkey", (F.col("l_suppkey") % 3).alias("src"), "l_linenumber")
    return first_per(li, ["l_orderkey"], "src", "l_linenumber").select("l_orderkey", F.lit(1).cast("long").alias("place"))


@query("""x_p AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS pos FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), '|' ORDER BY pos, CAST(l_partkey AS VARCHAR)) AS parts FROM x_p GROUP BY 1""")
def ordered_distinct(s: Star) -> DataFrame:
    """Distinct values in the order in which they first come."""
    from ..operators.joins import join_ordered

    p = s.table("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("pos"))
    return p.groupBy("l_orderkey").agg(join_ordered(F.col("l_partkey").cast("string"), "pos", "|").alias("parts"))


@query("""x_s AS (SELECT DISTINCT l_orderkey, unnest([l_partkey % 10, l_suppkey % 10]) AS v FROM lineitem) SELECT a.l_orderkey AS a, a.l_orderkey + 1 AS b, count(*) AS shared FROM x_s a JOIN x_s b ON b.l_orderkey = a.l_orderkey + 1 AND a.v = b.v GROUP BY 1, 2""")
def set_overlap(s: Star) -> DataFrame:
    """Sets of neighbouring questions that overlap."""
    li = s.table("lineitem").groupBy("l_orderkey").agg(F.array_union(F.collect_set(F.col("l_partkey") % 10), F.collect_set(F.col("l_suppkey") % 10)).alias("v"))
    n = li.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("v").alias("w"))
    j = li.join(n, "l_orderkey").where(F.arrays_overlap("v", "w"))
    return j.select(F.col("l_orderkey").alias("a"), (F.col("l_orderkey") + 1).alias("b"), F.size(F.array_intersect("v", "w")).cast("long").alias("shared"))


@query("""SELECT l_suppkey AS item, l_partkey AS gold, string_agg(DISTINCT l_returnflag, ' ' ORDER BY l_returnflag) AS configurations FROM lineitem WHERE l_quantity >= 40 GROUP BY 1, 2""", graph=False)
def dictionary_hits(s: Star) -> DataFrame:
    """Pairs in joined texts, with the configurations that found them."""
    from ..operators.joins import join_distinct

    joined = s.table("lineitem").where("l_quantity >= 40").groupBy("l_returnflag", "l_suppkey").agg(F.array_join(F.collect_list(F.col("l_partkey").cast("string")), " | ").alias("pairs"))
    one = joined.select("l_returnflag", F.col("l_suppkey").alias("item"), F.explode(F.split("pairs", r" \| ")).alias("gold")).withColumn("gold", F.col("gold").cast("long"))
    return one.groupBy("item", "gold").agg(join_distinct("l_returnflag", " ").alias("configurations"))


@query("""SELECT conv_id AS question, 'r' || (conv_id % 3) AS rep, count(*) AS claims, count(*) FILTER (length(text) % 3 = 0) AS contradictions FROM conversations GROUP BY 1, 2""", graph=False)
def judged_labels(s: Star) -> DataFrame:
    """Judged claims: a query id is taken apart and a label counted."""
    label = F.when(F.length("text") % 3 == 0, "Contradiction").otherwise("Entailment")
    j = s.table("conversations").groupBy(F.concat_ws("__", F.col("conv_id"), F.concat(F.lit("r"), (F.col("conv_id") % 3).cast("string"))).alias("query_id")).agg(F.collect_list(label).alias("labels"))
    p = F.split("query_id", "__")
    return j.select(p[0].cast("long").alias("question"), p[1].alias("rep"), F.size("labels").cast("long").alias("claims"), F.size(F.filter("labels", lambda x: x == "Contradiction")).cast("long").alias("contradictions"))


@query(_FACTS + " SELECT a.configuration, printf('%.2f', round(avg(a.value), 4)) AS mean, printf('%+.1f', round(avg(a.value - b.value), 4)) AS difference FROM x_c a JOIN x_c b USING (question) WHERE b.configuration = (SELECT min(configuration) FROM x_f) GROUP BY 1")
def summary_table(s: Star) -> DataFrame:
    """Means and signed differences as text."""
    low = facts(s).agg(F.min("configuration")).first()[0]
    c = M.compare(_complete(s), [low])
    return c.select("configuration", F.format_string("%.2f", F.round("mean", 4)).alias("mean"), F.format_string("%+.1f", F.round("difference", 4)).alias("difference"))


@query(_FACTS + """, x_in AS (SELECT question, max(value) > 60 AS inside FROM x_c GROUP BY 1) SELECT inside, configuration, count(*) AS questions, round(avg(value), 6) AS mean FROM x_c JOIN x_in USING (question) GROUP BY 1, 2""")
def gold_in_out(s: Star) -> DataFrame:
    """Means by whether the gold is in the subgraph."""
    c = _complete(s)
    inside = c.groupBy("question").agg((F.max("value") > 60).alias("inside"))
    return c.join(inside, "question").groupBy("inside", "configuration").agg(F.count("*").alias("questions"), F.round(F.avg("value"), 6).alias("mean"))
