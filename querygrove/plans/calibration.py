"""Bins, samples, curves and controls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hypergeom import degree_class as degree_class_of
from ..operators import calibrate as K
from ..operators import expand, graph, select
from ..sources.schema import STEPS
from ..sources.star import Star
from .network import planes
from .registry import query

_SEEDS = "x_s AS (SELECT id_a AS entity, count(DISTINCT id_b) AS n_seeds FROM g_both WHERE type = 'GDA' AND label_a = 'Disease' AND id_b IN (SELECT src FROM g_plane WHERE plane = 'gene') GROUP BY 1), x_b AS (SELECT entity, n_seeds, ['bajo', 'medio', 'alto'][ntile(3) OVER (ORDER BY n_seeds, entity)] AS bin FROM x_s WHERE n_seeds >= 3)"


def seeds(s: Star) -> DataFrame:
    return select.all_seeds(s.edges("GDA"), s.nodes, STEPS["disease_a_gene"], planes(s)["gene"])


def _binned(s: Star) -> DataFrame:
    return K.bins(seeds(s), least=3).select("entity", "n_seeds", "bin")


@query(_SEEDS + " SELECT * FROM x_b")
def bins_ntile(s: Star) -> DataFrame:
    return _binned(s)


@query(_SEEDS + " SELECT bin, min(n_seeds) AS low, max(n_seeds) AS high, count(*) AS n FROM x_b GROUP BY 1")
def bin_borders(s: Star) -> DataFrame:
    return K.borders(_binned(s))


@query(_SEEDS + ", x_n AS (SELECT count(DISTINCT src) AS n FROM g_plane WHERE plane = 'gene') SELECT entity, n_seeds FROM x_s, x_n WHERE n_seeds * 2 <= n")
def buildable_controls(s: Star) -> DataFrame:
    """Entities whose controls can be drawn."""
    p = planes(s)["gene"]
    return K.buildable(seeds(s), p.select("src").distinct().count())[0].select("entity", "n_seeds")


@query("SELECT plane, node, CASE WHEN degree <= 7 THEN degree WHEN degree < 16 THEN 8 WHEN degree < 32 THEN 9 WHEN degree < 64 THEN 10 WHEN degree < 128 THEN 11 WHEN degree < 256 THEN 12 WHEN degree < 512 THEN 13 ELSE 14 END AS class FROM g_degree")
def degree_class(s: Star) -> DataFrame:
    out = None
    for k, p in planes(s).items():
        one = graph.degrees(p).select(F.lit(k).alias("plane"), "node", degree_class_of(F.col("degree")).alias("class"))
        out = one if out is None else out.unionByName(one)
    return out


@query(_SEEDS + ", x_p AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5('42|' || entity), entity) AS place FROM x_b) SELECT entity, bin, place FROM x_p WHERE place <= 10")
def md5_sample(s: Star) -> DataFrame:
    """Ten of each bin by digest order."""
    return K.sample(_binned(s), ["bin"], "entity", 10).select("entity", "bin", F.col("place").cast("long").alias("place"))


@query(_SEEDS + """, x_t AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY entity) AS turn FROM x_b), x_p AS (SELECT entity, bin, row_number() OVER (ORDER BY turn, CASE bin WHEN 'bajo' THEN 1 WHEN 'alto' THEN 2 ELSE 3 END) AS place FROM x_t) SELECT * FROM x_p WHERE place <= 12""")
def roundrobin_sample(s: Star) -> DataFrame:
    c = K.round_robin(_binned(s).withColumn("cell", F.lit("disease_a_gene")), ["cell"], 12)
    return c.select("entity", "bin", F.col("place").cast("long").alias("place"))


_ADDED = "x_add AS (SELECT l_suppkey AS run, 'P' || l_partkey AS node, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem WHERE l_quantity >= 35), x_hid AS (SELECT DISTINCT l_suppkey AS run, 'P' || l_partkey AS node FROM lineitem WHERE l_quantity >= 47)"


@query(_ADDED + ", x_h AS (SELECT a.run, rank, sum(CASE WHEN h.node IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY a.run ORDER BY rank) AS hits FROM x_add a LEFT JOIN x_hid h ON h.run = a.run AND h.node = a.node) SELECT run, rank, round(hits / n::DOUBLE, 9) AS recall FROM x_h JOIN (SELECT run, count(*) AS n FROM x_hid GROUP BY 1) USING (run)")
def recall_curve(s: Star) -> DataFrame:
    """Hidden seeds among the first added nodes."""
    from pyspark.sql import Window as W

    li = s.table("lineitem").select(F.col("l_suppkey").alias("run"), F.concat(F.lit("P"), "l_partkey").alias("node"), "l_orderkey", "l_linenumber", "l_quantity")
    added = li.where("l_quantity >= 35").select("run", "node", F.row_number().over(W.partitionBy("run").orderBy("l_orderkey", "l_linenumber", F.substring("node", 2, 20).cast("long"))).alias("rank"))
    out = K.recall_curve(added, li.where("l_quantity >= 47").select("run", "node").distinct(), ["run"])
    return out.select("run", F.col("rank").cast("long").alias("rank"), F.round("recall", 9).alias("recall"))


_CURVE = "x_v AS (SELECT user_id % 10 AS g, user_id AS run, CAST(event_id % 30 AS INTEGER) AS it, max(value) AS v FROM events WHERE value IS NOT NULL GROUP BY ALL), x_full AS (SELECT g, run, unnest(range(0, 31)) AS it FROM (SELECT DISTINCT g, run FROM x_v)), x_ff AS (SELECT g, run, it, last_value(v IGNORE NULLS) OVER (PARTITION BY g, run ORDER BY it) AS v FROM x_full LEFT JOIN x_v USING (g, run, it)), x_mean AS (SELECT g, it, avg(v) AS v FROM x_ff GROUP BY 1, 2)"


def _curve(s: Star) -> DataFrame:
    e = s.table("events").where("value IS NOT NULL").groupBy((F.col("user_id") % 10).alias("g"), F.col("user_id").alias("run"), (F.col("event_id") % 30).cast("int").alias("it")).agg(F.max("value").alias("v"))
    return K.mean_curve(e, "run", "it", "v", 30, ["g"])


@query(_CURVE + " SELECT g, CAST(it AS BIGINT) AS it, round(v, 6) AS v FROM x_mean")
def ffill_mean_curve(s: Star) -> DataFrame:
    """Curves carried forward and averaged."""
    return _curve(s).select("g", F.col("it").cast("long").alias("it"), F.round("v", 6).alias("v"))


@query(_CURVE + """, x_r AS (SELECT g, it, round(v, 6) AS v FROM x_mean WHERE v IS NOT NULL), x_final AS (SELECT g, arg_max(v, it) AS final FROM x_r GROUP BY 1)
SELECT g, final, min(it) FILTER (v >= 0.8 * final) AS k_80, arg_min(v, it) FILTER (v >= 0.8 * final) AS value_80, min(it) FILTER (v >= 0.95 * final) AS k_95, arg_min(v, it) FILTER (v >= 0.95 * final) AS value_95 FROM x_r JOIN x_final USING (g) GROUP BY 1, 2""")
def first_reach(s: Star) -> DataFrame:
    """Where curves first have a share of their end."""
    c = _curve(s).where("v IS NOT NULL").select("g", F.col("it").cast("long").alias("it"), F.round("v", 6).alias("v"))
    return K.first_reach(c, ["g"], "it", "v")


@query()
def growth_traces(s: Star) -> DataFrame:
    """Traces of real seeds and controls for a sample of cases."""
    p = planes(s)["gene"]
    sd = seeds(s)
    cases = K.sample(K.bins(sd, least=5), ["bin"], "entity", K.CASES).select(F.lit("disease_a_gene").alias("cell"), "entity", "seeds")
    return K.run_cases(cases, expand.small_network(p))


@query()
def hidden_seed_recall(s: Star) -> DataFrame:
    """Recall of hidden seeds for a sample of cases."""
    p = planes(s)["gene"]
    cases = K.sample(K.bins(seeds(s), least=5), ["bin"], "entity", K.CASES).select(F.lit("disease_a_gene").alias("cell"), "entity", "seeds")
    return K.hidden_recall(cases, expand.small_network(p))


@query("SELECT x AS half, CAST(round_even(x, 0) AS BIGINT) AS rounded FROM (SELECT DISTINCT l_linenumber + 0.5::DOUBLE AS x FROM lineitem)", graph=False)
def half_even(s: Star) -> DataFrame:
    """Rounding halves to even."""
    x = (F.col("l_linenumber") + 0.5).alias("half")
    return s.table("lineitem").select(x).distinct().select("half", F.bround("half").cast("long").alias("rounded"))


@query("SELECT event_type, round(avg(value), 6) AS value, count(*) AS cases FROM (SELECT event_type, user_id, avg(value) AS value FROM events WHERE value IS NOT NULL GROUP BY 1, 2) GROUP BY 1", graph=False)
def mean_of_means(s: Star) -> DataFrame:
    """The mean over cases of each case's mean."""
    return K.mean_of_means(s.table("events").where("value IS NOT NULL"), "user_id", ["event_type"], "value").withColumn("value", F.round("value", 6))


#: Every step as a cell, with its seeds and the size of its plane.
_CELLS = "x_st(step, origin, target, relation, plane) AS (VALUES " + ", ".join(f"('{t.name}', '{t.origin}', '{t.target}', '{t.relation}', '{t.plane}')" for t in STEPS.values()) + """), x_pop AS (SELECT plane, count(DISTINCT src) AS population FROM g_plane GROUP BY 1), x_grp AS (SELECT label, id FROM g_nodes WHERE is_group),
x_seed AS (SELECT step AS cell, id_a AS entity, count(DISTINCT id_b) AS n_seeds, any_value(population) AS population FROM x_st JOIN g_both b ON b.type = relation AND label_a = origin AND label_b = target JOIN x_pop USING (plane) WHERE id_a <> id_b AND (label_a, id_a) NOT IN (SELECT (label, id) FROM x_grp) AND (label_b, id_b) NOT IN (SELECT (label, id) FROM x_grp) AND (plane, id_b) IN (SELECT (plane, src) FROM g_plane) GROUP BY 1, 2),
x_bin AS (SELECT cell, entity, n_seeds, ['bajo', 'medio', 'alto'][ntile(3) OVER (PARTITION BY cell ORDER BY n_seeds, entity)] AS bin FROM x_seed WHERE n_seeds * 2 <= population AND n_seeds >= 2), x_few AS (SELECT cell, count(*) AS cases FROM x_bin GROUP BY 1 HAVING count(*) < 150)"""


def _plan(s: Star) -> dict[str, DataFrame]:
    p, sd, sizes = planes(s), None, None
    for t in STEPS.values():
        one = select.all_seeds(s.edges(t.relation), s.nodes, t, p[t.plane]).select(F.lit(t.name).alias("cell"), "entity", "n_seeds")
        n = graph.members(p[t.plane]).agg(F.count("*").alias("population")).select(F.lit(t.name).alias("cell"), "population")
        sd, sizes = (one, n) if sd is None else (sd.unionByName(one), sizes.unionByName(n))
    return K.plan(sd, sizes, least=2)


@query(_CELLS + """ SELECT cell, candidates, eligible, low, middle, high FROM (SELECT cell, count(*) AS eligible, max(n_seeds) FILTER (bin = 'bajo') AS low, max(n_seeds) FILTER (bin = 'medio') AS middle, max(n_seeds) FILTER (bin = 'alto') AS high FROM x_bin WHERE cell NOT IN (SELECT cell FROM x_few) GROUP BY 1)
JOIN (SELECT cell, count(*) AS candidates FROM x_seed WHERE n_seeds * 2 <= population GROUP BY 1) USING (cell)""")
def plan_cells(s: Star) -> DataFrame:
    """The cells that can be run, and their bins' borders."""
    return _plan(s)["cells"]


@query(_CELLS + """ SELECT cell, entity, n_seeds, bin FROM (SELECT *, row_number() OVER (PARTITION BY cell, bin ORDER BY md5('42|' || entity), entity) AS place FROM x_bin WHERE cell NOT IN (SELECT cell FROM x_few)) WHERE place <= 50""")
def plan_cases(s: Star) -> DataFrame:
    """Fifty cases of each bin of each cell."""
    return _plan(s)["cases"]


@query(_CELLS + " SELECT cell, cases, cases || ' cases are too few for three bins of 50' AS reason FROM x_few UNION ALL SELECT cell, count(*), count(*) || ' without controls' FROM x_seed WHERE n_seeds * 2 > population GROUP BY 1")
def plan_rejects(s: Star) -> DataFrame:
    """Cells with too few cases, and entities whose controls can't be drawn, counted."""
    p = _plan(s)
    n = p["without_controls"].groupBy("cell").agg(F.count("*").alias("cases"))
    return p["too_few"].unionByName(n.withColumn("reason", F.format_string("%d without controls", "cases")))
