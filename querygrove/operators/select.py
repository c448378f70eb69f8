"""Selection of a question's subgraph, with the provenance of every node.

The working form is long: one row per node and reason, (label, id, entity_label, entity_id, step,
role, iteration, p_value, method). Arrays of reasons are made at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.schema import ADDED, CONFIGURATIONS, ENTITY_ROLE, K_PER_STEP, K_PER_TYPE, MIN_SEEDS, OUTSIDE, SEED, STEPS, Step
from . import expand, graph
from .graph import induced  # noqa: F401

LONG = ("label", "id", "entity_label", "entity_id", "step", "role", "iteration", "p_value", "method")


def known(entities: DataFrame, nodes: DataFrame) -> DataFrame:
    """The entities(label, id) that exist."""
    return entities.join(nodes.select("label", "id"), ["label", "id"], "left_semi")


def groups_of(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(label, id, group_id): the groups that hold a disease."""
    g = edges.where("type = 'DISEASE_BERT'").select(F.col("label_b").alias("label"), F.col("id_b").alias("id"), F.col("id_a").alias("group_id"))
    return entities.join(g, ["label", "id"]).distinct()


def harvest(edges: DataFrame, entities: DataFrame, step: Step) -> DataFrame:
    """(entity_label, entity_id, seed): neighbours of the entities that a step starts from, and of
    the groups that hold them, whatever they are."""
    start = entities.where(F.col("label") == step.origin).select("label", "id").distinct()
    own = start.select("label", "id", F.col("id").alias("at"))
    own = own.unionByName(groups_of(edges, start).select("label", "id", F.col("group_id").alias("at")))
    e = graph.both_ways(edges.where(F.col("type") == step.relation)).where((F.col("label_a") == step.origin) & (F.col("label_b") == step.target))
    near = own.join(e.select(F.col("id_a").alias("at"), F.col("id_b").alias("seed")), "at")
    return near.select(F.col("label").alias("entity_label"), F.col("id").alias("entity_id"), "seed").distinct()


def all_seeds(edges: DataFrame, nodes: DataFrame, step: Step, plane: DataFrame) -> DataFrame:
    """(entity, seeds, n_seeds) for every entity of a step: its neighbours in the plane, groups left
    out on both sides, itself aside."""
    e = graph.both_ways(edges.where(F.col("type") == step.relation)).where((F.col("label_a") == step.origin) & (F.col("label_b") == step.target))
    group = nodes.where("is_group")
    for end in "ab":
        e = e.join(group.select(F.col("label").alias(f"label_{end}"), F.col("id").alias(f"id_{end}")), [f"label_{end}", f"id_{end}"], "left_anti")
    s = e.select(F.col("id_a").alias("entity"), F.col("id_b").alias("seed")).distinct().where("entity <> seed")
    s = s.join(graph.members(plane).select(F.col("node").alias("seed")), "seed", "left_semi")
    return s.groupBy("entity").agg(F.array_sort(F.collect_set("seed")).alias("seeds"), F.countDistinct("seed").alias("n_seeds"))


def _reason(label: Column, node: Column, step: str | Column, role: Column, iteration: Column, p: Column, method: Column) -> list[Column]:
    return [label.alias("label"), node.alias("id"), F.col("entity_label"), F.col("entity_id"), (F.lit(step) if isinstance(step, str) else step).alias("step"), role.alias("role"), iteration.cast("int").alias("iteration"), p.cast("double").alias("p_value"), method.cast("string").alias("method")]


def roles(seeds: DataFrame, plane: DataFrame, step: Step) -> DataFrame:
    """Reasons of harvested neighbours: seeds inside the plane, neighbours outside of it."""
    inside = graph.members(plane).select(F.col("node").alias("seed"), F.lit(True).alias("inside"))
    none = F.lit(None)
    role = F.when(F.col("inside"), F.lit(SEED)).otherwise(F.lit(OUTSIDE))
    return seeds.join(inside, "seed", "left").select(*_reason(F.lit(step.target), F.col("seed"), step.name, role, none, none, none))


def project(edges: DataFrame, entities: DataFrame, step: Step, plane: DataFrame, net: expand.Network | None, steps: int | None = None, least_seeds: int = MIN_SEEDS, method: str = "diamond_c3") -> DataFrame:
    """Reasons that one step gives: harvested neighbours always; added nodes where an entity has
    enough seeds in the plane. Entities grow side by side."""
    got = harvest(edges, entities, step)
    out = roles(got, plane, step)
    steps = K_PER_STEP[step.name] if steps is None else steps
    if not steps or (net is not None and not len(net)):
        return out
    seeds = out.where(F.col("role") == SEED).groupBy("entity_label", "entity_id").agg(F.array_sort(F.collect_set("id")).alias("seeds"))
    seeds = seeds.where(F.size("seeds") >= least_seeds)
    runs = seeds.select(F.concat_ws("\0", "entity_label", "entity_id").alias("run"), "seeds", F.lit(steps).alias("steps"))
    grown = expand.run_by_joins(plane, runs, method) if net is None else expand.run_all(net, runs, method)
    added = grown.select("*", F.split("run", "\0")[0].alias("entity_label"), F.split("run", "\0")[1].alias("entity_id"))
    return out.unionByName(added.select(*_reason(F.lit(step.target), F.col("node"), step.name, F.lit(ADDED), F.col("iteration"), F.col("p_value"), F.col("method"))))


def project_all(edges: DataFrame, entities: DataFrame, planes: dict[str, DataFrame], nets: dict[str, expand.Network | None], least_seeds: int = MIN_SEEDS, method: str = "diamond_c3", steps: dict[str, int] | None = None) -> DataFrame:
    """Reasons of the entities themselves, of all steps from their labels, and of their groups."""
    none = F.lit(None)
    named = entities.select("label", "id", F.col("label").alias("entity_label"), F.col("id").alias("entity_id")).distinct()
    out = named.select(*_reason(F.col("label"), F.col("id"), none.cast("string"), F.lit(ENTITY_ROLE), none, none, none))
    for s in STEPS.values():
        out = out.unionByName(project(edges, entities, s, planes[s.plane], nets[s.plane], (steps or K_PER_STEP)[s.name], least_seeds, method))
    g = groups_of(edges, entities).select(F.col("label").alias("entity_label"), F.col("id").alias("entity_id"), "group_id")
    return out.unionByName(g.select(*_reason(F.lit("Disease"), F.col("group_id"), "grupo_bert", F.lit(SEED), none, none, none)))


def refine(selection: DataFrame, matrix: DataFrame, k_per_type: dict[str, int] = K_PER_TYPE, rounds: int = 20, digits: int | None = None) -> DataFrame:
    """The selection with the nodes of best walk score that it lacks, k for each type; scores of 0
    don't count; ties go to the smaller id. The walk restarts on all selected nodes in the graph."""
    chosen = selection.select("label", F.col("id").alias("node")).distinct()
    there = matrix.nodes() if isinstance(matrix, graph.Matrix) else matrix.select(F.col("src_label").alias("label"), F.col("src").alias("node")).distinct()
    scores = graph.walk(matrix, chosen.join(there, ["label", "node"], "left_semi"), rounds)
    best = top_per_type(scores.join(chosen, ["label", "node"], "left_anti"), k_per_type, digits)
    none = F.lit(None).cast("string")
    added = best.select("label", F.col("node").alias("id"), none.alias("entity_label"), none.alias("entity_id"), none.alias("step"), F.lit(ADDED).alias("role"), F.col("rank").alias("iteration"), F.lit(None).cast("double").alias("p_value"), F.lit("rwr").alias("method"))
    return selection.unionByName(added)


def top_per_type(scores: DataFrame, k_per_type: dict[str, int] = K_PER_TYPE, digits: int | None = None) -> DataFrame:
    score = F.round("score", digits) if digits else F.col("score")
    most = F.create_map(*[F.lit(x) for kv in k_per_type.items() for x in kv])
    s = scores.withColumn("score", score).where("score > 0")
    s = s.withColumn("rank", F.row_number().over(W.partitionBy("label").orderBy(F.desc("score"), "node")))
    return s.where(F.col("rank") <= most[F.col("label")])


def configured(selection: DataFrame, configuration: str) -> DataFrame:
    """The reasons that a configuration admits: all but added nodes, and those by its methods."""
    methods = CONFIGURATIONS[configuration]
    return selection.where((F.col("role") != ADDED) | (F.col("method").isin(*methods) if methods else F.lit(False)))


def ablation(selection: DataFrame) -> DataFrame:
    """One selection seen through all configurations, with a column of that name."""
    out = None
    for c in CONFIGURATIONS:
        one = configured(selection, c).withColumn("configuration", F.lit(c))
        out = one if out is None else out.unionByName(one)
    return out


def provenances(selection: DataFrame) -> DataFrame:
    """(label, id, provenances): reasons as an array in a fixed order."""
    entity = F.when(F.col("entity_id").isNotNull(), F.struct(F.col("entity_label").alias("label"), F.col("entity_id").alias("id")))
    return selection.groupBy("label", "id").agg(F.array_sort(F.collect_list(F.struct(entity.alias("entity"), "step", "role", "iteration", "p_value", "method"))).alias("provenances"))


def origin_of(selection: DataFrame) -> DataFrame:
    """(label, id, origin): what brought a node: anything but addition first, then by the earliest of
    the methods."""
    rank = F.when(F.col("role") != ADDED, 0).when(F.col("method") == "diamond", 1).when(F.col("method") == "c3", 2).otherwise(3)
    names = F.array(*map(F.lit, (SEED, "diamond", "c3", "rwr")))
    return selection.groupBy("label", "id").agg(F.min(rank).alias("r")).select("label", "id", F.element_at(names, F.col("r") + 1).alias("origin"))


def missing(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen nodes that don't exist; must be empty."""
    return chosen.select("label", "id").distinct().join(nodes.select("label", "id"), ["label", "id"], "left_anti")


def statistics(chosen: DataFrame, edges: DataFrame, origin: DataFrame) -> DataFrame:
    """(kind, value, n): nodes by label and by what brought them, edges by type."""
    one = lambda df, kind, col: df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "value", "n")
    return one(chosen.select("label", "id").distinct(), "label", "label").unionByName(one(edges, "edge", "type")).unionByName(one(origin, "origin", "origin"))
