"""Calibration: bins, samples, controls, hidden seeds, traces and the curves over them."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import materialise
from . import expand
from .joins import number_from

#: Names of the three bins.
BINS = ("bajo", "medio", "alto")
RUNS = 20
#: Cases of a bin.
CASES = 50
#: Which of a case's generators hide seeds, of real sets and of control sets. Those of
#: the control sets themselves are numbered by draw; a draw takes the matched set first.
FOLD_STREAMS = (10_001, 10_002)


def buildable(seeds: DataFrame, population: int) -> tuple[DataFrame, DataFrame]:
    """Entities with half the population as seeds at most, and the others."""
    ok = F.col("n_seeds") * 2 <= population
    return seeds.where(ok), seeds.where(~ok)


def bins(seeds: DataFrame, least: int = 5, by: list[str] | None = None) -> DataFrame:
    """Three bins of equal size by (n_seeds, entity) of entities with enough seeds, of each cell if by
    names some; larger bins first. Places come from ranges of the whole table, so a large cell isn't
    one task's work."""
    by, some = by or [], seeds.where(F.col("n_seeds") >= least)
    n = materialise(number_from(some, 0, *by, "n_seeds", "entity", into="__place"), "places")
    sizes = n.groupBy(*by).agg(F.min("__place").alias("__first"), F.count("*").alias("__n"))
    if by:
        n = n.join(F.broadcast(sizes), by)  # a row for each cell
    else:
        n = n.withColumn("__first", F.lit(0)).withColumn("__n", F.lit(n.count()))
    place, size, more = F.col("__place") - F.col("__first"), F.floor(F.col("__n") / 3), F.col("__n") % 3
    edge = more * (size + 1)
    tile = F.when(place < edge, F.floor(place / (size + 1))).otherwise(more + F.floor((place - edge) / F.greatest(size, F.lit(1))))
    return n.withColumn("bin", F.element_at(F.array(*map(F.lit, BINS)), (tile + 1).cast("int"))).drop("__place", "__first", "__n")


def enough(binned: DataFrame, n_per_bin: int, by: list[str] | None = None) -> DataFrame:
    """binned, or an error where a cell has fewer than three bins of n_per_bin cases."""
    few = binned.groupBy(*(by or [])).agg(F.count("*").alias("n")).where(F.col("n") < 3 * n_per_bin).first()
    if few is not None:
        raise ValueError(f"{few['n']} cases are too few for three bins of {n_per_bin}")
    return binned


def borders(binned: DataFrame, by: list[str] | None = None) -> DataFrame:
    return binned.groupBy(*(by or []), "bin").agg(F.min("n_seeds").alias("low"), F.max("n_seeds").alias("high"), F.count("*").alias("n"))


def attempt(binned: DataFrame, n_per_bin: int, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Cells with three bins of n_per_bin cases, and (by, cases, reason) of the others."""
    n = binned.groupBy(*by).agg(F.count("*").alias("cases"))
    few = n.where(F.col("cases") < 3 * n_per_bin)
    reason = F.format_string(f"%d cases are too few for three bins of {n_per_bin}", "cases").alias("reason")
    return binned.join(few, by, "left_anti"), few.select(*by, "cases", reason)


def plan(seeds: DataFrame, populations: DataFrame, least: int = 5, n_per_bin: int = CASES) -> dict[str, DataFrame]:
    """The cases to run and what was left out, from seeds(cell, entity, n_seeds) and
    populations(cell, population), the nodes from which controls are drawn.

    cases(cell, entity, n_seeds, bin), cells(cell, candidates, eligible, low, middle, high: the most
    seeds of each bin), without_controls(cell, entity, n_seeds, population) and
    too_few(cell, cases, reason)."""
    s = seeds.join(F.broadcast(populations), "cell")  # a row for each cell
    fits = F.col("n_seeds") * 2 <= F.col("population")
    binned, few = attempt(bins(s.where(fits).select("cell", "entity", "n_seeds"), least, ["cell"]), n_per_bin, ["cell"])
    top = lambda i, name: F.max(F.when(F.col("bin") == BINS[i], F.col("n_seeds"))).alias(name)
    edges = binned.groupBy("cell").agg(F.count("*").alias("eligible"), top(0, "low"), top(1, "middle"), top(2, "high"))
    candidates = s.where(fits).groupBy("cell").agg(F.count("*").alias("candidates"))
    return {
        "cases": sample(binned, ["cell", "bin"], "entity", n_per_bin).select("cell", "entity", "n_seeds", "bin"),
        "cells": candidates.join(edges, "cell"),
        "without_controls": s.where(~fits).select("cell", "entity", "n_seeds", "population"),
        "too_few": few,
    }


def digest_order(*cols: Column | str, seed: int = 42) -> Column:
    """An order that looks random and is the same everywhere."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *cols).cast("binary"))


def sample(df: DataFrame, by: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each group, without replacement, by digest order."""
    w = W.partitionBy(*by).orderBy(digest_order(F.col(key).cast("string"), seed=seed), key)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def round_robin(cases: DataFrame, by: list[str], n: int, order: tuple[str, ...] = ("bajo", "alto", "medio")) -> DataFrame:
    """The first, second, ... case of each bin in turn, n for each cell."""
    turn = F.row_number().over(W.partitionBy(*by, "bin").orderBy("entity"))
    c = cases.withColumn("turn", turn).withColumn("b", F.array_position(F.array(*map(F.lit, order)), F.col("bin")))
    return c.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy("turn", "b"))).where(F.col("place") <= n).drop("b")


def case_seed(cell: Column, entity: Column, seed: int = 42) -> Column:
    return F.crc32(F.concat_ws("|", cell, entity).cast("binary")).bitwiseXOR(F.lit(seed).cast("long"))


def recall_curve(added: DataFrame, hidden: DataFrame, by: list[str]) -> DataFrame:
    """(by, rank, recall): hidden nodes among the first added ones, over all hidden."""
    h = added.join(hidden.withColumn("hit", F.lit(1)), [*by, "node"], "left")
    n = hidden.groupBy(*by).agg(F.count("*").alias("n"))
    run = F.sum(F.coalesce("hit", F.lit(0))).over(W.partitionBy(*by).orderBy("rank"))
    return h.select(*by, "rank", run.alias("__hits")).join(n, by).select(*by, "rank", (F.col("__hits") / F.col("n")).alias("recall"))


def mean_curve(df: DataFrame, run: str, index: str, value: str, last: int, by: list[str] | None = None) -> DataFrame:
    """(by, index, value): each run carried forward over 0..last, then averaged; before its start a run
    doesn't count."""
    by = by or []
    runs = df.select(*by, run).distinct().withColumn(index, F.explode(F.sequence(F.lit(0), F.lit(last))))
    full = runs.join(df.select(*by, run, F.col(index).cast("int").alias(index), value), [*by, run, index], "left")
    held = F.last(value, ignorenulls=True).over(W.partitionBy(*by, run).orderBy(index))
    return full.withColumn(value, held).groupBy(*by, index).agg(F.avg(value).alias(value))


def first_reach(curve: DataFrame, by: list[str], index: str, value: str, shares: tuple[float, ...] = (0.8, 0.95)) -> DataFrame:
    """The first index at which a curve has each share of its final value, and the value there."""
    final = curve.groupBy(*by).agg(F.max_by(value, index).alias("final"))
    c = curve.join(final, by)
    out = final
    for s in shares:
        k = c.where(F.col(value) >= s * F.col("final")).groupBy(*by).agg(F.min(index).alias(f"k_{int(s * 100)}"), F.min_by(value, index).alias(f"value_{int(s * 100)}"))
        out = out.join(k, by, "left")
    return out


def uniform_controls(rng: np.random.Generator, pool: np.ndarray, n: int) -> np.ndarray:
    """n nodes of the pool without replacement."""
    return rng.choice(pool, size=n, replace=False)


def degree_class(degree: int) -> int:
    return degree if degree <= 7 else min(14, degree.bit_length() + 4)


def matched_controls(rng: np.random.Generator, net: expand.Network, seeds: list[int], pool: np.ndarray) -> tuple[list[int], int]:
    """A node like each seed, without replacement: from the nearest degree class that has some, of the
    nearest degree there, at random. Seeds go from the largest degree down. Also how many left their
    class."""
    free: dict[int, dict[int, list[int]]] = {}
    for i in pool.tolist():
        d = int(net.degree[i])
        free.setdefault(degree_class(d), {}).setdefault(d, []).append(i)
    out, moved = [], 0
    for s in sorted(seeds, key=lambda i: (-int(net.degree[i]), i)):
        d = int(net.degree[s])
        c = min(free, key=lambda c: (abs(c - degree_class(d)), c))
        e = min(free[c], key=lambda x: (abs(x - d), x))
        same = free[c][e]
        out.append(same.pop(int(rng.integers(len(same)))))
        moved += c != degree_class(d)
        if not same:
            del free[c][e]
            if not free[c]:
                del free[c]
    return out, moved


def folds(rng: np.random.Generator, seeds: list[int], share: float, n: int = 5) -> list[list[int]]:
    """n choices of hidden seeds, max(1, round half even of the share) each."""
    size = max(1, round(len(seeds) * share))
    return [sorted(rng.choice(seeds, size=size, replace=False).tolist()) for _ in range(n)]


def growth_trace(net: expand.Network, seeds: list[int], added: list[int]) -> list[tuple[int, int, float, int]]:
    """(iteration, seeds in the component with most seeds, their share, its size), from the seeds alone
    on. Ties go to the component of the smallest seed."""
    up = {}

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    size: dict[int, int] = {}
    own: dict[int, int] = {}

    def put(i: int, seed: bool) -> None:
        up[i], size[i], own[i] = i, 1, int(seed)
        for j in net.near(i).tolist():
            if j in up and find(i) != find(j):
                a, b = find(i), find(j)
                up[b] = a
                size[a] += size.pop(b)
                own[a] += own.pop(b)

    order = sorted(seeds)
    for s in order:
        put(s, True)
    out = []
    for i in range(len(added) + 1):
        if i:
            put(added[i - 1], False)
        best = max(order, key=lambda s: own[find(s)]) if order else None
        root = find(best) if best is not None else None
        out.append((i, own[root] if root is not None else 0, own[root] / len(order) if order else 0.0, size[root] if root is not None else 0))
    return out


TRACE = "cell string, entity string, source string, draw int, iteration int, node string, in_lcc long, share double, lcc long, n_seeds int, moved int"


def run_cases(cases: DataFrame, net: expand.Network, budget: int = 100, draws: int = RUNS, seed: int = 42, forbidden: tuple[str, ...] = ()) -> DataFrame:
    """cases(cell, entity, seeds) to traces of real seeds and of both kinds of controls, case by case,
    side by side over the cluster; moved counts the
    matched seeds from another class. Forbidden nodes are never drawn as controls."""
    shared = cases.sparkSession.sparkContext.broadcast(net)

    def go(batches):
        for pdf in batches:
            rows = []
            g = shared.value
            never = g.positions(sorted(forbidden))
            for c in pdf.itertuples(index=False):
                seeds = g.positions(sorted(c.seeds))
                pool = np.setdiff1d(np.arange(len(g)), [*seeds, *never])
                case = zlib.crc32(f"{c.cell}|{c.entity}".encode()) ^ seed
                todo = [("real", 0, seeds, None)]
                for d in range(draws):
                    rng = np.random.default_rng([case, d])
                    if len(pool) >= len(seeds):
                        todo.append(("matched", d, *matched_controls(rng, g, seeds, pool)))
                        todo.append(("uniform", d, uniform_controls(rng, pool, len(seeds)).tolist(), None))
                for source, d, s, moved in todo:
                    added = [x[0] for x in expand.grow(g, s, budget)]
                    for i, n, share, size in growth_trace(g, s, added):
                        rows.append((c.cell, c.entity, source, d, i, g.ids[added[i - 1]] if i else None, n, share, size, len(s), moved))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in TRACE.split(", ")]).astype({"moved": "Int32"})

    return cases.repartition("cell", "entity").mapInPandas(go, TRACE)


def reach(net: expand.Network, seeds: list[int]) -> int:
    """Nodes that the seeds reach, without the seeds."""
    seen, queue = set(seeds), list(seeds)
    while queue:
        for j in net.near(queue.pop()).tolist():
            if j not in seen:
                seen.add(j)
                queue.append(j)
    return len(seen) - len(set(seeds))


RECALL = "cell string, entity string, source string, draw int, share double, fold int, rank int, recall double, hidden long, universe long"


def hidden_recall(cases: DataFrame, net: expand.Network, shares: tuple[float, ...] = (0.1, 0.2, 0.3), budget: int = 100, n: int = 5, nulls: int = 5, seed: int = 42, forbidden: tuple[str, ...] = ()) -> DataFrame:
    """Recall of hidden seeds by rank: n folds of the real seeds for each share, from one generator of
    the case, smaller shares first; and, as what chance gives, n folds of the largest share of each
    of the first `nulls` matched control sets of the traces. universe: nodes that the visible seeds can reach."""
    shared = cases.sparkSession.sparkContext.broadcast(net)

    def go(batches):
        for pdf in batches:
            rows = []
            g = shared.value
            never = g.positions(sorted(forbidden))
            for c in pdf.itertuples(index=False):
                seeds = g.positions(sorted(c.seeds))
                case = zlib.crc32(f"{c.cell}|{c.entity}".encode()) ^ seed
                rng, chance = (np.random.default_rng([case, stream]) for stream in FOLD_STREAMS)
                todo = [("real", 0, s, f, seeds, hidden) for s in shares for f, hidden in enumerate(folds(rng, seeds, s, n) if len(seeds) > 1 else [])]
                pool = np.setdiff1d(np.arange(len(g)), [*seeds, *never])
                for d in range(nulls if 1 < len(seeds) <= len(pool) else 0):
                    own = sorted(matched_controls(np.random.default_rng([case, d]), g, seeds, pool)[0])  # as in the traces
                    todo += [("matched", d, max(shares), f, own, hidden) for f, hidden in enumerate(folds(chance, own, max(shares), n))]
                for source, d, share, f, own, hidden in todo:
                    gone, got = set(hidden), 0
                    visible = [s for s in own if s not in gone]
                    universe = reach(g, visible)
                    for rank, x in enumerate(expand.grow(g, visible, budget), 1):
                        got += x[0] in gone
                        rows.append((c.cell, c.entity, source, d, share, f, rank, got / len(hidden), len(hidden), universe))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in RECALL.split(", ")])

    return cases.repartition("cell", "entity").mapInPandas(go, RECALL)


def mean_of_means(df: DataFrame, case: str, by: list[str], value: str) -> DataFrame:
    """(by, value, cases): the mean over cases of each case's own mean, so a case with many runs
    counts once."""
    one = df.groupBy(*by, case).agg(F.avg(value).alias(value))
    return one.groupBy(*by).agg(F.avg(value).alias(value), F.count("*").alias("cases"))
