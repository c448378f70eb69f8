"""Connected components of an edge table by alternating large and small stars.

Each round is two grouped minima and two joins; rounds grow with the logarithm of the longest
path. Nothing but a few numbers a round reaches the driver, and each round's edges are written to
the shared folder, so lineage stays short and a lost executor repeats one round at most. A hub, a
node with a large part of all edges, is looked up from a broadcast list whose length is bounded by
construction, so its edges stay spread over the tasks that read them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import drop, materialise

#: Groups of more rows than this are hubs. At most MOST_HUBS are broadcast: with n rows in all, a
#: group counts as a hub from n / MOST_HUBS rows on.
HUB_ROWS, MOST_HUBS = 256, 50_000


def twice(df: DataFrame, keep: list[str], *ways: dict[str, str]) -> DataFrame:
    """Each row once for each way of naming its columns, in one pass over what df is derived from."""
    seen = F.explode(F.array(*(F.struct(*(F.col(old).alias(new) for new, old in w.items())) for w in ways)))
    return df.select(*keep, seen.alias("__way")).select(*keep, *(F.col(f"__way.{c}").alias(c) for c in ways[0]))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str = "n", total: int | None = None) -> DataFrame:
    """rows joined to groups(key, size, ...), one row a key, without sending a large group's rows to
    one task. groups has to be a stored table; size is how many rows carry the key, total the sum of
    these."""
    if total is None:
        total = groups.agg(F.sum(size)).first()[0] or 0
    least = max(HUB_ROWS, -(-total // MOST_HUBS))
    large = groups.where(F.col(size) > least)
    if large.isEmpty():
        return rows.join(groups, key)
    hubs = F.broadcast(large)
    small = groups.where(F.col(size) <= least)
    return rows.join(hubs, key).unionByName(rows.join(F.broadcast(large.select(key)), key, "left_anti").join(small, key))


def _state(edges: DataFrame) -> tuple[int, int]:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _with_least(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """rows(u, v) with m, the least v of their u; and the stored table that this reads."""
    low = materialise(rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
    return join_groups(rows, low, "u", total=most).drop("n"), low


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges(u, v), in any direction, repeats and loops allowed; nulls take no part. Returns (node,
    root) for every node of a component of two or more, root being its smallest. Raises if
    most_rounds don't settle it, which takes paths of about 2 ** most_rounds nodes."""
    spark = edges.sparkSession
    e = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    now = _state(e)
    for _ in range(most_rounds):
        if not now[0]:
            break
        both, low = _with_least(twice(e, [], {"u": "u", "v": "v"}, {"u": "v", "v": "u"}), 2 * now[0])
        large = materialise(both.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "edges")
        near, least = _with_least(large, 2 * now[0])
        small = twice(near, [], {"u": "v", "v": "m"}, {"u": "u", "v": "m"}).where("u <> v").distinct()
        after = materialise(small, "edges")
        for t in (e, low, large, least):
            drop(spark, t)
        e, before, now = after, now, _state(after)
        if now == before:
            break
    else:
        raise RuntimeError(f"components are not settled after {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
