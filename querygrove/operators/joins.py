"""Joins and groupings of the graph's building: pairs in a band, similar sets, bridges, fan-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.schema import RELATION_OF
from ..storage import materialise, slices
from .bands import PAIRS_A_TASK, ROWS_A_SIDE, Band


def band_pairs(df: DataFrame, key: str, same: list[str], value: str, width: float) -> DataFrame:
    """(a, b), a < b, of rows that agree in `same` and differ by width at most in value. A row meets
    only its own and the next band, so work follows the pairs found, not the groups' squares."""
    return Band(df, key, same, value, width).pairs()


def jaccard_pairs(sets: DataFrame, key: str, item: str) -> DataFrame:
    """(a, b, similarity) of keys that share an item: as many rows as there are such pairs. Where only
    similar ones are wanted, similar_pairs doesn't make the others."""
    s = sets.select(F.col(key).alias("k"), F.col(item).alias("i")).distinct()
    n = s.groupBy("k").agg(F.count("*").alias("n"))
    both = s.alias("x").join(s.alias("y"), (F.col("x.i") == F.col("y.i")) & (F.col("x.k") < F.col("y.k")))
    both = both.groupBy(F.col("x.k").alias("a"), F.col("y.k").alias("b")).agg(F.count("*").alias("both"))
    both = both.join(n.select(F.col("k").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("k").alias("b"), F.col("n").alias("nb")), "b")
    return both.select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("similarity"))


#: Items that similar_pairs names as common, at most, and the longest set that goes along with its rows.
MOST_COMMON, CARRIED = 100_000, 16


def similar_pairs(sets: DataFrame, key: str, item: str, least: float) -> DataFrame:
    """(a, b, similarity) of keys whose sets have a Jaccard similarity of least, above 0, or more.

    With items in one order for all sets, two such sets share one of the first n - ceil(least n) + 1
    of their items, so pairs come from these alone; common items come last and hardly join. Enough
    items have to follow the first that a pair shares. Sets of CARRIED items or fewer go along with
    their rows, so their pairs are counted in full where they meet, each at its first shared item,
    and never stored; pairs with a larger set are counted by joins. Repeated rows count once; null
    keys and items take no part."""
    if not 0 < least <= 1:
        raise ValueError("least has to be above 0 and no more than 1")
    given = sets.select(F.col(key).alias("k"), F.col(item).alias("i")).dropna()
    rows = given.count()
    parts, some = slices(sets.sparkSession, rows), max(1, min(16, rows // 1_000_000))
    # the order decides how many pairs meet, not which are found, so a sample of the keys is enough for it; it is stored, so that all read one order
    seen = given.where(F.pmod(F.xxhash64("k"), F.lit(some)) == 0).groupBy("i").agg(F.count("*").alias("f")).where(F.col("f") > rows // some // MOST_COMMON + 4)
    common = materialise(seen.orderBy(F.desc("f"), "i").limit(MOST_COMMON), "common")
    s = given.repartition(parts, "k").distinct()  # an exchange by key, which the windows use as well
    own = W.partitionBy("k").orderBy("f", "i")
    placed = s.join(F.broadcast(common), "i", "left").select("k", "i", F.coalesce("f", F.lit(0)).alias("f")).withColumn("place", F.row_number().over(own))
    whole = own.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = placed.select("k", "i", "place", F.count("*").over(whole).alias("n"), F.collect_list(F.when(F.col("place") <= CARRIED, F.col("i"))).over(whole).alias("held"))
    prefix = F.col("place") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1
    first = ranked.where(prefix).withColumn("held", F.when(F.col("n") <= CARRIED, F.col("held")))
    long = not given.groupBy("k").count().where(F.col("count") > CARRIED).isEmpty()
    first = materialise(first, "prefixes") if long else first
    once = first.repartition(parts, "i")  # serves both sides of the join
    x, y = (once.select("i", *(F.col(c).alias(c + end) for c in ("k", "n", "place", "held"))) for end in "ab")
    na, nb = F.col("na"), F.col("nb")
    enough = lambda both: both >= (na + nb - both) * least - 1e-9
    near = (F.col("ka") < F.col("kb")) & enough(1 + F.least(na - F.col("placea"), nb - F.col("placeb")))
    similarity = F.col("both") / (na + nb - F.col("both"))
    small = (na <= CARRIED) & (nb <= CARRIED)
    new = ~F.arrays_overlap(F.slice("helda", 1, F.col("placea") - 1), F.slice("heldb", 1, F.col("placeb") - 1))
    both = F.size(F.array_intersect("helda", "heldb"))
    out = x.join(y, "i").where(near & small & new & enough(both)).select(F.col("ka").alias("a"), F.col("kb").alias("b"), "na", "nb", both.cast("long").alias("both"))
    if long:
        pairs = x.join(y, "i").where(near & ~small).select(F.col("ka").alias("a"), F.col("kb").alias("b"), "na", "nb").distinct()
        large = pairs.join(s.select(F.col("k").alias("a"), "i"), "a").join(s.select(F.col("k").alias("b"), "i"), ["b", "i"], "left_semi")
        out = out.unionByName(large.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("both")))
    return out.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= least)


def either_key(left: DataFrame, right: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """Distinct pairs that agree in any of the keys, nulls aside: a union of equi-joins, each without
    the pairs of those before it. Where rows of one side repeat what is kept of it, pairs are made
    distinct afterwards. Keys with many rows are dealt, so no task has one alone."""
    spark, own = left.sparkSession, [c for c in keep if c in left.columns]
    other = [c for c in keep if c not in left.columns]
    x = left.select(*own, *(F.col(k).alias(f"x_{k}") for k in keys))
    y = right.select(*other, *(F.col(k).alias(f"y_{k}") for k in keys))
    out = None
    for i, k in enumerate(keys):
        sizes = x.groupBy(F.col(f"x_{k}").alias("k")).agg(F.count("*").alias("nx")).join(y.groupBy(F.col(f"y_{k}").alias("k")).agg(F.count("*").alias("ny")), "k")
        pairs, most = sizes.agg(F.sum(F.col("nx").cast("double") * F.col("ny")), F.max("nx")).first()
        parts, deal = min(100_000, slices(spark, int(pairs or 0), PAIRS_A_TASK)), max(1, -(-(most or 0) // ROWS_A_SIDE))
        p = x.withColumn("k", F.col(f"x_{k}")).withColumn("deal", F.pmod(F.xxhash64(*own), F.lit(deal)))
        q = y.withColumn("k", F.col(f"y_{k}")).withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deal - 1).cast("long"))))
        one = p.repartition(parts, "k", "deal").join(q.repartition(parts, "k", "deal").hint("shuffle_hash"), ["k", "deal"])
        for before in keys[:i]:
            one = one.where(~F.coalesce(F.col(f"x_{before}") == F.col(f"y_{before}"), F.lit(False)))
        out = one.select(*keep) if out is None else out.unionByName(one.select(*keep))
    whole = all(df.groupBy(*c).count().where("count > 1").isEmpty() for df, c in ((x, own), (y, other)))
    return out if whole else out.distinct()


def bridge(groups: DataFrame, direct: DataFrame, index: DataFrame, mapping: DataFrame) -> DataFrame:
    """(target, source): groups by id, then mapped ids whose source no group has taken.

    groups(id, target), index(id, source), direct(id, target), mapping(id, source). A group that the
    index lacks is an error."""
    lost = [r[0] for r in groups.join(index, "id", "left_anti").orderBy("id").select("id").take(5)]
    if lost:
        raise ValueError(f"groups without a source: {', '.join(map(str, lost))}")
    first = groups.join(index, "id").select("target", "source")
    rest = direct.join(mapping, "id").select("target", "source").join(first.select("source"), "source", "left_anti").select("target", "source")
    return first.unionByName(rest)


def first_per(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key by an explicit order."""
    return df.withColumn("__rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rank = 1").drop("__rank")


def merge_origin(df: DataFrame, keys: list[str], origin: str = "origin") -> DataFrame:
    """One row per key: `both` if its origins differ or one is `both`, else the one."""
    n, low = F.countDistinct(origin), F.min(origin)
    return df.groupBy(*keys).agg(F.when((n > 1) | (F.max(F.col(origin) == "both")), F.lit("both")).otherwise(low).alias(origin))


def join_distinct(col: Column | str, sep: str = "|") -> Column:
    """Aggregate: distinct values in order, as one text; nulls aside."""
    return F.array_join(F.sort_array(F.collect_set(col)), sep)


def join_ordered(value: Column | str, order: Column | str, sep: str = " | ") -> Column:
    """Aggregate: all values by the order of another column, as one text."""
    by, what = (F.col(order) if isinstance(order, str) else order), (F.col(value) if isinstance(value, str) else value)
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by.alias("o"), what.alias("v")))), lambda x: x["v"]), sep)


def fan_out(edges: DataFrame, members: DataFrame) -> DataFrame:
    """edges(c1, c2, weight) between clusters, over members(cluster, member): an edge for each pair
    of members; edges within a cluster are dropped. Members are dealt to blocks, and a task has pairs
    of blocks, so pairs spread evenly however few the clusters."""
    e = edges.where("c1 <> c2")
    n = members.groupBy("cluster").agg(F.count("*").alias("n"))
    size = lambda c, name: n.select(F.col("cluster").alias(c), F.col("n").alias(name))
    pairs = e.join(size("c1", "p"), "c1").join(size("c2", "q"), "c2").agg(F.sum(F.col("p").cast("double") * F.col("q"))).first()[0] or 0
    most = n.agg(F.max("n")).first()[0] or 0
    blocks = max(1, -(-most // ROWS_A_SIDE))
    parts = min(100_000, slices(edges.sparkSession, int(pairs), PAIRS_A_TASK))
    held = lambda c, m, b: members.select(F.col("cluster").alias(c), F.col("member").alias(m), F.pmod(F.xxhash64("member"), F.lit(blocks)).alias(b))
    other = lambda b: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias(b)
    x = e.join(held("c1", "a", "b1"), "c1").select("*", other("b2")).repartition(parts, "c1", "c2", "b1", "b2")
    y = e.select("c1", "c2").distinct().join(held("c2", "b", "b2"), "c2").select("*", other("b1")).repartition(parts, "c1", "c2", "b1", "b2")
    return x.join(y.hint("shuffle_hash"), ["c1", "c2", "b1", "b2"]).select("a", "b", F.bround("weight", 4).alias("weight"))


def number_from(df: DataFrame, start: int, *order: Column | str, into: str = "node_index") -> DataFrame:
    """Consecutive numbers from start by an order of the whole table, nulls first and ties as they
    come. Rows are sorted in ranges and counted by range, so no task sees all of them."""
    by = [F.col(o) if isinstance(o, str) else o for o in order]
    dealt = df.select("*", *(o.alias(f"__o{i}") for i, o in enumerate(by)))
    keys = [f"__o{i}" for i in range(len(by))]
    parts = dealt.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id())
    parts = materialise(parts, "ranges")
    size = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    ahead = size.select("__part", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"))  # a row for each range
    place = F.col("__ahead") + F.row_number().over(W.partitionBy("__part").orderBy(*keys))
    numbered = parts.join(F.broadcast(ahead), "__part").withColumn(into, F.lit(start) + place - 1)
    return numbered.drop("__part", "__ahead", *keys)


def require_one_to_one(df: DataFrame, key: str) -> DataFrame:
    """df, or an error that names some keys that occur more than once."""
    bad = [r[0] for r in not_one_to_one(df, key).orderBy(key).select(key).take(5)]
    if bad:
        raise ValueError(f"{key} isn't one to one: {', '.join(map(str, bad))}")
    return df


def stack(*families: DataFrame) -> DataFrame:
    """Rows of all families, null where a family lacks a column."""
    out = families[0]
    for f in families[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def not_one_to_one(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(key).count().where("count > 1")


def relations(edges: DataFrame, star: DataFrame, group: str = "DISEASE_BERT") -> DataFrame:
    """edges(x, y, edge_type) with relation: by the registry of types, or group for a pair that
    star(x, y) has in either direction. A type that the registry lacks is an error where the rows
    are read."""
    known = F.create_map(*(F.lit(v) for kv in RELATION_OF.items() for v in kv))
    mapped = F.coalesce(known[F.col("edge_type")], F.raise_error(F.concat(F.lit("no relation for the edge type "), F.col("edge_type"))))
    lo, hi = F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")
    pairs = star.select(lo, hi).distinct().withColumn("star", F.lit(True))
    e = edges.select("*", lo, hi).join(pairs, ["lo", "hi"], "left")
    return e.select(*edges.columns, F.when(F.col("star"), group).otherwise(mapped).alias("relation"))


def accession_join(compounds: DataFrame, genes: DataFrame, graph_genes: DataFrame, sep: str = ",") -> DataFrame:
    """(drug, gene, tag): compounds(drug, targets, tag) and genes(accession, gene_ids), both with
    several ids in one text, taken apart, trimmed and joined on the accession; only genes(id) of the
    graph stay, each pair and tag once."""
    t = compounds.select("drug", F.explode(F.split("targets", sep)).alias("accession"), "tag").withColumn("accession", F.trim("accession"))
    g = genes.select(F.trim("accession").alias("accession"), F.explode(F.split("gene_ids", ";")).alias("gene")).withColumn("gene", F.trim("gene")).where("gene <> ''")
    return t.join(g, "accession").join(graph_genes.select(F.col("id").alias("gene")), "gene", "left_semi").select("drug", "gene", "tag").distinct()


def project_ids(df: DataFrame, ids: list[str], rest: list[str]) -> DataFrame:
    """df with all of the columns named, in order: optional ids that it lacks are null, and those that
    are empty or a text for none become null."""
    there = set(df.columns)
    clean = lambda c: F.when(F.trim(F.col(c).cast("string")).isin("", "nan", "None"), None).otherwise(F.trim(F.col(c).cast("string")))
    return df.select(*((clean(c) if c in there else F.lit(None).cast("string")).alias(c) for c in ids), *rest)
