"""Mixing sources to target weights by systematic sampling.

All of it is DataFrame expressions. Every document of a source expects the same number of copies,
the source's target over its size. Along an order of the source's documents the expected copies
are summed up, one offset per source is added, and a document is emitted once for each integer
that its step crosses. The order goes by hashed bins and by size within a bin: the sum of a bin is
a count, so the prefix sum over a source is one over its bins (a small table) plus a row number
inside a bin, and a source with a third of all rows is dealt over all of its bins. As sizes rise
within a bin, the words taken stay close to the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import WORD, materialise, read, row_count

WEIGHTS = (3, 1, 2)
#: Documents of a bin, on average.
BIN_ROWS = 2_000


def size_of(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _hex(col: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(col.cast("binary")), 1, digits), 16, 10).cast("long")


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, ceiling: int = 2) -> DataFrame:
    """by_source(key, source, source_size) with target: the sources, by code point with null last,
    weigh `weights`, repeating, and share percent of all sizes; none gets more than ceiling times
    its size, and the excess is shared again by weight. In order of size over weight, the sources
    at their ceiling come first; the first that its share of the rest fits in sets the level."""
    every = W.partitionBy(F.lit(0))
    rank = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last()))
    s = by_source.withColumn("rank", rank)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", ceiling * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = every.orderBy("ratio", "rank").rowsBetween(W.unboundedPreceding, -1)
    spent, gone = F.coalesce(F.sum("cap").over(before), F.lit(0)), F.coalesce(F.sum("weight").over(before), F.lit(0))
    pot = F.sum("source_size").over(every).cast("double") * (percent / 100)
    s = s.withColumn("level", (pot - spent.cast("double")) / (F.sum("weight").over(every) - gone).cast("double"))
    fits = F.when(F.col("level") <= F.col("ratio"), F.col("level"))
    s = s.withColumn("level", F.first(fits, ignorenulls=True).over(every.orderBy("ratio", "rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return s.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level"))).select("key", "source_size", "target")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, ceiling: int = 2, seed: str = "mix", bin_rows: int = BIN_ROWS, tie: str | None = None) -> DataFrame:
    """docs(doc_id, source, size long, ...) with source_size, target and copies.

    Rows with a null source form a source of their own; null ids are one more id. Repeated rows
    are mixed one by one. Null and empty texts have size 0 and are drawn at their source's rate;
    very long ones count all of their words. Rows of equal size in a bin go by id, then by the
    column `tie`, which tells apart what must not be swapped when a task is repeated. An empty
    source, or one without words, has target 0 and no copies; an empty table stays empty. Columns
    named source_size, target or copies give way, as does `tie`; others stay.
    """
    bins = max(1, -(-row_count(docs) // bin_rows))
    names = [c for c in docs.columns if c not in ("source_size", "target", "copies", tie)]
    order = ["size", "doc_id", *([tie] if tie else [])]
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    d = docs.select(*names, *order[2:], key.alias("__key"), (_hex(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 8) % bins).alias("__bin"))
    per_bin = d.groupBy("__key", "__bin").agg(F.first("source").alias("source"), F.count("*").alias("n"), F.sum("size").alias("s"))
    per_bin = materialise(per_bin, "bins")
    per_source = per_bin.groupBy("__key").agg(F.first("source").alias("source"), F.sum("s").alias("source_size"))
    t = targets(per_source.withColumnRenamed("__key", "key"), weights, percent, ceiling).withColumnRenamed("key", "__key")
    ahead = F.coalesce(F.sum("n").over(W.partitionBy("__key").orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = per_bin.select("__key", "__bin", ahead.alias("__ahead")).join(t, "__key")
    place = F.col("__ahead") + F.row_number().over(W.partitionBy("__key", "__bin").orderBy(*order))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _hex(F.concat(F.lit(seed), F.col("__key")), 3) / 4096.0
    passed = lambda k: F.floor(k * F.col("__rate") + F.col("__offset"))
    out = d.join(starts, ["__key", "__bin"]).select(*names, "source_size", "target", rate.alias("__rate"), offset.alias("__offset"), place.alias("__place"))
    copies = F.least(passed(F.col("__place")) - passed(F.col("__place") - 1), F.lit(ceiling))
    return out.select(*names, "source_size", "target", copies.cast("long").alias("copies"))


def emit(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself: each row of docs(doc_id, text, source, ...) as often as it was drawn, with all
    of its columns, whatever they are called. See mix for nulls, repeats and empty tables."""
    told = F.xxhash64(*(c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()))
    rows = docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "source", size_of(F.col("text")).alias("size"), told.alias("__tie"))
    out = mix(rows, tie="__tie", **kw).where("copies > 0")
    return out.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__row.*")


def op2_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document; see mix for nulls, repeats and ties. Rows of one id and
    size take alike in number, whichever of them a repeated task takes first."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", size_of(F.col("text")).alias("size"))
    mixed = mix(materialise(docs, "sizes"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  coalesce('s' || source, 'n') AS key,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % (SELECT greatest(1, (count(*) + 1999) // 2000) FROM documents) AS bin FROM documents),
s AS (SELECT key, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY key),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM s),
w AS (SELECT *, [3, 1, 2][(rank - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM r),
q AS (SELECT *, CAST(cap AS DOUBLE) / weight AS ratio FROM w),
c AS (SELECT *, (CAST((SELECT sum(source_size) FROM q) AS DOUBLE) * 1.5 - CAST(coalesce(sum(cap) OVER b, 0) AS DOUBLE))
  / CAST((SELECT sum(weight) FROM q) - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level FROM q
  WINDOW b AS (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT level FROM c WHERE level <= ratio ORDER BY ratio, rank LIMIT 1),
t AS (SELECT key, source_size, least(CAST(cap AS DOUBLE), weight * (SELECT level FROM v)) AS target FROM c),
p AS (SELECT d.*, source_size, target, row_number() OVER (PARTITION BY d.key ORDER BY bin, size, doc_id) AS k,
  CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
  CAST('0x' || substr(md5('mix' || d.key), 1, 3) AS BIGINT) / 4096.0 AS u FROM d JOIN t USING (key))
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(least(floor(k * rate + u) - floor((k - 1) * rate + u), 2) AS BIGINT) * size AS taken FROM p
"""
