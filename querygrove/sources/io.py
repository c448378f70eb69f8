"""Readers and sinks. Every reader takes an explicit schema or reads text, so ids stay as written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv(spark: SparkSession, path: str, schema: T.StructType | None = None, columns: list[str] | None = None, **options) -> DataFrame:
    """A file with a header; without a schema all columns are text."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').options(**options)
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    return df.select(*columns) if columns else df


def tsv(spark: SparkSession, path: str, columns: dict[int, str] | None = None, header: bool = False) -> DataFrame:
    """Tab-separated text, compressed or not; without a header, columns by position."""
    df = spark.read.option("sep", "\t").option("header", header).option("quote", "").csv(path)
    return df.select(*(F.col(f"_c{k}").alias(v) for k, v in columns.items())) if columns else df


def parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def questions(spark: SparkSession, path: str, kind: str = "type", gold: str = "exact_answer") -> DataFrame:
    """One row per question of a nested file {"questions": [...]}. `gold` holds JSON, whose shape
    depends on the kind; a factoid's one item is wrapped into a list as `gold_items`, null for those
    without items."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "questions array<string>")["questions"]).alias("q"))
    one = F.get_json_object("q", f"$.{gold}")
    names = spark.read.option("multiLine", True).json(path).select(F.explode("questions").alias("q")).select("q.*").schema
    rows = raw.select(F.from_json("q", names).alias("r"), one.alias("__gold"), F.get_json_object("q", f"$.{kind}").alias("__kind")).select("r.*", "__gold", "__kind")
    nested, flat = F.from_json("__gold", "array<array<string>>"), F.from_json("__gold", "array<string>")
    items = F.when(F.col("__kind") == "factoid", F.array(flat)).when(F.col("__gold").startswith("[["), nested).when(F.col("__gold").startswith("["), F.transform(flat, lambda x: F.array(x)))
    return rows.withColumn("gold_items", F.when(F.col("__gold").isNotNull(), items)).drop("__gold", "__kind")


def json_lines(spark: SparkSession, path: str, schema: T.StructType, key: str, order: str | None = None) -> DataFrame:
    """JSON lines of which the last of each key counts; order defaults to the place in the files."""
    df = spark.read.schema(schema).json(path)
    by = F.col(order) if order else F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id())
    return df.withColumn("__at", by).withColumn("__rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("__at")))).where("__rank = 1").drop("__at", "__rank")


def responses(spark: SparkSession, glob: str, schema: T.StructType, pattern: str, groups: dict[str, int], abstention: str | None = None, answer: str = "answer") -> DataFrame:
    """Response files that ended well, with keys taken from their paths; with the text of an
    abstention, `abstains` says which answers hold it."""
    df = spark.read.schema(schema).option("multiLine", True).json(glob).withColumn("__path", F.col("_metadata.file_path")).where("code = 0")
    df = df.select("*", *(F.regexp_extract("__path", pattern, g).alias(k) for k, g in groups.items())).drop("__path")
    return df if abstention is None else df.withColumn("abstains", F.coalesce(F.col(answer).contains(abstention), F.lit(False)))


def cells(spark: SparkSession, path: str, cell: str = "cell", only: list[str] | None = None) -> DataFrame:
    """Traces of all cases, kept as one dataset that is partitioned by cell; only the cells named are
    read."""
    df = spark.read.parquet(path)
    return df.where(F.col(cell).isin(*only)) if only else df


def static_index(spark: SparkSession, path: str, log: str, marker: str) -> DataFrame:
    """(seconds, calls, tokens) of the whole graph's index, from its record and its log."""
    s = spark.read.schema("seconds_total double").option("multiLine", True).json(path).select(F.col("seconds_total").alias("seconds"))
    u = log_usage(spark, log, marker).agg(F.sum("calls").alias("calls"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"))
    return s.unionByName(u, allowMissingColumns=True).agg(*(F.max(c).alias(c) for c in ("seconds", "calls", "tokens")))


def log_usage(spark: SparkSession, glob: str, marker: str) -> DataFrame:
    """Calls and tokens in the last metrics block after a marker of each log."""
    df = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    block = F.regexp_extract(F.substring_index("value", marker, -1), r"(?s)(\{.*?\n\})", 1)
    got = F.from_json(block, "calls long, prompt_tokens long, completion_tokens long")
    return df.select("path", got.alias("m")).select("path", "m.*")


def cache_usage(spark: SparkSession, glob: str) -> DataFrame:
    """Files and tokens of a folder of cached calls."""
    schema = "result struct<usage:struct<prompt_tokens:long,completion_tokens:long>>"
    u = spark.read.schema(schema).option("multiLine", True).json(glob).select("result.usage.*")
    return u.agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))


def read_through(spark: SparkSession, path: str, make) -> DataFrame:
    """A stored table; made and stored where it isn't there yet."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the newest of new by order, else what was there."""
    w = W.partitionBy(*keys).orderBy(F.desc("__new"), F.desc(order))
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return both.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__new", "__rank")


def upsert_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One edge per ends and type; edges with an end that isn't there vanish."""
    ids = nodes.select("label", "id")
    a = ids.select(F.col("label").alias("label_a"), F.col("id").alias("id_a"))
    b = ids.select(F.col("label").alias("label_b"), F.col("id").alias("id_b"))
    return edges.join(a, ["label_a", "id_a"], "left_semi").join(b, ["label_b", "id_b"], "left_semi").dropDuplicates(["type", "label_a", "id_a", "label_b", "id_b"])


def without_label(nodes: DataFrame, edges: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """A graph without a label's nodes and their edges, ready for the layer's new version."""
    return nodes.where(F.col("label") != label), edges.where((F.col("label_a") != label) & (F.col("label_b") != label))


def pending(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work without a result yet."""
    return plan.join(done, keys, "left_anti")


def write(df: DataFrame, path: str, form: str = "parquet", partition: list[str] | None = None) -> None:
    """Replace a table as parquet, csv or json; arrays become |-joined text in csv."""
    if form == "csv":
        flat: list[Column] = [F.array_join(c, "|").alias(c) if t.startswith("array<string") else F.col(c) for c, t in df.dtypes]
        df = df.select(*flat)
    w = df.write.mode("overwrite").partitionBy(*(partition or []))
    (w.option("header", True).csv(path) if form == "csv" else w.format(form).save(path))
