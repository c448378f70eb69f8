"""From mentions to nodes: a vote dictionary, exact forms, word windows, ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

#: Kinds that mentions have.
KINDS = ("Gene", "Disease", "Drug")
#: Words that say nothing alone.
EMPTY_WORDS = ("of", "the", "and", "or", "with", "without", "in", "to", "a", "an", "s", "disease", "diseases", "syndrome", "disorder", "disorders", "nos", "unspecified", "type")
GENERIC_WORDS = (
    "gene", "genes", "protein", "proteins", "drug", "drugs", "mutation", "mutations", "inhibitor", "inhibitors", "patients", "cancer", "tumor", "molecule", "molecules", "variant", "variants",
    "polymorphism", "polymorphisms", "therapy", "treatment", "receptor", "kinase", "kinases", "enzyme", "enzymes", "phenotype", "phenotypes", "genetic", "loci", "locus",
)
#: Fixed value: tied nodes that are all returned.
MOST_TIED = 2


def mentions(answers: DataFrame, column: str, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """answers exploded to (text, kind, english) of the mentions in a JSON column; bad JSON has none."""
    schema = "menciones array<struct<texto:string,tipo:string,nombre_en_ingles:string>>"
    m = answers.withColumn("m", F.explode(F.from_json(column, schema, {"mode": "PERMISSIVE"})["menciones"]))
    m = m.where(F.col("m.tipo").isin(*kinds) & (F.coalesce("m.texto", F.lit("")) != ""))
    return m.select("*", F.col("m.texto").alias("text"), F.col("m.tipo").alias("kind"), F.coalesce(F.nullif(F.col("m.nombre_en_ingles"), F.lit("")), "m.texto").alias("english")).drop("m")


def names(nodes: DataFrame, group_prefix: str | None = None) -> DataFrame:
    """(kind, id, name): names of nodes, without groups and bare compound codes."""
    n = nodes.where(~F.col("is_group") & F.col("name").isNotNull() & ~F.col("name").rlike(r"^CHEMBL\d+$"))
    return n.select(F.col("label").alias("kind"), "id", "name")


def synonyms(table: DataFrame, known: DataFrame, short: int = 3) -> DataFrame:
    """table(kind, id, source, forms), forms |-separated, as (kind, id, name) of known nodes: brackets
    off, and forms that aren't the name need `short` characters or more."""
    s = table.select("kind", "id", "source", F.explode(F.split("forms", r"\|")).alias("name"))
    s = s.where((F.col("source") == "name") | (F.length("name") >= short))
    return s.select("kind", "id", X.without_brackets(F.col("name")).alias("name")).join(known.select("kind", "id"), ["kind", "id"], "left_semi")


def dictionary(named: DataFrame, level: int, normal=X.normalised) -> DataFrame:
    """(level, kind, form, id, votes) of (kind, id, name)."""
    f = named.withColumn("form", X.form(normal(F.col("name")))).where("form <> ''")
    return f.groupBy("kind", "form", "id").agg(F.count("*").alias("votes")).withColumn("level", F.lit(level))


def exact(candidates: DataFrame, words: DataFrame, node_names: DataFrame, normal=X.normalised) -> DataFrame:
    """candidates(mention, kind, place, name) to (mention, kind, id): of the first level, and there the
    first candidate, that has votes, the nodes that most vote for. Ties are untied once for each set of
    forms, not for each mention that has it."""
    c = candidates.withColumn("form", X.form(normal(F.col("name")))).where("form <> ''")
    hit = c.join(words.select("kind", "form", "level").distinct(), ["kind", "form"])
    first = hit.withColumn("first", F.dense_rank().over(W.partitionBy("mention", "kind").orderBy("level", "place"))).where("first = 1")
    first = first.groupBy("mention", "kind", "level").agg(F.array_sort(F.collect_set("form")).alias("forms")).withColumn("asked", F.to_json(F.struct("level", "forms")))
    forms = first.select("kind", "level", "forms", "asked").distinct().select("kind", "level", F.col("asked").alias("mention"), F.explode("forms").alias("form"))
    nodes = untied(forms.join(words, ["kind", "level", "form"]), node_names, normal).select(F.col("mention").alias("asked"), "kind", "id")
    return first.select("mention", "kind", "asked").join(nodes, ["kind", "asked"]).select("mention", "kind", "id")


def untied(votes: DataFrame, node_names: DataFrame, normal=X.normalised) -> DataFrame:
    """The nodes of most votes of each mention: two at most, or of more the one whose name has the
    fewest words, then characters, then the smallest id."""
    w = W.partitionBy("mention", "kind")
    top = votes.groupBy("mention", "kind", "id").agg(F.max("votes").alias("votes"))
    top = top.withColumn("r", F.rank().over(w.orderBy(F.desc("votes")))).where("r = 1").withColumn("tied", F.count("*").over(w))
    named = top.join(node_names.select("kind", "id", "name"), ["kind", "id"], "left")
    n = F.coalesce(normal(F.col("name")), F.lit(""))
    place = F.row_number().over(w.orderBy(F.size(F.split(n, " ")), F.length("name"), "id"))
    return named.withColumn("place", place).where((F.col("tied") <= MOST_TIED) | (F.col("place") == 1)).drop("r", "place")


def windows(normal: Column) -> Column:
    """Contiguous word windows as (length, start, words), those of nothing but empty words aside."""
    w = F.split(normal, " ")
    none = F.array(*map(F.lit, EMPTY_WORDS + GENERIC_WORDS))
    at = F.sequence(F.lit(1), F.size(w))
    spans = F.flatten(F.transform(at, lambda n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda s: F.struct(n.alias("length"), s.alias("start"), F.slice(w, s, n).alias("words")))))
    return F.filter(spans, lambda x: F.size(F.array_except(x["words"], none)) > 0)


def segments(missed: DataFrame, words: DataFrame, node_names: DataFrame, normal=X.normalised) -> DataFrame:
    """missed(mention, kind, name) of diseases: the longest window that hits, the rightmost of those."""
    s = missed.where("kind = 'Disease'").select("mention", "kind", F.explode(windows(normal(F.col("name")))).alias("w"))
    s = s.select("mention", "kind", F.struct(-F.col("w.length"), -F.col("w.start")).alias("place"), F.array_join("w.words", " ").alias("name"))
    order = F.dense_rank().over(W.partitionBy("mention", "kind").orderBy("place"))
    return exact(s.withColumn("place", order), words, node_names, normal)


def link(found: DataFrame, words: DataFrame, node_names: DataFrame, normal=X.normalised) -> DataFrame:
    """found(mention, kind, text, english) to (mention, kind, id, how): the name without brackets, the
    text without, what brackets hold; else windows of the name."""
    options = F.concat(F.array(X.without_brackets(F.col("english")), X.without_brackets(F.col("text"))), X.in_brackets(F.col("text")))
    c = found.select("mention", "kind", F.posexplode(options).alias("place", "name"))
    hits = exact(c, words, node_names, normal).withColumn("how", F.lit("diccionario"))
    missed = found.join(hits, ["mention", "kind"], "left_anti").select("mention", "kind", X.without_brackets(F.col("english")).alias("name"))
    return hits.unionByName(segments(missed, words, node_names, normal).withColumn("how", F.lit("segmentos")))


def same_sets(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(question, same): whether both have the same (label, id) for a question; a question that one of
    them lacks has none there."""
    both = found.select("question", "label", "id", F.lit(1).alias("f"), F.lit(0).alias("e")).unionByName(expected.select("question", "label", "id", F.lit(0).alias("f"), F.lit(1).alias("e")))
    one = both.groupBy("question", "label", "id").agg(F.max("f").alias("f"), F.max("e").alias("e"))
    return one.groupBy("question").agg(F.min((F.col("f") == F.col("e")).cast("int")).cast("boolean").alias("same"))
