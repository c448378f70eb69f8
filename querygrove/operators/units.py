"""Text units: titled entities, worded relationships and the texts that hold both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from .joins import number_from

#: Words to which a node's own text is cut, and the document that holds all units.
MOST_WORDS, DOCUMENT = 150, "subgrafo"


def titles(nodes: DataFrame) -> DataFrame:
    """nodes(label, id, name) with title: the name in capitals; repeated ones get the label, and what
    is still repeated the id."""
    upper = F.upper(F.coalesce("name", "id"))
    t = nodes.withColumn("t1", upper).withColumn("n1", F.count("*").over(W.partitionBy("t1")))
    t = t.withColumn("t2", F.when(F.col("n1") > 1, F.concat("t1", F.lit(" ("), F.upper("label"), F.lit(")"))).otherwise(F.col("t1")))
    t = t.withColumn("n2", F.count("*").over(W.partitionBy("t2")))
    return t.withColumn("title", F.when(F.col("n2") > 1, F.concat("t2", F.lit(" ["), "id", F.lit("]"))).otherwise(F.col("t2"))).drop("t1", "n1", "t2", "n2")


def relationships(edges: DataFrame, titled: DataFrame) -> DataFrame:
    """(r, source, target, id_a, id_b, description, weight, combined_degree): an edge a row, numbered
    by type and ends from 0 (edges is one question's subgraph)."""
    n = lambda end: titled.select(F.col("label").alias(f"label_{end}"), F.col("id").alias(f"id_{end}"), F.col("title").alias(f"title_{end}"))
    e = edges.join(n("a"), ["label_a", "id_a"]).join(n("b"), ["label_b", "id_b"])
    ends = edges.select(F.explode(F.array("id_a", "id_b")).alias("id"))
    d = ends.groupBy("id").agg(F.count("*").alias("degree"))
    e = e.join(d.select(F.col("id").alias("id_a"), F.col("degree").alias("d_a")), "id_a").join(d.select(F.col("id").alias("id_b"), F.col("degree").alias("d_b")), "id_b")
    say = X.sentence(F.col("type"), F.col("title_a"), F.col("label_a"), F.col("title_b"))
    e = number_from(e, 0, "type", "id_a", "id_b", into="r")
    return e.select("r", "type", F.col("title_a").alias("source"), F.col("title_b").alias("target"), "id_a", "id_b", say.alias("description"), F.lit(1.0).alias("weight"), (F.col("d_a") + F.col("d_b")).alias("combined_degree"))


def _own(titled: DataFrame, texts: DataFrame | None, most_words: int) -> DataFrame:
    """titled with `text`: the node's own, cut to whole sentences of most_words words; null without one."""
    if texts is None:
        return titled.withColumn("text", F.lit(None).cast("string"))
    return titled.join(texts.select("label", "id", X.shortened(F.col("text"), most_words).alias("text")), ["label", "id"], "left")


def entities(titled: DataFrame, edges: DataFrame, texts: DataFrame | None = None, most_words: int = MOST_WORDS) -> DataFrame:
    """(id, title, type, description, degree): the label, the title, and a shortened text if there is
    one. Degrees are those of a node, by label and id."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("label_a").alias("label"), F.col("id_a").alias("id")), F.struct(F.col("label_b").alias("label"), F.col("id_b").alias("id")))).alias("e")).select("e.*")
    return described(titled, ends.groupBy("label", "id").agg(F.count("*").alias("degree")), texts, most_words)


def described(titled: DataFrame, degrees: DataFrame, texts: DataFrame | None = None, most_words: int = MOST_WORDS) -> DataFrame:
    """The rows of entities from degrees(label, id, degree); nodes without one have 0."""
    e = _own(titled.join(degrees, ["label", "id"], "left"), texts, most_words)
    say = F.concat("label", F.lit(" "), "title", F.lit("."), F.coalesce(F.concat(F.lit(" "), "text"), F.lit("")))
    return e.select("label", "id", "title", F.upper("label").alias("type"), say.alias("description"), F.coalesce("degree", F.lit(0)).alias("degree"))


def text_units(titled: DataFrame, relations: DataFrame, texts: DataFrame | None = None, most_words: int = MOST_WORDS) -> DataFrame:
    """(label, id, text, n_tokens, relationship_ids): a node's shortened text, if any, and the sentences
    of its edges in the order of the relationships; tokens are words."""
    sent = relations.select(F.explode(F.array("id_a", "id_b")).alias("id"), "r", "description")
    s = sent.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("r", "description"))).alias("s"))
    u = _own(titled.join(s, "id", "left"), texts, most_words)
    none = F.array().cast("array<string>")
    parts = F.concat(F.when(F.col("text").isNotNull(), F.array("text")).otherwise(none), F.coalesce(F.transform("s", lambda x: x["description"]), none))
    text = F.array_join(parts, " ")
    tokens = F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), r"\s+")))
    return u.select("label", "id", text.alias("text"), tokens.alias("n_tokens"), F.coalesce(F.transform("s", lambda x: F.concat(F.lit("r"), x["r"].cast("string"))), none).alias("relationship_ids"))


def unit_tables(nodes: DataFrame, edges: DataFrame, texts: DataFrame | None = None, most_words: int = MOST_WORDS) -> dict[str, DataFrame]:
    """The tables of entities, relationships and text_units of a subgraph, nodes(label, id, name) and
    its edges, with all of their columns. Rows are numbered by label and id, or by type and ends."""
    titled = titles(nodes).select("label", "id", "title")
    rel = relationships(edges, titled)
    tag = lambda head, c: F.concat(F.lit(head), c)
    e = number_from(entities(titled, edges, texts, most_words), 0, "label", "id", into="human_readable_id")
    u = number_from(text_units(titled, rel, texts, most_words), 0, "label", "id", into="human_readable_id")
    return {
        "entities": e.select(tag("e_", F.col("id")).alias("id"), "human_readable_id", "title", "type", "description", F.array(tag("t_", F.col("id"))).alias("text_unit_ids"), F.lit(1).alias("frequency"), "degree"),
        "relationships": rel.select(tag("r", F.col("r").cast("string")).alias("id"), F.col("r").alias("human_readable_id"), "source", "target", "description", "weight", "combined_degree", F.array(tag("t_", F.col("id_a")), tag("t_", F.col("id_b"))).alias("text_unit_ids")),
        "text_units": u.select(tag("t_", F.col("id")).alias("id"), "human_readable_id", "text", "n_tokens", F.lit(DOCUMENT).alias("document_id"), F.array(tag("e_", F.col("id"))).alias("entity_ids"), "relationship_ids", F.array().cast("array<string>").alias("covariate_ids")),
    }
