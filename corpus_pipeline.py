"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the docs of the next. All but the last return the columns of documents. Empty tables stay
empty through all stages, very long texts are read whole, and further columns, whatever they are
called, stay through all but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querygrove.llm import mixing, neardup, packing, private, quality
from querygrove.llm.shared import materialise, read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the cascade keep. Null and empty texts, having too few words,
    go; null ids stay, repeated rows stay or go together, other columns stay as they are."""
    return quality.annotate(docs, into="__quality").where("__quality.kept").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that with the smallest id: five words a shingle, similarity of 0.8
    or more. Rows with a null id, and texts without a word, stay; of rows of one id one stays."""
    return neardup.deduplicate(docs, neardup.Params(words=5, percent=80))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates; n_chars follows the text where it changed. Null texts stay null."""
    new = private.pseudonymise(docs, into="__private")
    changed = {"text": F.col("__private.text"), "n_chars": F.when(F.col("__private.n_entities") > 0, F.char_length("__private.text").cast("long")).otherwise(F.col("n_chars"))}
    return new.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns))


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy of a document. A null source is a source of its own; rows of equal
    size go by id and content."""
    return mixing.emit(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence. A null or empty text is its end id alone."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("private_data", private_data),
    ("source_weights", source_weights),
    ("packed_sequences", packed_sequences),
]

#: Signatures, surrogates and packing have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
