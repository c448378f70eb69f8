"""Text functions of linking, verbalising and measuring."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def normalised(s: pd.Series) -> pd.Series:
    """Accents off, what isn't ASCII then gone without a space, lower case, other signs to a space."""

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        plain = unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode().lower()
        return re.sub(r"[^a-z0-9]+", " ", plain).strip()

    return s.map(one)


def normalised_ascii(col: Column) -> Column:
    """The same for texts known to be ASCII, without leaving the JVM."""
    return F.trim(F.regexp_replace(F.lower(col), "[^a-z0-9]+", " "))


def form(normal: Column) -> Column:
    """Words in order; repeats stay."""
    return F.array_join(F.array_sort(F.split(normal, " ")), " ")


def without_brackets(col: Column) -> Column:
    return F.regexp_replace(col, r"\([^)]*\)", " ")


def in_brackets(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(r"\(([^)]*)\)"), F.lit(1))


#: The mark of unverified statements and the reference to data in an answer.
MARK, DATA = r"(?i)\s*[\[(]\s*LLM:?\s*verify\s*[\])]", r"\[Data:[^\]]*\]"
#: Fixed value: the sentence with which an answer abstains.
ABSTENTION = "I am sorry but I am unable to answer this question given the provided data"


def cleaned(col: Column) -> Column:
    """An answer without marks and data references."""
    return F.trim(F.regexp_replace(F.regexp_replace(col, MARK, ""), DATA, ""))


def item(col: Column) -> Column:
    """A list item for comparison: marks, references, brackets, bullets and edge signs off, lower case."""
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(col, MARK, " "), DATA, " "), r"\([^)]*\)", " ")
    x = F.regexp_replace(x, r"^\s*(?:[-*•]|[0-9]+[.)])\s*", "")
    return F.lower(F.regexp_replace(x, r"^[ \t*.,;:]+|[ \t*.,;:]+$", ""))


def items(answer: Column) -> Column:
    """Distinct items of an answer's first block of lines: a heading that ends in a colon is skipped,
    lines of marks alone are skipped, a blank line ends the block."""
    lines = F.split(F.trim(answer), "\n")
    first = F.when(F.element_at(lines, 1).rlike(r":\s*$"), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
    first = F.when((F.size(first) > 0) & (F.trim(F.element_at(first, 1)) == ""), F.slice(first, 2, F.greatest(F.size(first) - 1, F.lit(0)))).otherwise(first)
    blank = F.array_position(F.transform(first, lambda x: F.trim(x) == ""), True)
    block = F.when(blank > 0, F.slice(first, F.lit(1), (blank - 1).cast("int"))).otherwise(first)
    block = F.filter(block, lambda x: ~(x.rlike(MARK) & (F.trim(F.regexp_replace(x, MARK, "")) == "")))
    return F.array_distinct(F.filter(F.transform(block, item), lambda x: (x != "") & (x != "none")))


def words(col: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.regexp_replace(F.regexp_replace(col, MARK, " "), DATA, " ")), F.lit("[a-z0-9]+"), F.lit(0))


def sentences(col: Column) -> Column:
    return F.split(col, r"(?<=[.!?])\s+(?=[A-Z])")


def shortened(col: Column, most: int = 150) -> Column:
    """Whole sentences while their words stay within `most`, up to the first that doesn't; if the
    first is too long, its first words."""
    s = F.transform(sentences(col), lambda x: F.struct(x.alias("s"), F.size(F.split(F.trim(x), r"\s+")).alias("n")))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n"), F.lit(True).alias("go"))
    fold = F.aggregate(s, start, lambda a, x: F.when(a["go"] & (a["n"] + x["n"] <= most), F.struct(F.concat(a["kept"], F.array(x["s"])).alias("kept"), (a["n"] + x["n"]).alias("n"), F.lit(True).alias("go"))).otherwise(F.struct(a["kept"].alias("kept"), a["n"].alias("n"), F.lit(False).alias("go"))), lambda a: a["kept"])
    first = F.array_join(F.slice(F.split(F.trim(col), r"\s+"), 1, most), " ")
    return F.when(F.size(fold) > 0, F.array_join(fold, " ")).otherwise(first)


def sentence(kind: Column, name_a: Column, label_a: Column, name_b: Column, name_type: Column | None = None) -> Column:
    """What an edge says. The sentences."""
    drug, other = F.when(label_a == "Drug", name_a).otherwise(name_b), F.when(label_a == "Drug", name_b).otherwise(name_a)
    gene, thing = F.when(label_a == "Gene", name_a).otherwise(name_b), F.when(label_a == "Gene", name_b).otherwise(name_a)
    say = F.format_string
    return (
        F.when(kind == "DRUG_TARGET", say("The drug %s targets the protein encoded by %s.", drug, other))
        .when(kind == "GDA", say("The gene %s is associated with %s.", gene, thing))
        .when(kind == "INDICATION", say("The drug %s is indicated for %s.", drug, other))
        .when(kind == "PPI", say("The proteins %s and %s interact.", name_a, name_b))
        .when(kind == "FORM_COMPLEX", say("The proteins %s and %s form a complex.", name_a, name_b))
        .when(kind == "DRUG_DRUG", say("The drugs %s and %s are chemically similar.", name_a, name_b))
        .when(kind == "PATHWAY_PROTEIN", say("The protein encoded by %s participates in the pathway %s.", gene, thing))
        .when(kind.isin("DISEASE_DISEASE", "DISEASE_BERT"), say("The diseases %s and %s are related.", name_a, name_b))
        .otherwise(say("%s is related to %s (%s).", name_a, name_b, name_type if name_type is not None else kind))
    )


def set_key(labels_ids: Column) -> Column:
    """A name for a set of "label_id" texts; long ones are cut and end in a digest."""
    k = F.array_join(F.array_sort(labels_ids), "__")
    return F.when(F.length(k) > 150, F.concat(F.substring(k, 1, 100), F.lit("_"), F.substring(F.md5(k.cast("binary")), 1, 8))).otherwise(k)


def slug(name: Column, ident: Column) -> Column:
    return F.concat(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_"), F.substring(ident, -6, 6))


def unique_slugs(df: DataFrame, name: str, ident: str, into: str = "slug") -> DataFrame:
    """df with a name for each row: the name in lower case and the id's end; where two rows would share
    one, the whole id in all of them but the first by id."""
    base = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_|_$", "")
    short = F.concat(base, F.lit("_"), F.substring(ident, -6, 6))
    place = F.row_number().over(W.partitionBy("__short").orderBy(ident))
    return df.withColumn("__short", short).withColumn(into, F.when(place == 1, F.col("__short")).otherwise(F.concat(base, F.lit("_"), ident))).drop("__short")


def run_name(report_words: int, map_words: int, answer_words: int, batch_tokens: int, community_size: int, with_text: bool = False) -> str:
    """The name of a run's folder. The parts' names and their order."""
    parts = {"reportes": report_words, "map": map_words, "respuesta": answer_words, "lotes": batch_tokens, "comunidades": community_size}
    return "_".join([*(f"{k}{v}" for k, v in parts.items()), *(["texto"] if with_text else [])])


def level_suffix(level: int, usual: int) -> str:
    """What a file's name ends in for a level of communities; nothing for the usual one."""
    return f"_nivel{level}" if level != usual else ""


def share_group(x: Column) -> Column:
    """Names of shares; a half is in the upper group."""
    return F.when(x == 0, "nada").when(x < 0.5, "menos_de_la_mitad").otherwise("la_mitad_o_mas")


def coverage_group(x: Column) -> Column:
    """Names of coverages; a half is in the lower group."""
    return F.when(x <= 0.5, "hasta_la_mitad").otherwise("mas_de_la_mitad")


def yes_no(answer: Column) -> Column:
    """yes or no if that is the answer's first word and it doesn't abstain."""
    first = F.regexp_extract(F.lower(cleaned(answer)), "[a-z]+", 0)
    return F.when(first.isin("yes", "no") & ~answer.contains(ABSTENTION), first)


def first_text(*candidates: tuple[Column, str]) -> tuple[Column, Column]:
    """The first text that isn't blank, trimmed, and the name of its source."""
    trimmed = [(F.nullif(F.trim(c), F.lit("")), s) for c, s in candidates]
    text = F.coalesce(*(t for t, _ in trimmed))
    source = F.coalesce(*(F.when(t.isNotNull(), F.lit(s)) for t, s in trimmed))
    return text, source
