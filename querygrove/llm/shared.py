"""Places and small helpers that every operator of this subpackage shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import drop, materialise, scratch

__all__ = ["LAST", "WORD", "crc_mod", "drop", "materialise", "read", "row_count", "scratch", "small_batches"]

#: Whitespace of the word definition: space and the five controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands in for a null number where a row needs an order; sorts after every real id.
LAST = 9223372036854775807


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows and bytes of an Arrow batch of texts, at most.
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to these bounds, where they are larger: texts are wide, and a
    batch is held by the JVM and by Python at once."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = (spark.conf.get(key) or "").removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:  # unlimited, larger, or with a unit
            spark.conf.set(key, str(most))


def crc_mod(column: str, m: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % m


def row_count(df: DataFrame) -> int:
    """Rows of a table; over Parquet this reads footers alone."""
    return df.count()
