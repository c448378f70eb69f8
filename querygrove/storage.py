"""Tables kept in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where the session names one; else a folder set once for the session: a
    temporary one where driver and executors are one process, or one in the user's folder of the
    default file system, which has to be a shared one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        if sc.master.split("[")[0] == "local":
            sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='querygrove-')}")
        else:
            fs = sc._jvm.org.apache.hadoop.fs.FileSystem.get(sc._jsc.hadoopConfiguration())
            if fs.getScheme() == "file":
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            sc.setCheckpointDir(f"{fs.getHomeDirectory().toString()}/querygrove-checkpoints")
        held = sc._jsc.sc().getCheckpointDir()
    return held.get()


_homes: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's part of the shared folder, which goes when Python ends."""
    home = f"{shared_dir(spark)}/querygrove/{spark.sparkContext.applicationId}"
    if home not in _homes:
        _homes.add(home)
        atexit.register(_delete, spark, home)
    return f"{home}/{name}-{uuid.uuid4().hex[:12]}"


def _delete(spark: SparkSession, where: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended already
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows that a task is to hold at a time, where how many there are is known.
ROWS_A_TASK = 250_000


def slices(spark: SparkSession, rows: int, each: int | None = None) -> int:
    """Partitions for that many rows: as many as the session shuffles into, more where a task would
    hold more than `each` rows, so that a task's memory doesn't grow with the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // (each or ROWS_A_TASK)))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, executors may be lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Delete a materialised table that nothing reads any more."""
    for root in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/querygrove/" in root:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
