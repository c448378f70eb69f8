from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def canon(df) -> list:
    """Rows of a pandas frame as sorted texts, columns by name."""
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    return sorted(tuple("None" if v is None else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def same():
    def check(df, sql: str, c) -> None:
        a, b = df.toPandas(), c.execute(sql).df()
        assert sorted(a.columns) == sorted(b.columns)
        assert canon(a) == canon(b)

    return check
