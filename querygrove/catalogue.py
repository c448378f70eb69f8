"""The queries of the engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import build, calibration, linking, measures, network, selection  # noqa: F401
from .plans.registry import ORACLES, QUERIES  # noqa: F401
from .sources.star import Star


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.flagship(Star(spark, sf_dir))
