"""Where queries and their SQL are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.star import GRAPH_SQL, Star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, graph: bool = True):
    """Register a function of a Star under its name; sql may use the graph's views."""

    def register(f: Callable[[Star], DataFrame]) -> Callable[[Star], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Star(spark, sf_dir))
        QUERIES[f.__name__].__doc__ = f.__doc__
        if sql:
            text = sql.strip()
            ORACLES[f.__name__] = GRAPH_SQL + (", " + text if text[:2] == "x_" else text) if graph else text
        return f

    return register
