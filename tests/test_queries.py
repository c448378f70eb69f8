"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from querygrove.catalogue import ORACLES, QUERIES, flagship

from .conftest import DATA


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, same, name):
    same(QUERIES[name](spark, DATA), ORACLES[name], duck)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()  # every stage runs
    assert rows and len(set(df.columns)) == len(df.columns)


def test_flagship(spark):
    assert flagship(spark, DATA).columns == ["label_a", "id_a", "label_b", "id_b", "type", "sentence"]


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())
