"""The registered queries against their SQL, or on the smallest tables where there is none."""

from __future__ import annotations

import pytest

from querygrove.llm.catalogue import ORACLES, QUERIES

from ..conftest import DATA


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, same, name):
    same(QUERIES[name](spark, DATA), ORACLES[name], duck)


def test_names():
    import __spark_entry__ as e
    import corpus_pipeline

    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert "pipeline" in e.queries()
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "private_data", "source_weights", "packed_sequences"]
