"""Queries over whole tables against their SQL, on tables larger than the smallest."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from querygrove.catalogue import ORACLES, QUERIES

LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def larger():
    c = duckdb.connect()
    for p in Path(LARGER).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


@pytest.mark.parametrize("name", [
    "rouge_2", "rouge_su4", "config_filter", "origin_of_node", "union_provenance", "provenance_json", "link_tiebreak", "link_exact", "link_segments", "link_mentions", "question_links", "gold_linking",
    "synonym_table", "answer_not_entity", "gold_coverage", "set_overlap", "truncate_text", "sentence_count", "relation_mapping",
    "factoid_node_hits", "list_node_hits", "list_dictionary_only", "rouge_several_ideals", "gold_group_comparison", "unique_slugs", "same_entities", "plan_cells", "plan_cases", "plan_rejects", "similar_sets",
])
def test_whole_tables(spark, larger, same, name):
    same(QUERIES[name](spark, LARGER), ORACLES[name], larger)


def test_every_turn_is_scored(spark, larger):
    assert QUERIES["rouge_2"](spark, LARGER).count() == larger.execute("SELECT count(*) FROM conversations").fetchone()[0]
