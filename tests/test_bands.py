"""Graphs of rows that lie near each other, against all pairs; tables of odd kinds against SQL."""

from __future__ import annotations

import itertools
import random
import shutil
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from querygrove.catalogue import ORACLES, QUERIES
from querygrove.operators import bands, expand, graph, joins, measures
from querygrove.sources.star import Star

from .conftest import DATA


def _rows():
    rng = random.Random(6)
    cents = [round(rng.randrange(-99_999, 999_999) / 100, 2) for _ in range(40)]
    values = cents + [round(c + 1000, 2) for c in cents[:30]] + cents[:20]  # many at just 1,000 of each other, by doubles on either side of it
    return [(i, rng.choice("xy"), v) for i, v in enumerate(values)] + [(200, None, 1.0), (201, "x", None), (202, "x", float("nan")), (203, "y", float("inf"))]


def _near(rows):
    ok = [r for r in rows if r[1] is not None and r[2] is not None and abs(r[2]) < float("inf")]
    return {(p[0], q[0]) for p, q in itertools.permutations(ok, 2) if p[1] == q[1] and abs(p[2] - q[2]) <= 1000}


def _band(spark, rows):
    return bands.Band(spark.createDataFrame(rows, "k long, g string, v double"), "k", ["g"], "v", 1000.0)


def test_band_by_brute_force(spark, monkeypatch):
    rows = _rows()
    near, band = _near(rows), _band(spark, rows)
    assert any(abs(abs(rows[a][2] - rows[b][2]) - 1000) < 1e-9 for a, b in near)
    degree = Counter(a for a, _ in near)
    got = band.sums().collect()
    assert {r["k"]: r["n"] for r in got} == degree and len(got) == len(degree)
    weights = {k: k + 0.5 for k, *_ in rows if k % 3}
    some = band.sums(spark.createDataFrame(list(weights.items()), "k long, weight double")).collect()
    want = {a: sum(weights[b] for x, b in near if x == a and b in weights) for a in degree}
    assert {r["k"]: r["s"] for r in some} == pytest.approx({a: s for a, s in want.items() if s})
    for side in (2000, 3):
        monkeypatch.setattr(bands, "ROWS_A_SIDE", side)
        p = band.over(band.rows.withColumn("t", F.concat(F.lit("t"), "k"))).pairs("t").collect()
        assert sorted((r["a"], r["b"]) for r in p) == sorted((a, b) for a, b in near if a < b)
        assert all((r["a_t"], r["b_t"]) == (f"t{r['a']}", f"t{r['b']}") for r in p)
    n = band.near(spark.createDataFrame([(0, "r"), (1, "r"), (999, "r")], "k long, run string")).collect()
    assert sorted((r["k"], r["other"]) for r in n) == sorted((a, b) for a, b in near if a in (0, 1))


def _plane(spark, rows):
    band = _band(spark, rows)
    p = graph.BandPlane(band, "C", band.sums().select(F.concat(F.lit("C"), F.col("k").cast("string")).alias("node"), F.col("n").alias("degree")))
    return p, p.edges().persist()


def test_plane_of_a_band_is_the_plane_of_its_edges(spark, monkeypatch):
    """Components, growth and joining, walks: over the band as over its edges."""
    plane, edges = _plane(spark, _rows())
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    assert rows(graph.components(plane.chain(), graph.members(plane)), "node", "component") == rows(graph.components(edges, graph.members(edges)), "node", "component")
    monkeypatch.setattr(expand, "BROADCAST_EDGES", 10)
    runs = spark.createDataFrame([("a", ["C1", "C2", "N7"], 3), ("b", ["C5", "Cx", "C30", "C44"], 2)], "run string, seeds array<string>, steps int")
    cols = ["run", "iteration", "node", "k", "kb", F.round("p_value", 9), "method"]
    assert rows(expand.run_all(plane, runs, "diamond_c3"), *cols) == rows(expand.run_all(edges, runs, "diamond_c3"), *cols)
    layer = spark.createDataFrame([("Drug", f"S{i % 4}", "Disease", f"C{i}") for i in range(0, 90, 7)], "src_label string, src string, dst_label string, dst string")
    layer = layer.unionByName(layer.select(F.col("dst_label").alias("src_label"), F.col("dst").alias("src"), F.col("src_label").alias("dst_label"), F.col("src").alias("dst")))
    whole = graph.transition(layer.unionByName(edges.select(F.lit("Disease").alias("src_label"), "src", F.lit("Disease").alias("dst_label"), "dst")))
    shares = graph.shares(layer, {"Disease": plane})
    own = shares.where("src_label = dst_label").select(F.col("src").alias("node"), "p")
    matrix = graph.Matrix(layer.join(shares, ["src_label", "src", "dst_label"]), {"Disease": (plane, own)})
    both = ("src_label", "src", "dst_label", "dst", F.round("p", 12))
    assert rows(matrix.all(), *both) == rows(whole, *both)
    start = spark.createDataFrame([("Drug", "S1"), ("Disease", "C3")], "label string, node string")
    a, b = (rows(graph.walk(m, start, rounds=4), "label", "node", F.round("score", 12)) for m in (matrix, whole))
    assert a == b and len(a) > 20


def test_edges_between_customers_are_not_stored(spark):
    files = Star(spark, DATA).edges("DISEASE_DISEASE").inputFiles()
    assert files and all(f.endswith("customer.parquet") for f in files)


def _folder(tmp_path, **replaced):
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        to = tmp_path / p.name
        if p.stem in replaced:
            duckdb.sql(f"COPY ({replaced[p.stem].format(p=p)}) TO '{to}' (FORMAT parquet)")
        else:
            shutil.copy(p, to)
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{to}'")
    return str(tmp_path), c


def test_plane_without_edges_has_no_size(spark, same, tmp_path):
    """Suppliers of whom none is like another: SQL has no row for their plane."""
    where, c = _folder(tmp_path, lineitem="SELECT * REPLACE (l_partkey * 1000 + l_suppkey AS l_partkey) FROM '{p}'")
    same(QUERIES["plane_size"](spark, where), ORACLES["plane_size"], c)
    assert "drug" not in {r["plane"] for r in QUERIES["plane_size"](spark, where).collect()}


def test_repeated_customers(spark, same, tmp_path):
    """Customers whose keys repeat, with nulls: by pairs, as SQL does."""
    where, c = _folder(tmp_path, customer="SELECT * FROM '{p}' UNION ALL SELECT * REPLACE (c_acctbal + 300 AS c_acctbal) FROM '{p}' WHERE c_custkey < 40 UNION ALL SELECT * REPLACE (NULL AS c_acctbal) FROM '{p}' WHERE c_custkey = 50")
    for name in ("layer_edge_counts", "plane_size", "edges_canonical", "dq_inverse_edges"):
        same(QUERIES[name](spark, where), ORACLES[name], c)


def test_inverses_of_a_lopsided_table(spark):
    d = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "b"), ("c", "a"), ("d", "d"), ("e", None), ("b", "e"), ("b", "e")], "x string, y string")
    assert tuple(graph.inverses(d).first()) == (8, 1, 4)


def test_reciprocal_edges_by_a_join(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abcd"), rng.choice("abcd")) for _ in range(40)] + [(None, "a"), ("a", None)]
    d = spark.createDataFrame(rows, "id_a string, id_b string")
    want = sum(p[0] == q[1] and p[1] == q[0] for p in rows for q in rows if None not in p + q)
    assert graph.reciprocal(d).first()[0] == want
    assert "Join" not in graph.reciprocal(d)._jdf.queryExecution().optimizedPlan().toString()


def test_resamples_in_small_pieces(monkeypatch):
    """The generator gives the same means however few places are held at a time."""
    x = np.sort(np.random.default_rng(3).normal(size=301))
    want = np.concatenate([x[r.integers(0, 301, (500, 301))].mean(axis=1) for r in [np.random.default_rng(42)] for _ in range(2)])
    for places in (1, 1000, 10**7):
        monkeypatch.setattr(measures, "PLACES_AT_ONCE", places)
        assert (measures.resampled(x, np.random.default_rng(42), 1000) == want).all()


def test_places_are_never_broadcast(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(30)], "k long, v double")
    out = measures.hash_bootstrap(df, "k", "v", draws=7)
    assert "BroadcastExchange" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "BroadcastHashJoin" not in plan
    assert out.count() == 7


@pytest.mark.parametrize("side", [2000, 3])
def test_either_key_and_fan_out_by_brute_force(spark, monkeypatch, side):
    monkeypatch.setattr(joins, "ROWS_A_SIDE", side)
    rng = random.Random(8)
    left = [(i, rng.choice([None, 1, 2, 3]), rng.choice("xyz")) for i in range(25)]
    right = [(i, rng.choice([None, 1, 2, 3]), rng.choice("xyzw")) for i in range(30)]
    for again in ([], [(0, 1, "x"), (0, 2, "y")]):  # repeated rows of one id
        l, r = left + again, right
        want = {(a[0], b[0]) for a in l for b in r if (a[1] is not None and a[1] == b[1]) or a[2] == b[2]}
        got = joins.either_key(spark.createDataFrame(l, "a long, p int, q string"), spark.createDataFrame(r, "b long, p int, q string"), ["p", "q"], ["a", "b"])
        assert sorted(map(tuple, got.collect())) == sorted(want)
        assert again or "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    edges, members = [(1, 2, 0.12345), (1, 1, 0.5), (2, 3, 0.25)], [(rng.choice([1, 2, 3]), i) for i in range(40)]
    out = joins.fan_out(spark.createDataFrame(edges, "c1 int, c2 int, weight double"), spark.createDataFrame(members, "cluster int, member long"))
    assert sorted((r["a"], r["b"]) for r in out.collect()) == sorted((m, n) for x, y, _ in edges if x != y for c, m in members if c == x for d, n in members if d == y)
