"""Graph operators against definitions worked out in plain Python."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from querygrove.functions import hypergeom
from querygrove.operators import calibrate, expand, graph, joins, select
from querygrove.sources.schema import Plane, drug_plane


def plane_of(spark, pairs):
    rows = [(a, b) for a, b in pairs] + [(b, a) for a, b in pairs]
    return spark.createDataFrame(rows, "src string, dst string").distinct()


#: The worked example: a path a-b-c-d and an edge b-e, seeds a and c.
PATH = [("a", "b"), ("b", "c"), ("c", "d"), ("b", "e")]


def net_of(pairs):
    ids = np.array(sorted({x for p in pairs for x in p}), object)
    at = {x: i for i, x in enumerate(ids)}
    src = [at[a] for a, b in pairs] + [at[b] for a, b in pairs]
    dst = [at[b] for a, b in pairs] + [at[a] for a, b in pairs]
    return expand.Network(ids, np.array(src), np.array(dst))


def test_tail_by_counting():
    for n, s, k in itertools.product(range(1, 8), range(0, 8), range(0, 8)):
        if s > n or k > n:
            continue
        for kb in range(0, k + 2):
            exact = sum(math.comb(s, x) * math.comb(n - s, k - x) for x in range(kb, min(k, s) + 1) if k - x <= n - s) / math.comb(n, k)
            assert hypergeom.p_value(kb, k, n, s) == pytest.approx(exact, abs=1e-12)


def test_log_factorial(spark):
    got = spark.createDataFrame([(n,) for n in (0, 1, 2, 10, 500, 100_000, 10**9)], "n long").select("n", hypergeom.log_factorial(F.col("n"))).collect()
    for n, x in got:
        assert x == pytest.approx(math.lgamma(n + 1), rel=1e-13, abs=1e-12)


def test_growth_example(spark):
    net = net_of(PATH)
    first = expand.grow(net, net.positions(["a", "c"]), 1)[0]
    assert net.ids[first[0]] == "b" and first[3] == pytest.approx(0.3)
    step = expand.grow_stepwise(plane_of(spark, PATH), spark.createDataFrame([("a",), ("c",)], "node string"), 1).first()
    assert (step["node"], step["kb"], step["k"]) == ("b", 2, 3) and step["p_value"] == pytest.approx(0.3)


def test_joining_example():
    net = net_of(PATH)
    assert expand.connect(net, net.positions(["a", "c"])) == ([], "not significant")
    out, why = expand.connect(net, net.positions(["a", "c"]), limit=0.31)
    assert [net.ids[x[0]] for x in out] == ["b"] and why == "one component"


def test_stepwise_equals_kernel(spark):
    rng = random.Random(5)
    pairs = list({tuple(sorted(rng.sample([f"n{i:02d}" for i in range(30)], 2))) for _ in range(60)})
    net, seeds = net_of(pairs), ["n01", "n02", "n03"]
    seeds = [s for s in seeds if s in net.ids]
    kernel = [net.ids[x[0]] for x in expand.grow(net, net.positions(seeds), 4)]
    steps = expand.grow_stepwise(plane_of(spark, pairs), spark.createDataFrame([(s,) for s in seeds], "node string"), 4)
    assert [r["node"] for r in steps.orderBy("iteration").collect()] == kernel


def test_growth_by_joins_equals_kernel(spark):
    rng = random.Random(15)
    pairs = list({tuple(sorted(rng.sample([f"n{i:02d}" for i in range(30)], 2))) for _ in range(55)})
    runs = spark.createDataFrame([("a", ["n01", "n02"], 3), ("b", ["n05", "n09", "zz"], 2), ("c", ["zz"], 2)], "run string, seeds array<string>, steps int")
    cols = ["run", "iteration", "node", "k", "kb", F.round("p_value", 9).alias("p"), "method"]
    a, b = expand.grow_many(plane_of(spark, pairs), runs), expand.run_all(net_of(pairs), runs)
    assert sorted(map(tuple, a.select(*cols).collect())) == sorted(map(tuple, b.select(*cols).collect()))


@pytest.mark.parametrize("method", ["diamond", "c3", "diamond_c3"])
def test_growth_above_the_bound(spark, monkeypatch, method):
    """The same rows with the bound at ten edges as without."""
    rng = random.Random(21)
    pairs = list({tuple(sorted(rng.sample([f"n{i:03d}" for i in range(160)], 2))) for _ in range(190)})
    runs = spark.createDataFrame([(f"r{k}", rng.sample([f"n{i:03d}" for i in range(160)], 7), 2) for k in range(6)] + [("z", ["none"], 2)], "run string, seeds array<string>, steps int")
    cols = ["run", "iteration", "node", "k", "kb", F.round("p_value", 9).alias("p"), "method"]
    want = sorted(map(tuple, expand.run_all(plane_of(spark, pairs), runs, method).select(*cols).collect()))
    monkeypatch.setattr(expand, "BROADCAST_EDGES", 10)
    got = sorted(map(tuple, expand.run_all(plane_of(spark, pairs), runs, method).select(*cols).collect()))
    assert got == want and (want or method == "c3")
    with pytest.raises(ValueError):
        expand.small_network(plane_of(spark, pairs))


def test_joining_by_joins_equals_kernel(spark):
    """Whole runs of joining components, with a limit that lets nodes and edges in."""
    rng = random.Random(3)
    pairs = list({tuple(sorted(rng.sample([f"n{i:02d}" for i in range(40)], 2))) for _ in range(46)})
    net = net_of(pairs)
    seeds = {f"r{k}": sorted({s for s in rng.sample([f"n{i:02d}" for i in range(40)], 5) if s in net.ids}) for k in range(6)}
    want = [(r, i, net.ids[x[0]], x[1], x[2], round(x[3], 9)) for r, s in seeds.items() for i, x in enumerate(expand.connect(net, net.positions(s), limit=0.9)[0], 1)]
    cluster = spark.createDataFrame([(r, n) for r, s in seeds.items() for n in s], "run string, node string")
    got = expand.connect_many(plane_of(spark, pairs), cluster, limit=0.9).select("run", "iteration", "node", "k", "kb", F.round("p_value", 9)).collect()
    assert len(want) > 6 and sorted(map(tuple, got)) == sorted(want)


def test_pruning_keeps_the_best(spark):
    rng = random.Random(9)
    pairs = list({tuple(sorted(rng.sample([f"n{i:02d}" for i in range(25)], 2))) for _ in range(70)})
    plane, cluster = plane_of(spark, pairs), spark.createDataFrame([("n01",), ("n05",), ("n07",)], "node string")
    all_p = expand.scored(plane, cluster)
    kept = expand.pruned(expand.candidates(plane, cluster)).join(all_p.select("node", "p_value"), "node")
    assert kept.agg(F.min("p_value")).first()[0] == all_p.agg(F.min("p_value")).first()[0]


def test_transition_rows_and_example(spark):
    rows = [("Gene", "v", "Gene", f"g{i}") for i in range(2)] + [("Gene", "v", "Drug", f"d{i}") for i in range(4)] + [("Gene", "w", "Drug", "d0"), ("Gene", "w", "Disease", "x"), ("Gene", "w", "Disease", "y")]
    p = {(r["src"], r["dst"]): r["p"] for r in graph.transition(spark.createDataFrame(rows, "src_label string, src string, dst_label string, dst string")).collect()}
    assert p["v", "g0"] == pytest.approx(1 / 3) and p["v", "d0"] == pytest.approx(1 / 12)
    assert p["w", "d0"] == pytest.approx(0.5) and p["w", "x"] == pytest.approx(0.25)
    for v in "vw":
        assert sum(x for (a, _), x in p.items() if a == v) == pytest.approx(1)


def test_walk_fixed_point(spark):
    rows = [("G", a, "G", b) for a, b in [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")]]
    m = graph.transition(spark.createDataFrame(rows, "src_label string, src string, dst_label string, dst string"))
    x = graph.walk(m, spark.createDataFrame([("G", "a")], "label string, node string"), rounds=80, tolerance=1e-12)
    got = {r["node"]: r["score"] for r in x.collect()}
    p = np.array([[0, 1, 0], [0.5, 0, 0.5], [0, 1, 0]])
    e = np.array([1.0, 0, 0])
    want = np.linalg.solve(np.eye(3) - 0.5 * p.T, 0.5 * e)
    assert [got[k] for k in "abc"] == pytest.approx(list(want / want.sum()), abs=1e-9)


def test_components_of_a_long_path(spark):
    pairs = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(120)] + [("z1", "z2")]
    p = plane_of(spark, pairs)
    c = {r["node"]: r["component"] for r in graph.components(p, p.select(F.col("src").alias("node"))).collect()}
    assert {v for k, v in c.items() if k.startswith("n")} == {"n000"} and c["z2"] == "z1"
    assert graph.components(p.limit(0), p.limit(0).select(F.col("src").alias("node"))).count() == 0


def test_plane_has_no_loops_or_repeats(spark):
    e = spark.createDataFrame([("PPI", "Gene", "a", "Gene", "b", None, None), ("PPI", "Gene", "b", "Gene", "a", None, None), ("PPI", "Gene", "a", "Gene", "a", None, None), ("GDA", "Gene", "a", "Disease", "x", None, None)], "type string, label_a string, id_a string, label_b string, id_b string, weight double, origin string")
    n = spark.createDataFrame([("Gene", "a", "a", "s", False)], "label string, id string, name string, source string, is_group boolean")
    assert sorted(map(tuple, graph.plane_edges(e, n, Plane("gene", "Gene", ("PPI",))).collect())) == [("a", "b"), ("b", "a")]


def test_scan_refuses_other_identifiers(spark):
    e = spark.createDataFrame([], "type string, label_a string, id_a string, label_b string, id_b string, weight double")
    with pytest.raises(ValueError):
        graph.edge_scan(e, ("Gene) RETURN 1",), ("PPI",))
    with pytest.raises(ValueError):
        drug_plane(0.5)
    assert drug_plane(0.85).name == "drug_u085"


def test_band_pairs_by_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("xy"), rng.choice([0.0, 10.0, 5.0, rng.uniform(-50, 50)])) for i in range(80)]
    got = sorted(map(tuple, joins.band_pairs(spark.createDataFrame(rows, "k int, g string, v double"), "k", ["g"], "v", 10.0).collect()))
    assert got == sorted((a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[1] == b[1] and abs(a[2] - b[2]) <= 10)


def test_configurations_are_nested(spark):
    rows = [("Gene", f"g{i}", "Drug", "S", "s", "semilla" if i < 3 else "agregado", i, None, None if i < 3 else ("diamond", "c3", "rwr")[i % 3]) for i in range(12)]
    sel = spark.createDataFrame(rows, "label string, id string, entity_label string, entity_id string, step string, role string, iteration int, p_value double, method string")
    sets = [{r["id"] for r in select.configured(sel, c).select("id").collect()} for c in ("semillas", "diamond", "diamond_c3", "completa")]
    assert all(a < b for a, b in itertools.pairwise(sets))


def test_matched_controls_and_trace():
    rng = random.Random(4)
    pairs = list({tuple(sorted(rng.sample([f"n{i:02d}" for i in range(40)], 2))) for _ in range(90)})
    net = net_of(pairs)
    seeds = list(range(6))
    got, moved = calibrate.matched_controls(np.random.default_rng(1), net, seeds, np.setdiff1d(np.arange(len(net)), seeds))
    assert len(set(got)) == 6 and not set(got) & set(seeds) and moved >= 0
    added = [x[0] for x in expand.grow(net, seeds, 5)]
    trace = calibrate.growth_trace(net, seeds, added)
    assert [t[0] for t in trace] == list(range(len(added) + 1))
    for i, own, share, size in trace:
        members = set(seeds) | set(added[:i])
        comp = expand.parts(net, members)
        most = max(sum(comp[s] == c for s in seeds) for c in set(comp.values()))
        assert own == most and share == pytest.approx(own / 6) and size >= own


def test_folds_round_half_even():
    assert [len(f) for f in calibrate.folds(np.random.default_rng(0), list(range(5)), 0.5)] == [2] * 5
    assert [len(f) for f in calibrate.folds(np.random.default_rng(0), list(range(5)), 0.1)] == [1] * 5


def test_bins_of_cells_are_equal_splits(spark):
    rng = random.Random(3)
    rows = [(c, f"e{i:03}", rng.randint(1, 9)) for c, n in (("a", 50), ("b", 7), ("c", 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "cell string, entity string, n_seeds int")
    got = {(r["cell"], r["entity"]): r["bin"] for r in calibrate.bins(df, 2, ["cell"]).collect()}
    want = {}
    for c in "abc":
        own = sorted((n, e) for k, e, n in rows if k == c and n >= 2)
        for name, part in zip(calibrate.BINS, np.array_split(np.arange(len(own)), 3), strict=True):
            want |= {(c, own[i][1]): name for i in part}
    assert got == want
    alone = {r["entity"]: r["bin"] for r in calibrate.bins(df.where("cell = 'a'"), 2).collect()}
    assert alone == {e: b for (c, e), b in want.items() if c == "a"}
    assert calibrate.bins(df.where("false"), 2, ["cell"]).count() == calibrate.bins(df.where("false"), 2).count() == 0


def test_hidden_seeds_and_traces_by_definition(spark):
    import zlib

    rng = random.Random(5)
    names = [f"n{i:02}" for i in range(40)]
    net = net_of(sorted({tuple(sorted(rng.sample(names, 2))) for _ in range(110)}))
    own = sorted(rng.sample(list(net.ids), 8))
    cases = spark.createDataFrame([("cell", "e", own)], "cell string, entity string, seeds array<string>")
    case = zlib.crc32(b"cell|e") ^ 42
    got = calibrate.hidden_recall(cases, net, budget=10, nulls=2).toPandas()
    assert len(got.groupby(["source", "draw", "share", "fold"])) == 3 * 5 + 2 * 5
    draw = np.random.default_rng([case, 10_001])
    for share in (0.1, 0.2, 0.3):
        for fold in range(5):
            gone = set(draw.choice(net.positions(own), size=max(1, round(8 * share)), replace=False).tolist())
            added = [x[0] for x in expand.grow(net, [s for s in net.positions(own) if s not in gone], 10)]
            one = got[(got.source == "real") & (got.share == share) & (got.fold == fold)].sort_values("rank")
            assert one["recall"].tolist() == [len(gone & set(added[: k + 1])) / len(gone) for k in range(len(added))]
    others = [x for x in net.ids if x not in own]
    traces = calibrate.run_cases(cases, net, budget=10, draws=3).toPandas()
    assert traces.groupby("source")["draw"].nunique().to_dict() == {"real": 1, "uniform": 3, "matched": 3}
    assert traces[traces.source == "matched"]["moved"].notna().all() and traces[traces.source != "matched"]["moved"].isna().all()
    added = [net.ids[x[0]] for x in expand.grow(net, net.positions(own), 10)]
    assert traces[traces.source == "real"].sort_values("iteration")["node"].tolist() == [None, *added]
    few = calibrate.run_cases(cases, net, budget=5, draws=2, forbidden=tuple(others[:-7])).toPandas()
    assert set(few["source"]) == {"real"}  # seven nodes are left for eight control seeds


@pytest.mark.parametrize("least", [0.2, 0.5, 0.8, 1.0])
def test_similar_pairs_by_brute_force(spark, least):
    rng = random.Random(7)
    sets = {k: {0, *rng.sample(range(12), rng.randint(0, 6))} for k in range(60)} | {100: set(range(12)), 101: set(range(12))}
    rows = [(k, i) for k, v in sets.items() for i in v] * 2 + [(None, 1), (5, None)]
    got = {(r["a"], r["b"]): r["similarity"] for r in joins.similar_pairs(spark.createDataFrame(rows, "k int, i int"), "k", "i", least).collect()}
    jaccard = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sorted(sets), 2)}
    assert got == {p: v for p, v in jaccard.items() if v >= least}


def test_similar_pairs_of_long_and_short_sets(spark, monkeypatch):
    """Sets shorter than, as long as and longer than those that go along with their rows."""
    rng = random.Random(29)
    rows = [(k, i) for k in range(90) for i in rng.sample(range(12), rng.randint(1, 9))]
    sets = {k: {i for j, i in rows if j == k} for k in range(90)}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(range(90), 2)}
    want = {p: x for p, x in want.items() if x >= 0.5}
    for carried in (0, 4, 5, 16):
        monkeypatch.setattr(joins, "CARRIED", carried)
        got = joins.similar_pairs(spark.createDataFrame(rows + rows[:50], "k int, i int"), "k", "i", 0.5).collect()
        assert len(got) == len(want) and {(r["a"], r["b"]): r["similarity"] for r in got} == pytest.approx(want)


def test_similar_pairs_store_no_candidates(spark):
    """Short sets are counted where they meet: what is shuffled follows the rows, not the pairs."""
    df = joins.similar_pairs(spark.createDataFrame([(k, i) for k in range(40) for i in (k % 3, k % 5, k % 7)], "k int, i int"), "k", "i", 0.5)
    assert "left_semi" not in (plan := df._jdf.queryExecution().optimizedPlan().toString().lower()) and "leftsemi" not in plan and "aggregate [ka" not in plan
