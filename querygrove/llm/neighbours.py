"""Approximate nearest neighbours by cosine: NN-descent and greedy graph search.

Equal vectors are one node that keeps the smallest of its ids. A first graph comes from leaves, of
a few dozen nodes at any size of the table, of random hyperplane trees, compared within. Then, in
each round, every node introduces its neighbours and reverse neighbours to each other, which is a
join of neighbours of neighbours: the pairs of which one is new since the last round are compared,
and what beats the worst neighbour of a side is sent to it. Rounds go on until few lists change.
They work on one byte per component. A query starts at its own node and opens the best unopened
nodes of its beam in each hop until all of the beam are opened; the beam grows with the logarithm
of the table. The final candidates are scored exactly, in double precision, on the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from .shared import drop, materialise, read, small_batches


@dataclass(frozen=True)
class Params:
    """neighbours, reverse: of a node in the graph and, at most, taken up backwards in a round.
    trees, leaf: of the first graph. Rounds end when less than `settled` of all list entries are
    new; rounds, where given, fixes their number instead. beam: nodes that a search keeps for each
    doubling of the table. opened: of a query in a hop. exact: candidates scored on the original
    vectors."""

    neighbours: int = 32
    reverse: int = 16
    trees: int = 6
    leaf: int = 48
    settled: float = 0.02
    rounds: int | None = None
    beam: int = 16
    opened: int = 32
    exact: int = 64
    seed: int = 11

    def width(self, n: int) -> int:
        return self.beam * max(4, math.ceil(math.log2(max(n, 2))))


def valid(vectors: DataFrame) -> DataFrame:
    """vectors(vec_id, embedding) without null, empty and zero vectors, such with a null or
    non-finite component, null ids, and such whose length isn't the commonest."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    v = v.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(~bad & F.exists("embedding", lambda x: x != 0))
    size = v.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return v.where(F.size("embedding") == (size["size"] if size else 0))


def nodes_of(v: DataFrame, answers: int) -> DataFrame:
    """(node, embedding, ids, code): distinct vectors, named by their smallest id, with the smallest
    ids that an answer can use. The limit is applied before the shuffle, however common a vector."""
    rank = F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))
    few = v.withColumn("rank", rank).where(F.col("rank") <= answers + 1)
    n = few.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.sort_array(F.collect_list("vec_id")).alias("ids"))

    @arrow_udf("binary")
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            x = a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1)
            x = np.round(x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300) * 127).astype(np.int8)
            yield pa.array([r.tobytes() for r in x], pa.binary())

    return n.select("node", "embedding", "ids", code("embedding").alias("code"))


def decode(codes: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(codes), np.int8).reshape(len(codes), -1).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def grouped(key: tuple[str, ...], work: Callable[[list[pa.RecordBatch]], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows sorted by key: calls work on whole groups, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in key], axis=1)
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and tuple(k[a]) != last:
                    out = work(held)
                    if out is not None:
                        yield out
                    held = []
                last = tuple(k[a])
                held.append(batch.slice(a, b - a))
        if held:
            out = work(held)
            if out is not None:
                yield out

    return run


_LISTS = "node long, code binary, nbrs array<long>, sims array<float>, fresh array<boolean>"


def _lists(node: np.ndarray, code: list[bytes | None], size: np.ndarray, nbrs: np.ndarray, sims: np.ndarray, fresh: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
    columns = [pa.array(node), pa.array(code, pa.binary()), *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (nbrs, sims.astype(np.float32), fresh))]
    return pa.RecordBatch.from_arrays(columns, ["node", "code", "nbrs", "sims", "fresh"])


def best(u: np.ndarray, c: np.ndarray, s: np.ndarray, fresh: np.ndarray, k: int, codes: dict[int, bytes]) -> pa.RecordBatch:
    """The k nearest of each u, each once; what is known already isn't fresh. codes: of the u known."""
    order = np.lexsort((fresh, c, u))
    u, c, s, fresh = u[order], c[order], s[order], fresh[order]
    one = np.ones(len(u), bool)
    one[1:] = (u[1:] != u[:-1]) | (c[1:] != c[:-1])
    u, c, s, fresh = u[one], c[one], s[one], fresh[one]
    order = np.lexsort((c, -s, u))
    u, c, s, fresh = u[order], c[order], s[order], fresh[order]
    node, first, size = np.unique(u, return_index=True, return_counts=True)
    keep = np.arange(len(u)) - np.repeat(first, size) < k
    return _lists(node, [codes.get(n) for n in node.tolist()], np.minimum(size, k), c[keep], s[keep], fresh[keep])


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    size = np.asarray(pc.list_value_length(batch.column("nbrs")))
    return (np.repeat(batch.column("node").to_numpy(), size), *(batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("nbrs", "sims", "fresh")))


def merge(lists: DataFrame, k: int) -> DataFrame:
    """One list of the k best for each node, with the code that any of its lists has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        codes: dict[int, bytes] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            part = _flat(batch)
            codes |= {n: code for n, code in zip(batch.column("node").to_pylist(), batch.column("code").to_pylist(), strict=True) if code is not None}
            if held is not None:
                part = tuple(np.concatenate([a, b]) for a, b in zip(held, part, strict=True))
            open_node = batch.column("node")[batch.num_rows - 1].as_py()
            done = part[0] != open_node  # the last node may go on in the next batch
            if done.any():
                yield best(*(x[done] for x in part), k, codes)
            held = tuple(x[~done] for x in part)
            codes = {n: code for n, code in codes.items() if n == open_node}
        if held is not None and len(held[0]):
            yield best(*held, k, codes)

    return lists.repartition("node").sortWithinPartitions("node").mapInArrow(run, _LISTS)


def first_graph(nodes: DataFrame, p: Params) -> DataFrame:
    """Lists of each node's nearest in each tree's leaf. A leaf far above its mean size is split."""
    n = nodes.count()
    bits = max(0, math.ceil(math.log2(max(n, 1) / p.leaf)))

    @arrow_udf("array<long>")
    def leaves(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rng = np.random.default_rng(p.seed)
        planes = None
        for a in batches:
            x = decode(a.to_pylist()) if len(a) else np.zeros((0, 1), np.float32)
            if planes is None and len(a):
                planes = rng.normal(size=(p.trees, x.shape[1], bits)).astype(np.float32)
            keys = [((x @ planes[t]) > 0) @ (1 << np.arange(bits, dtype=np.int64)) + (t << 40) for t in range(p.trees)] if len(a) else []
            flat = np.stack(keys, axis=1).reshape(-1) if keys else np.zeros(0, np.int64)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * p.trees), pa.array(flat.astype(np.int64)))

    def near(group: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        ids = np.concatenate([g.column("node").to_numpy() for g in group])
        if len(ids) < 2:
            return None
        codes = [c for g in group for c in g.column("code").to_pylist()]
        x = decode(codes)
        k = min(p.neighbours, len(ids) - 1)
        who, sim = [], []
        for i in range(0, len(ids), 512):
            s = x[i : i + 512] @ x.T
            s[np.arange(len(s)), np.arange(i, i + len(s))] = -9
            j = np.argpartition(-s, k - 1, axis=1)[:, :k]
            who.append(ids[j].reshape(-1))
            sim.append(np.take_along_axis(s, j, axis=1).reshape(-1))
        total = len(ids) * k
        return _lists(ids, codes, np.full(len(ids), k), np.concatenate(who), np.concatenate(sim), np.ones(total, bool))

    placed = nodes.select("node", "code", F.explode(leaves("code")).alias("leaf"))
    size = nodes.select(F.explode(leaves("code")).alias("leaf")).groupBy("leaf").count()
    parts = size.select("leaf", F.ceil(F.col("count") / (2 * p.leaf)).cast("int").alias("parts"))
    placed = placed.join(parts, "leaf").select("node", "code", "leaf", F.pmod(F.xxhash64("node", "leaf"), F.col("parts")).cast("long").alias("part"))
    placed = placed.repartition("leaf", "part").sortWithinPartitions("leaf", "part")
    return merge(placed.select("leaf", "part", "node", "code").mapInArrow(grouped(("leaf", "part"), near), _LISTS), p.neighbours)


def introduce(graph: DataFrame, p: Params) -> DataFrame:
    """One round: the graph with what nodes learned from neighbours of neighbours. An edge takes its
    node's code along, so that one join, on the neighbour, gives both ends what they need."""
    worst = F.when(F.size("sims") >= p.neighbours, F.element_at("sims", -1)).otherwise(F.lit(-2.0)).cast("float")
    edge = graph.select("node", F.col("code").alias("own"), worst.alias("low"), F.explode(F.arrays_zip("nbrs", "fresh")).alias("e")).select("node", "own", "low", F.col("e.nbrs").alias("m"), F.col("e.fresh").alias("fresh"))
    place = F.row_number().over(W.partitionBy("m").orderBy(F.desc("fresh"), F.xxhash64("node", "m"), "node"))
    ends = edge.join(graph.select(F.col("node").alias("m"), "code", worst.alias("worst")), "m").withColumn("place", place)
    there = F.struct("node", "m", "fresh", "code", "worst")
    back = F.struct(F.col("m").alias("node"), F.col("node").alias("m"), "fresh", F.col("own").alias("code"), F.col("low").alias("worst"))
    met = ends.select(F.explode(F.when(F.col("place") <= p.reverse, F.array(there, back)).otherwise(F.array(there))).alias("e")).select("e.*")
    met = met.repartition("node").sortWithinPartitions("node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            u, c, s = (np.concatenate([f[k] for f in found]) for k in range(3))
            found.clear()
            held = 0
            return best(u, c, s, np.ones(len(u), bool), p.neighbours, {})

        def pairs(group: list[pa.RecordBatch]) -> pa.RecordBatch | None:
            nonlocal held
            m = np.concatenate([g.column("m").to_numpy() for g in group])
            if len(m) < 2:
                return None
            fresh = np.concatenate([g.column("fresh").to_numpy(zero_copy_only=False) for g in group]).astype(bool)
            low = np.concatenate([g.column("worst").to_numpy() for g in group])
            x = decode([c for g in group for c in g.column("code").to_pylist()])
            s = x @ x.T
            i, j = np.nonzero((s > low[:, None]) & (fresh[:, None] | fresh[None, :]) & (m[:, None] != m[None, :]))
            found.append((m[i], m[j], s[i, j]))
            held += len(i)
            return flush() if held > 1_000_000 else None

        yield from grouped(("node",), pairs)(batches)
        if held:
            yield flush()

    learned = met.select("node", "m", "fresh", "code", "worst").mapInArrow(run, _LISTS)
    kept = graph.select("node", "code", "nbrs", "sims", F.transform("fresh", lambda _: F.lit(False)).alias("fresh"))
    return merge(kept.unionByName(learned), p.neighbours)


def build(nodes: DataFrame, p: Params = Params()) -> DataFrame:
    """(node, code, nbrs, sims, fresh): the neighbour graph."""
    graph = materialise(first_graph(nodes, p), "graph")
    done = 0
    while p.rounds is None or done < p.rounds:
        after = materialise(introduce(graph, p), "graph")
        drop(nodes.sparkSession, graph)
        graph, done = after, done + 1
        new, entries = graph.agg(F.sum(F.size(F.filter("fresh", lambda f: f))), F.sum(F.size("fresh"))).first()
        if (new or 0) <= p.settled * (entries or 0):
            break
    return graph


#: Pairs that a hop broadcasts, at most; more are joined by a shuffle.
BROADCAST = 100_000

_STATE = "q long, code binary, ids array<long>, sims array<float>, opened array<boolean>, front array<long>"


def _ragged(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lengths of the lists of a column, null ones being empty, and all of their entries."""
    return np.asarray(pc.fill_null(pc.list_value_length(column), 0)), column.flatten()


def _advance(p: Params, width: int):
    """Takes a hop's candidates into the beams and chooses what to open next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            size, ids = _ragged(batch.column("ids"))
            more, new = _ragged(batch.column("new"))
            row = np.repeat(np.arange(rows), size)
            to = np.repeat(np.arange(rows), more)
            x = np.einsum("ij,ij->i", decode(new.field("code").to_pylist()), decode(batch.column("code").to_pylist())[to]) if len(to) else np.zeros(0, np.float32)
            row = np.concatenate([row, to])
            ids = np.concatenate([ids.to_numpy(), new.field("cand").to_numpy() if len(to) else np.zeros(0, np.int64)])
            sims = np.concatenate([batch.column("sims").flatten().to_numpy(), x]).astype(np.float32)
            opened = np.concatenate([batch.column("opened").flatten().to_numpy(zero_copy_only=False).astype(bool), np.zeros(len(to), bool)])
            order = np.lexsort((~opened, ids, row))  # what the beam has already is not new
            row, ids, sims, opened = row[order], ids[order], sims[order], opened[order]
            one = np.concatenate([[True], (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])])
            row, ids, sims, opened = row[one], ids[one], sims[one], opened[one]
            order = np.lexsort((ids, -sims, row))
            row, ids, sims, opened = row[order], ids[order], sims[order], opened[order]
            keep = _place(row) < width
            row, ids, sims, opened = row[keep], ids[keep], sims[keep], opened[keep]
            shut = np.flatnonzero(~opened)
            go = shut[_place(row[shut]) < p.opened]
            opened[go] = True
            ends = lambda r: pa.array(np.concatenate([[0], np.cumsum(np.bincount(r, minlength=rows))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends(row), pa.array(v)) for v in (ids, sims, opened)]
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("code"), *lists, pa.ListArray.from_arrays(ends(row[go]), pa.array(ids[go]))], ["q", "code", "ids", "sims", "opened", "front"])

    return run


def _place(row: np.ndarray) -> np.ndarray:
    """The how-manieth of its row each entry is; rows come in order."""
    n = np.bincount(row) if len(row) else np.zeros(0, np.int64)
    return np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def search(nodes: DataFrame, graph: DataFrame, queries: DataFrame, p: Params = Params()) -> DataFrame:
    """queries(q), nodes of the graph, to (q, node) candidates by greedy search, best first within
    q. Edges are followed both ways."""
    width = p.width(nodes.count())
    edge = graph.select("node", F.explode("nbrs").alias("m"))
    back = edge.select(F.col("m").alias("node"), F.col("node").alias("m"))
    place = F.row_number().over(W.partitionBy("node").orderBy(F.xxhash64("m", "node"), "m"))
    back = back.withColumn("place", place).where(F.col("place") <= p.neighbours).drop("place")
    adjacent = materialise(edge.unionByName(back).groupBy("node").agg(F.collect_set("m").alias("nbrs")), "adjacent")
    codes = nodes.select(F.col("node").alias("cand"), "code")
    one = F.array(F.col("q"))
    state = queries.join(nodes.select(F.col("node").alias("q"), "code"), "q")
    state = state.select("q", "code", one.alias("ids"), F.array(F.lit(1.0).cast("float")).alias("sims"), F.array(F.lit(True)).alias("opened"), one.alias("front"))
    state = materialise(state, "beams")
    while True:  # what fell off a beam can't come back, so a hop opens nodes that never were open, and this ends
        opened = state.agg(F.sum(F.size("front"))).first()[0] or 0
        if not opened:
            return state.select("q", F.explode(F.slice("ids", 1, p.exact)).alias("node"))
        front = state.select("q", F.explode("front").alias("node"))
        reached = (F.broadcast(front) if opened <= BROADCAST else front).join(adjacent, "node").select("q", F.explode("nbrs").alias("cand"))
        few = opened * 2 * p.neighbours <= BROADCAST  # no node has more neighbours both ways
        got = (F.broadcast(reached) if few else reached.repartition("cand").distinct()).join(codes, "cand").groupBy("q").agg(F.collect_list(F.struct("cand", "code")).alias("new"))
        after = materialise(state.join(got, "q", "left").mapInArrow(_advance(p, width), _STATE), "beams")
        drop(nodes.sparkSession, state)
        state = after


def cosine(a: str, b: str) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: i * j), F.lit(0.0), lambda s, i: s + i)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, every: int = 50, answers: int = 5, p: Params = Params()) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every`, the
    nearest other rows found.

    Vectors that are null, empty, zero or of another length, or hold null or non-finite components,
    and rows with a null id take no part. Equal vectors are all answered with; repeated rows are
    one. Ties go to the smaller id. With fewer candidates than answers all are returned; an empty
    table gives none. Other columns are not read.
    """
    small_batches(vectors.sparkSession)
    v = materialise(valid(vectors).distinct(), "vectors")
    nodes = materialise(nodes_of(v, answers), "nodes")
    graph = build(nodes, p)
    asked = v.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    asked = materialise(asked.join(nodes.select("node", F.col("embedding").alias("qv")), "qv").select("query_id", F.col("node").alias("q"), "qv"), "asked")
    found = search(nodes, graph, asked.select("q").distinct(), p)
    scored = found.join(nodes.select("node", "embedding", "ids"), "node").join(asked, "q")
    scored = scored.select("query_id", cosine("qv", "embedding").alias("score"), F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= answers).select("query_id", "rank", "vec_id", "score")


def op9_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector; see nearest for invalid vectors and ties."""
    return nearest(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
