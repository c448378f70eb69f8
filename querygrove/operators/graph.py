"""Planes, layers, degrees, the heterogeneous graph, its transition matrix, walks and components."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.schema import JUMP, PLANE_OF, RESTART, Plane
from ..storage import drop, materialise, slices
from .bands import Band
from .components import connected_components, twice
from .joins import number_from


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions; other columns stay."""
    ends = ("label_a", "id_a", "label_b", "id_b")
    rest = [c for c in edges.columns if c not in ends]
    return twice(edges, rest, {c: c for c in ends}, dict(zip(ends, (ends[2], ends[3], ends[0], ends[1]), strict=True)))


def plane_edges(edges: DataFrame, nodes: DataFrame, plane: Plane) -> DataFrame:
    """(src, dst), symmetric, without loops and repeats. Nodes without an edge aren't in a plane."""
    e = edges.where(F.col("type").isin(*plane.relations) & (F.col("label_a") == plane.label) & (F.col("label_b") == plane.label))
    if plane.least_weight is not None:
        e = e.where(F.col("weight") >= plane.least_weight)
    if plane.without_groups:
        group = nodes.where("is_group").select("label", "id")
        for end in "ab":
            e = e.join(group.select(F.col("label").alias(f"label_{end}"), F.col("id").alias(f"id_{end}")), [f"label_{end}", f"id_{end}"], "left_anti")
    return twice(e.where("id_a <> id_b"), [], {"src": "id_a", "dst": "id_b"}, {"src": "id_b", "dst": "id_a"}).distinct()


def induced(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """All edges with both ends among chosen(label, id), each relation of a pair once."""
    c = chosen.select("label", "id").distinct()
    e = edges.join(c.select(F.col("label").alias("label_a"), F.col("id").alias("id_a")), ["label_a", "id_a"], "left_semi")
    return e.join(c.select(F.col("label").alias("label_b"), F.col("id").alias("id_b")), ["label_b", "id_b"], "left_semi")


def edge_scan(edges: DataFrame, labels: tuple[str, ...], relations: tuple[str, ...], least_evidence: float | None = None, strict_pair: bool = False, extra: str | None = None) -> DataFrame:
    """The edges of a scan by labels and relations. least_evidence binds ASSOCIATED_WITH edges alone;
    strict_pair asks for one end of each of two labels; extra is any further predicate."""
    for name in (*labels, *relations):
        if not name.replace("_", "").isalnum():
            raise ValueError(f"not an identifier: {name}")
    e = edges.where(F.col("label_a").isin(*labels) & F.col("label_b").isin(*labels) & F.col("type").isin(*relations))
    if least_evidence is not None:
        e = e.where((F.col("type") != "ASSOCIATED_WITH") | (F.col("weight") >= least_evidence))
    if strict_pair:
        x, y = labels
        e = e.where(((F.col("label_a") == x) & (F.col("label_b") == y)) | ((F.col("label_a") == y) & (F.col("label_b") == x)))
    return e.where(extra) if extra else e


def reciprocal(edges: DataFrame) -> DataFrame:
    """(n): pairs of edges(id_a, id_b) of which one is the other turned, as a join of the edges with
    themselves counts them; no side of it is broadcast."""
    up = F.col("id_a") < F.col("id_b")
    e = edges.dropna().groupBy(F.least("id_a", "id_b").alias("lo"), F.greatest("id_a", "id_b").alias("hi")).agg(F.count(F.when(up, 1)).alias("up"), F.count("*").alias("all"))
    met = F.when(F.col("lo") == F.col("hi"), F.col("all") * F.col("all")).otherwise(2 * F.col("up") * (F.col("all") - F.col("up")))
    return e.agg(F.coalesce(F.sum(met), F.lit(0)).alias("n"))


def inverses(edges: DataFrame) -> DataFrame:
    """(n_rows, loops, without_inverse) of a table edges(x, y) of both directions: rows, rows from a
    node to itself, and rows that aren't there turned as well."""
    up, turned = F.col("x") < F.col("y"), F.col("x") > F.col("y")
    e = edges.groupBy(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"), (F.col("x").isNull() | F.col("y").isNull()).alias("open"))
    e = e.agg(F.count("*").alias("n"), F.count(F.when(F.col("x") == F.col("y"), 1)).alias("loops"), F.count(F.when(up, 1)).alias("up"), F.count(F.when(turned, 1)).alias("down"))
    lone = F.when(F.col("open"), F.col("n")).when(F.col("up") == 0, F.col("down")).when(F.col("down") == 0, F.col("up")).otherwise(0)
    return e.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in ((F.col("n"), "n_rows"), (F.col("loops"), "loops"), (lone, "without_inverse"))))


class BandPlane:
    """A plane whose edges are a band's pairs, made as they are read. prefix and key give a node's id;
    found(node, degree) are its nodes."""

    def __init__(self, band: Band, prefix: str, found: DataFrame) -> None:
        self.band, self.prefix, self.found = band, prefix, found

    def _id(self, col: str) -> Column:
        return F.concat(F.lit(self.prefix), F.col(col).cast("string"))

    def _keyed(self, df: DataFrame, node: str) -> DataFrame:
        """df with the key of a node's id; ids of other nodes have none."""
        key = F.when(F.col(node).startswith(self.prefix), F.substring(node, len(self.prefix) + 1, 40))
        kind = dict(self.band.rows.dtypes)[self.band.key]
        return df.withColumn(self.band.key, key.try_cast(kind)).where(self._id(self.band.key) == F.col(node))

    def edges(self, weights: DataFrame | None = None) -> DataFrame:
        """(src, dst), both ways; with weights(node, p), p of src as well."""
        band, extra = self.band, []
        if weights is not None:
            band, extra = band.over(band.rows.join(self._keyed(weights, "node").drop("node"), band.key)), ["p"]
        ways = [{"src": x, "dst": y} | {c: f"{x}_{c}" for c in extra} for x, y in ("ab", "ba")]
        both = twice(band.pairs(*extra), [], *ways)
        return both.select(self._id("src").alias("src"), self._id("dst").alias("dst"), *extra)

    def near(self, some: DataFrame, node: str = "src") -> DataFrame:
        """some(node, ...) joined to dst, each of its neighbours."""
        return self.band.near(self._keyed(some, node)).select(*some.columns, self._id("other").alias("dst"))

    def chain(self) -> DataFrame:
        """(src, dst) that leave the same components."""
        return self.band.chain().select(self._id("a").alias("src"), self._id("b").alias("dst"))


def edges_of(plane: DataFrame | BandPlane) -> DataFrame:
    return plane.edges() if isinstance(plane, BandPlane) else plane


def members(plane: DataFrame | BandPlane) -> DataFrame:
    """(node): the nodes of a plane, each once."""
    return plane.found.select("node") if isinstance(plane, BandPlane) else plane.select(F.col("src").alias("node")).distinct()


def near(plane: DataFrame | BandPlane, some: DataFrame) -> DataFrame:
    """some(src, ...) joined to dst, each of src's neighbours."""
    return plane.near(some) if isinstance(plane, BandPlane) else plane.join(some, "src")


def degrees(plane: DataFrame | BandPlane) -> DataFrame:
    """(node, degree)."""
    if isinstance(plane, BandPlane):
        return plane.found.select("node", "degree")
    return plane.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def without_node(plane: DataFrame, node: str) -> DataFrame:
    return plane.where((F.col("src") != node) & (F.col("dst") != node))


def layer(edges: DataFrame, relation: str) -> DataFrame:
    """A bipartite layer: distinct (relation, type_a, a, type_b, b)."""
    return edges.where(F.col("type") == relation).select(F.col("type").alias("relation"), F.col("label_a").alias("type_a"), F.col("id_a").alias("a"), F.col("label_b").alias("type_b"), F.col("id_b").alias("b")).distinct()


def layer_degrees(layers: DataFrame) -> DataFrame:
    """Distinct partners of both sides of each layer."""
    ends = twice(layers, ["relation"], {"label": "type_a", "node": "a", "other": "b"}, {"label": "type_b", "node": "b", "other": "a"})
    return ends.groupBy("relation", "label", "node").agg(F.countDistinct("other").alias("degree"))


def ccdf(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Share of rows with value or more, a row per distinct value and group."""
    n = df.groupBy(*by, value).count()
    up = F.sum("count").over(W.partitionBy(*by).orderBy(F.desc(value)))
    return n.select(*by, value, (up / F.sum("count").over(W.partitionBy(*by))).alias("share"))


def heterogeneous(planes: dict[str, DataFrame], layers: DataFrame) -> DataFrame:
    """(src_label, src, dst_label, dst), both ways, each once: planes and the layers between them."""
    out = twice(layers, [], {"src_label": "type_a", "src": "a", "dst_label": "type_b", "dst": "b"}, {"src_label": "type_b", "src": "b", "dst_label": "type_a", "dst": "a"})
    for label, plane in planes.items():
        out = out.unionByName(plane.select(F.lit(label).alias("src_label"), "src", F.lit(label).alias("dst_label"), "dst"))
    return out.distinct()


def shares(hetero: DataFrame, further: dict[str, BandPlane], jump: float = JUMP) -> DataFrame:
    """(src_label, src, dst_label, p) of a graph of hetero and, by label, planes beside it: a node
    sends `jump` to each other type that it touches, the rest to its own, evenly within a type;
    without neighbours of its own type the others share all of it."""
    by_type = hetero.groupBy("src_label", "src", "dst_label").agg(F.count("*").alias("n"))
    for label, plane in further.items():
        by_type = by_type.unionByName(degrees(plane).select(F.lit(label).alias("src_label"), F.col("node").alias("src"), F.lit(label).alias("dst_label"), F.col("degree").alias("n")))
    other = F.col("dst_label") != F.col("src_label")
    node = by_type.groupBy("src_label", "src").agg(F.sum(other.cast("int")).alias("others"), F.max((~other).cast("int")).alias("own"))
    share = F.when(~other, 1 - F.col("others") * F.lit(jump)).when(F.col("own") == 1, F.lit(jump)).otherwise(1 / F.col("others"))
    return by_type.join(node, ["src_label", "src"]).select("src_label", "src", "dst_label", (share / F.col("n")).alias("p"))


def transition(hetero: DataFrame, jump: float = JUMP) -> DataFrame:
    """hetero with p, as shares gives it."""
    return hetero.join(shares(hetero, {}, jump), ["src_label", "src", "dst_label"])


class Matrix:
    """A transition matrix in parts: rows(src_label, src, dst_label, dst, p), and planes beside them by
    label, each with p(node, p), what a node sends to each of its neighbours there."""

    def __init__(self, rows: DataFrame, planes: dict[str, tuple[BandPlane, DataFrame]]) -> None:
        self.rows, self.planes = rows, planes

    def nodes(self) -> DataFrame:
        """(label, node) that send anything."""
        out = self.rows.select(F.col("src_label").alias("label"), F.col("src").alias("node"))
        for label, (_, p) in self.planes.items():
            out = out.unionByName(p.select(F.lit(label).alias("label"), "node"))
        return out.distinct()

    def all(self) -> DataFrame:
        """Every row; those of the planes are made as they are read."""
        out = self.rows.select("src_label", "src", "dst_label", "dst", "p")
        for label, (plane, p) in self.planes.items():
            out = out.unionByName(plane.edges(p).select(F.lit(label).alias("src_label"), "src", F.lit(label).alias("dst_label"), "dst", "p"))
        return out

    def numbered(self, seeds: DataFrame) -> tuple[DataFrame, DataFrame, list[tuple[Band, DataFrame]]]:
        """The graph by numbers: nodes(label, node, id), seeds(label, node) among them; rows(src, dst, p);
        and for each plane its band, keyed by id, with what its nodes send (id, p)."""
        ends = twice(self.rows, [], {"label": "src_label", "node": "src"}, {"label": "dst_label", "node": "dst"}).unionByName(seeds.select("label", "node"))
        for label, (_, p) in self.planes.items():
            ends = ends.unionByName(p.select(F.lit(label).alias("label"), "node"))
        nodes = materialise(number_from(ends.distinct(), 0, "label", "node", into="id").select("label", "node", "id"), "nodes")
        name = lambda end: nodes.select(F.col("label").alias(f"{end}_label"), F.col("node").alias(end), F.col("id").alias(f"{end}_id"))
        rows = self.rows.join(name("src"), ["src_label", "src"]).join(name("dst"), ["dst_label", "dst"]).select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "p")
        planes = []
        for label, (plane, p) in self.planes.items():
            own, band = nodes.where(F.col("label") == label).select("node", "id"), plane.band
            held = band.rows.select(plane._id(band.key).alias("node"), *band.same, band.value).join(own, "node").drop("node")
            planes.append((Band(materialise(held, "band"), "id", band.same, band.value, band.width), materialise(p.join(own, "node").select("id", "p"), "sent")))
        return nodes, materialise(rows, "transition"), planes


def walk(matrix: DataFrame | Matrix, restart: DataFrame, rounds: int = 20, r: float = RESTART, tolerance: float | None = None) -> DataFrame:
    """Random walk with restart: x = r e + (1 - r) P'x from x = e, rounds times or until the change is
    below tolerance; scores are normalised to 1. restart(label, node) is uniform over its rows."""
    seeds = restart.select("label", "node").distinct()
    n = seeds.count()
    if not n:
        return seeds.withColumn("score", F.lit(0.0))
    m = matrix if isinstance(matrix, Matrix) else Matrix(matrix, {})
    nodes, rows, planes = m.numbered(seeds)
    parts = slices(seeds.sparkSession, rows.count())
    # held by the walk's rounds in the order of their joins; what is lost is read again from the stored rows
    held_rows = rows.repartition(parts, "src").sortWithinPartitions("src").persist(StorageLevel.DISK_ONLY)
    start = materialise(seeds.join(nodes, ["label", "node"]).select("id", F.lit(1.0 / n).alias("score")), "restart")
    x, held = start, None
    for k in range(rounds):
        flow = held_rows.join(x.withColumnRenamed("id", "src").hint("merge"), "src").select(F.col("dst").alias("id"), ((1 - r) * F.col("score") * F.col("p")).alias("s"))
        for band, p in planes:
            near = band.sums(x.join(p, "id").select("id", (F.col("score") * F.col("p")).alias("weight")))
            flow = flow.unionByName(near.select("id", ((1 - r) * F.col("s")).alias("s")))
        y = flow.unionByName(start.select("id", (r * F.col("score")).alias("s"))).groupBy("id").agg(F.sum("s").alias("score"))
        if tolerance is None and not planes and k % 5 != 4 and k < rounds - 1:
            x = y
            continue
        y = materialise(y, "walk")
        if tolerance is not None:
            old = x.withColumnRenamed("score", "old")
            change = y.join(old, "id", "full").agg(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0] or 0.0
        if held is not None:
            drop(y.sparkSession, held)
        x = held = y
        if tolerance is not None and change < tolerance:
            break
    held_rows.unpersist()
    total = x.agg(F.sum("score")).first()[0]
    return x.join(nodes, "id").select("label", "node", (F.col("score") / F.lit(total)).alias("score"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges(src, dst), for all nodes(node)."""
    found = connected_components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    return nodes.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def reachable(plane: DataFrame, start: DataFrame) -> DataFrame:
    """Nodes of the components that the start nodes touch; start nodes outside the plane are none."""
    comp = components(plane, plane.select(F.col("src").alias("node")))
    touched = comp.join(start.select("node"), "node", "left_semi").select("component").distinct()
    return comp.join(touched, "component", "left_semi").select("node")


def communities(plane: DataFrame, rounds: int = 8) -> DataFrame:
    """(node, community) by label propagation: in each round a node takes the commonest label around
    it, ties to the smallest. An approximation of a modularity method; not equal to it."""
    x = plane.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        votes = plane.join(x.select(F.col("node").alias("dst"), "community"), "dst").groupBy("src", "community").count()
        own = x.select(F.col("node").alias("src"), "community", F.lit(1).alias("count"))
        votes = votes.unionByName(own).groupBy("src", "community").agg(F.sum("count").alias("n"))
        best = votes.groupBy("src").agg(F.min(F.struct((-F.col("n")).alias("n"), "community")).alias("b"))
        x = materialise(best.select(F.col("src").alias("node"), F.col("b.community").alias("community")), "communities")
    return x


def export(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The three labels of the planes: nodes, unnamed ones by their id, and edges with both ends in them."""
    labels = list(PLANE_OF)
    n = nodes.where(F.col("label").isin(*labels)).select("label", "id", F.coalesce("name", "id").alias("name"))
    e = edges.where(F.col("label_a").isin(*labels) & F.col("label_b").isin(*labels))
    return n, e
