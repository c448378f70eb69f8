"""Near-duplicate groups: SuperMinHash signatures, banding, verification, union-find grouping.

One pass over the texts gives each document its number of shingles, a digest of its full shingle
set (SHA-256 of all of its sorted fingerprints) and the hashes of its signature's bands. Documents
with equal digests have equal sets and go on as one class. Links are then confirmed on the full
shingle sets of whole texts, in two steps:

1. Every class is compared with the smallest class of each band that it shares. Where a class is
   the smallest of very many, they are dealt over tasks and its text goes along to each.
2. Only bands whose members are not all in one component by now are left. In each, the members
   outside the largest component are compared with all others, chunk by chunk, skipping pairs that
   are together already. No pair that shares a band and isn't in one component is left out, and no
   text is sent more often than there are chunks of such outsiders.

Connected components of the confirmed links are the groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from ..operators.components import connected_components, join_groups
from . import textkernels as K
from .shared import drop, materialise, read, small_batches

U64 = K.U64
_OPEN = U64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Params:
    """words: of a shingle. percent: links have 100 * intersection >= percent * union. rows, bands:
    of the signature. star_docs: the most, about, that one task compares with a class. chunk_docs,
    chunk_shingles: the most, about, that a chunk of a band holds."""

    words: int = 5
    percent: int = 80
    rows: int = 4
    bands: int = 24
    star_docs: int = 500
    chunk_docs: int = 512
    chunk_shingles: int = 1_500_000

    @property
    def slots(self) -> int:
        return self.rows * self.bands


#: A pair at the threshold shares no band with a chance of 5e-6; at 0.9 of 1e-9.
CONTRACT = Params(words=3, percent=85, rows=5, bands=21)


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle fingerprints of each text and how many each has."""
    buf = K.lowered(K.buffer_of(texts))
    tok = K.words(buf)
    return K.distinct_in_rows(*K.shingles(K.span_hash(buf.data, tok.start, tok.end), tok.count, words))


def super_minhash(h: np.ndarray, n: np.ndarray, slots: int) -> np.ndarray:
    """SuperMinHash signatures, one row of `slots` values for each row of fingerprints.

    Every element draws, from its own generator, a random permutation of the slots, one place per
    level, and offers the value level + uniform to the slot at that place. Values of a level are
    below those of the next, so a row stops after the first level that leaves no slot open: one
    level for all but small sets. The permutation is a Fisher-Yates shuffle of which only the
    draws so far are kept: the entry at a place is found by following the draws back.
    """
    rows = len(n)
    sig = np.full(rows * slots, _OPEN, U64)
    element, row = h, np.repeat(np.arange(rows), n)
    draws: list[np.ndarray] = []
    for level in range(slots):
        if not len(element):
            break
        with np.errstate(over="ignore"):
            z = K.mix(element + U64(2 * level + 1) * U64(0xD6E8FEB86659FD93))
        k = (((z & U64(0xFFFF)) * U64(slots - level)) >> U64(16)).astype(np.int16) + np.int16(level)
        place = k.copy()
        for i in range(level - 1, -1, -1):
            place[place == draws[i]] = i
        np.minimum.at(sig, row * slots + place, (z >> U64(16)) | (U64(level) << U64(48)))
        open_rows = np.zeros(rows, bool)
        live = np.unique(row)
        open_rows[live] = (sig.reshape(rows, slots)[live] == _OPEN).any(axis=1)
        go = open_rows[row]
        element, row = element[go], row[go]
        draws = [d[go] for d in [*draws, k]]
    return sig.reshape(rows, slots)


def band_hashes(sig: np.ndarray, p: Params) -> np.ndarray:
    out = np.broadcast_to(np.arange(1, p.bands + 1, dtype=U64), (len(sig), p.bands)).copy()
    by_band = sig.reshape(len(sig), p.bands, p.rows)
    with np.errstate(over="ignore"):
        for r in range(p.rows):
            out = K.mix(out * U64(0x9E3779B97F4A7C15) + by_band[:, :, r])
    return out


_SIGNED = "n_shingles long, h1 long, h2 long, bands array<long>"


def digests(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two numbers for each row of sorted distinct fingerprints, from the SHA-256 of all of them."""
    ends = np.cumsum(n)
    raw = b"".join(hashlib.sha256(h[e - k : e].astype("<u8").tobytes()).digest()[:16] for e, k in zip(ends.tolist(), n.tolist(), strict=True))
    return np.frombuffer(raw, "<i8").reshape(len(n), 2)


def sign(docs: DataFrame, p: Params) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, bands) for every row of docs."""

    @arrow_udf(_SIGNED)
    def signed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = []
            for part in K.slices(texts):
                h, n = shingle_sets(part, p.words)
                digest = digests(h, n)
                bands = band_hashes(super_minhash(h, n, p.slots), p)[n > 0]
                offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, p.bands, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.reshape(-1).view(np.int64)))
                parts.append(pa.StructArray.from_arrays([pa.array(n.astype(np.int64)), pa.array(digest[:, 0]), pa.array(digest[:, 1]), lists], ["n_shingles", "h1", "h2", "bands"]))
            yield pa.concat_arrays(parts)

    return docs.select("doc_id", signed(F.col("text").cast("string")).alias("s")).select("doc_id", "s.*")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[dict, np.ndarray]]:
    """Each row without its text, and the shingle set of that."""
    for batch in batches:
        rest = [c for c in batch.schema.names if c != "text"]
        rows = zip(*(batch.column(c).to_pylist() for c in rest), strict=True)
        for part in K.slices(batch.column("text")):
            h, n = shingle_sets(part, words)
            for one in np.split(h, np.cumsum(n)[:-1]):
                yield dict(zip(rest, next(rows), strict=True)), one


_LINKS = "u long, v long"


def _links_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["u", "v"])


def _verify_stars(p: Params):
    """Rows of a centre, its own texts first: each other row's link to the centre, if there is one.
    Only the centre's sets are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets, found = None, [], []
        for row, one in _sets(batches, p.words):
            if (row["center"], row["share"]) != now:
                now, sets = (row["center"], row["share"]), []
            if row["role"] == 0:
                sets.append(one)
            elif any(linked(one, c, p.percent) for c in sets):
                found.append((row["node"], row["center"]))
        yield _links_batch(found)

    return run


class Forest:
    """Union-find whose roots are the smallest ids."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def links(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, label: np.ndarray, p: Params) -> list[tuple[int, int]]:
    """Links that join groups of the rows. Rows with one id or one label are together from the
    start; side: with two chunks, the chunk of each row, and pairs within one are another task's.
    Candidates of a row are those of fitting size that aren't together with it. A few are compared
    one by one; for more, a list of the rows of each shingle counts all intersections at once."""
    m = len(ids)
    order = sorted(range(m), key=lambda i: (ids[i], len(sets[i])))
    ids, label, sets, side = ids[order], label[order], [sets[i] for i in order], side[order]
    n = np.array([len(s) for s in sets])
    forest = Forest(m)
    for same in (ids, label):
        first: dict[int, int] = {}
        for i, x in enumerate(same.tolist()):
            forest.join(first.setdefault(x, i), i)
    root = np.array([forest.find(i) for i in range(m)])
    crossed = len(set(side.tolist())) > 1
    holders = None
    out = []
    for i in range(m - 1):
        j = np.arange(i + 1, m)
        small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        ok = (100 * small >= p.percent * large) & (root[j] != root[i])
        if crossed:
            ok &= side[i] != side[j]
        j = j[ok]
        if len(j) > 8:
            if holders is None:
                flat, owner = np.concatenate(sets), np.repeat(np.arange(m), n)
                at = np.lexsort((owner, flat))
                holders = flat[at], owner[at]
            low, high = np.searchsorted(holders[0], sets[i]), np.searchsorted(holders[0], sets[i], side="right")
            size = high - low
            each = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
            both = np.bincount(holders[1][each], minlength=m)[j]
            j = j[100 * both >= p.percent * (n[i] + n[j] - both)]
            hits = j.tolist()
        else:
            hits = [k for k in j.tolist() if linked(sets[i], sets[k], p.percent)]
        for k in hits:
            if root[i] != root[k]:
                out.append((int(ids[k]), int(ids[i])))
                root[root == max(root[i], root[k])] = min(root[i], root[k])
    return out


def _verify_chunks(p: Params):
    """Rows of a pair of chunks of a band: the links among them that join components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            rows, sets = zip(*held, strict=True)
            return _links_batch(links(*(np.array([r[c] for r in rows]) if c else list(sets) for c in ("node", "", "side", "label")), p))

        for row, one in _sets(batches, p.words):
            key = (row["band"], row["first"], row["second"])
            if held and key != now:
                yield done()
                held = []
            now = key
            held.append((row, one))
        if held:
            yield done()

    return run


def _stars(texts: DataFrame, members: DataFrame, p: Params) -> DataFrame:
    """Links of members(rep, band, c) to the smallest class c of each of their bands."""
    pairs = materialise(members.where("rep <> c").select(F.col("rep").alias("node"), F.col("c").alias("center")).distinct(), "pairs")
    size = materialise(pairs.groupBy("center").agg(F.count("*").alias("n")), "centers")
    shares = F.ceil(F.col("n") / p.star_docs).cast("int")
    dealt = join_groups(pairs, size, "center").select("node", "center", F.pmod(F.xxhash64("node"), shares).cast("int").alias("share"), F.lit(1).alias("role"))
    own = size.select(F.col("center").alias("node"), "center", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"), F.lit(0).alias("role"))
    rows = dealt.unionByName(own).join(texts, "node")
    rows = rows.repartition("center", "share").sortWithinPartitions("center", "share", "role")
    return rows.select("center", "share", "role", "node", "text").mapInArrow(_verify_stars(p), _LINKS)


def _left_over(texts: DataFrame, members: DataFrame, sizes: DataFrame, joined: DataFrame, p: Params) -> DataFrame | None:
    """Links within the bands of which joined(node, root) doesn't have all members in one component;
    None where there are no such bands. The smallest class of a band was compared with all others."""
    label = F.coalesce("root", "rep").alias("label")
    at = members.where("rep <> c").select("rep", "band").join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "band", label)
    at = materialise(at, "labelled")
    per = at.groupBy("band", "label").agg(F.count("*").alias("n"))
    open_bands = per.groupBy("band").agg(F.sum("n").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"), F.max_by("label", F.struct("n", "label")).alias("main")).where("low < high")
    open_bands = materialise(open_bands.select("band", "n", "main"), "open")
    if open_bands.isEmpty():
        return None
    inside = join_groups(at, open_bands, "band").join(sizes, "rep").distinct()
    inside = materialise(inside.select("band", F.col("rep").alias("node"), "label", (F.col("label") == F.col("main")).alias("main"), "size"), "inside")
    count = lambda main: F.sum(F.when(F.col("main") == main, 1).otherwise(0))
    total = lambda main: F.sum(F.when(F.col("main") == main, F.col("size")).otherwise(0))
    chunks = lambda main: F.greatest(F.ceil(count(main) / p.chunk_docs), F.ceil(total(main) / p.chunk_shingles)).cast("int")
    whole = (F.count("*") <= p.chunk_docs) & (F.sum("size") <= p.chunk_shingles)
    same = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    bands = inside.groupBy("band").agg(F.count("*").alias("n"), *same, F.when(whole, 0).otherwise(chunks(True)).alias("mains"), F.when(whole, 1).otherwise(chunks(False)).alias("others"))
    # bands with the same members need one comparison
    bands = materialise(bands.groupBy("n", "x1", "x2").agg(F.min(F.struct("band", "mains", "others")).alias("b")).select("b.*", "n"), "bands")
    part = lambda of: F.pmod(F.xxhash64("node", F.lit(3)), of).cast("int")
    as_main = F.col("main") & (F.col("mains") > 0)
    chunk = F.when(as_main, part(F.greatest("mains", F.lit(1)))).otherwise(F.col("mains") + part(F.col("others")))
    with_ = F.explode(F.sequence(F.when(as_main, F.col("mains")).otherwise(0), F.col("mains") + F.col("others") - 1))
    dealt = join_groups(inside, bands, "band").select("band", "node", "label", chunk.alias("chunk"), with_.alias("o"))
    dealt = dealt.select("band", "node", "label", F.least("chunk", "o").alias("first"), F.greatest("chunk", "o").alias("second"), (F.col("chunk") > F.col("o")).cast("int").alias("side"))
    rows = dealt.join(texts, "node").repartition("band", "first", "second").sortWithinPartitions("band", "first", "second", "node")
    return rows.select("band", "first", "second", "node", "side", "label", "text").mapInArrow(_verify_chunks(p), _LINKS)


def groups(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text, ...).

    component_id is the smallest doc_id that links reach; kept marks it. A text that is null, empty
    or has no word has no shingles and is alone. Very long texts take part whole. Rows of one doc_id
    are one document, linked with all that any of its texts links to. A null doc_id takes no part:
    its component_id is null and it is kept. An empty table gives none. Other columns, whatever
    their names, are not read.
    """
    return _groups(docs, p)[0]


def _groups(docs: DataFrame, p: Params) -> tuple[DataFrame, list[DataFrame]]:
    """groups, and the tables in the shared folder that it reads."""
    small_batches(docs.sparkSession)
    signed = materialise(sign(docs, p), "signed")
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialise(full.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands")), "classes")
    banded = classes.select("rep", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("rep").alias("c"), F.max("rep").alias("top"), F.count("*").alias("n")).where("c < top")
    shared = materialise(shared.select("band", "c", "n"), "shared")
    members = materialise(join_groups(banded, shared, "band").select("rep", "band", "c"), "members")
    texts = docs.select(F.col("doc_id").alias("node"), F.col("text").cast("string").alias("text"))
    found = materialise(_stars(texts, members, p), "links")
    repeated = full.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if not repeated.isEmpty():  # several texts of one document
        own = full.join(repeated, "doc_id", "left_semi").join(classes, ["h1", "h2", "n_shingles"])
        found = found.unionByName(own.select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).where("u <> v"))
    comp = materialise(connected_components(found), "components")
    sizes = classes.groupBy("rep").agg(F.sum("n_shingles").alias("size"))
    more = _left_over(texts, members, sizes, comp, p)
    if more is not None:
        tied = comp.select(F.col("node").alias("u"), F.col("root").alias("v"))
        comp = connected_components(tied.unionByName(more))
    named = classes.select("h1", "h2", "n_shingles", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("h1", "h2", "n_shingles", F.coalesce("root", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    return out, [signed, classes, members]


def deduplicate(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """docs without the rows of documents that are not the smallest of their group. Rows with a
    null doc_id stay; of rows that repeat a doc_id, one stays."""
    marked, used = _groups(docs, p)
    by_id = marked.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    apart = materialise(by_id.where("NOT kept OR n > 1"), "apart")
    for t in used:
        drop(docs.sparkSession, t)
    # what goes is less than what stays: an anti join lets its side be the small one
    out = docs.join(apart.select("doc_id"), "doc_id", "left_anti")
    repeated = apart.where("kept").select("doc_id")
    if not repeated.isEmpty():  # else the texts would be read once more to find nothing
        out = out.unionByName(docs.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return out.select(docs.columns)


def op8_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group; see groups for nulls, empty and repeated rows."""
    return groups(read(spark, sf_dir, "documents").select("doc_id", "text"), CONTRACT)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
r(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d JOIN (SELECT u, min(v) AS c FROM r GROUP BY u) m ON m.u = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
