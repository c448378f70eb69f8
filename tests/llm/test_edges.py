"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import base64
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from querygrove.llm import hosts, language, mixing, neardup, neighbours, packing, private, quality, toxicity, warc
from querygrove.llm.shared import scratch

from ..conftest import DATA

GOOD = "The house on the hill had a red door and a small green garden where old trees stood in the evening light, and nobody who walked by knew how long ago it had been built or who had lived there first, for all of the papers about it had been lost in a great fire long before. Mail a.b@example.org or call +1 (201) 555-0173 now."
#: Names that operators use for columns of their own.
CLASH = ["size", "target", "copies", "kept", "quality", "private", "language", "toxicity", "n", "bands", "node", "root", "component_id", "score", "group_id", "crcs", "rest", "source_size", "h1", "rep", "u", "v"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


def rows():
    extra = ["x"] * len(CLASH)
    texts = [
        (1, GOOD, "en", "a"), (2, GOOD + " It was.", "en", "a"), (3, None, "en", "a"), (4, "", None, None), (5, " \t\n", "de", "b"), (6, "word", "en", None), (7, "two words", "en", "b"),
        (None, GOOD, "en", "a"), (8, GOOD, None, "c"), (8, GOOD, None, "c"), (9, "ab " * 40_000, "en", "c"), (10, "z" * 300_000, "de", "c"), (11, "Éa ñ ß 日本 \U0001f600 " * 30, "fr", "d"), (12, "1234 %% !!", "en", "d"),
    ]
    return [(i, t, la, s, len(t) if t is not None else None, *extra) for i, t, la, s in texts]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("d") / "documents.parquet")
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_quality(docs, none):
    got = quality.annotate(docs, into="verdict")
    assert got.columns == [*docs.columns, "verdict"] and got.count() == 14
    by = {r["doc_id"]: r["verdict"] for r in got.collect()}
    assert by[3]["n_words"] == by[4]["n_words"] == by[5]["n_words"] == 0 and by[3]["base_failed"] and not by[3]["kept"]
    assert by[1]["kept"] and by[9]["base_failed"] and by[10]["n_words"] == 1 and by[10]["word_chars"] == 300_000
    assert quality.annotate(none).count() == 0


def test_near_duplicates(docs, none):
    got = neardup.groups(docs)
    by = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == 14
    assert by[2]["component_id"] == 1 and by[8]["component_id"] == 1 and by[1]["kept"] and not by[8]["kept"]
    assert by[3]["n_shingles"] == by[4]["n_shingles"] == by[5]["n_shingles"] == 0 and by[3]["kept"] and by[3]["component_id"] == 3
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert by[6]["n_shingles"] == 1 and by[10]["n_shingles"] == 1
    left = neardup.deduplicate(docs)
    assert left.columns == docs.columns and left.where("doc_id IN (2, 8)").count() == 0 and left.where("doc_id IS NULL").count() == 1
    twice = docs.where("doc_id IN (6, 7)")
    assert neardup.deduplicate(twice.unionAll(twice)).count() == 2
    assert neardup.groups(none).count() == 0 and neardup.deduplicate(none).count() == 0


def test_private(docs, none):
    got = private.pseudonymise(docs, into="new")
    assert got.columns == [*docs.columns, "new"]
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[3]["new"]["text"] is None and by[3]["new"]["n_entities"] == 0
    assert by[1]["new"]["n_entities"] == 2 and "a.b@example.org" not in by[1]["new"]["text"] and "555-0173" not in by[1]["new"]["text"]
    assert by[1]["new"]["text"] == by[8]["new"]["text"] and by[10]["new"]["text"] == "z" * 300_000
    assert private.pseudonymise(none).count() == 0


def test_mixing(docs, none):
    mixed = mixing.mix(docs.withColumn("size", mixing.size_of(F.col("text"))))
    got = mixed.collect()
    assert len(got) == 14 and all(0 <= r["copies"] <= 2 for r in got)
    assert {r["source"] for r in got} == {None, "a", "b", "c", "d"} and next(r for r in got if r["doc_id"] == 6)["source_size"] == 1
    out = mixing.emit(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r["copies"] for r in got)
    assert {r[c] for r in out.collect() for c in CLASH} == {"x"}
    assert mixing.emit(none).count() == 0


def test_packing(docs, none):
    got = packing.pack_documents(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append(r)
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= 2048
    assert [(r["start"], r["length"], r["doc_tokens"]) for r in got if r["doc_id"] == 3] == [(0, 1, 1)]
    assert sum(r["length"] for r in got if r["doc_id"] == 8) == 2 * next(r["doc_tokens"] for r in got if r["doc_id"] == 8)
    assert packing.pack_documents(none).count() == 0


def test_language(docs, none):
    model = language.train(docs)
    got = {r["doc_id"]: r["guess"] for r in language.identify(docs, model, "guess").collect()}
    assert got[3]["lang_pred"] == got[4]["lang_pred"] == got[5]["lang_pred"] == got[12]["lang_pred"] == "und" and got[1]["lang_pred"] == "en"
    assert all(0 <= g["score"] <= 1 for g in got.values())
    assert language.train(none) is None and language.identify(none, None).count() == 0
    assert {r["language"]["lang_pred"] for r in language.identify(docs.drop("language"), None).collect()} == {"und"}


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 0), (2, 0), (7, 1), (7, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    net = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["rated"] for r in toxicity.rate(docs, net, "rated").collect()}
    assert got[3] == got[4] == got[5] == 0 and all(0 <= s <= 1 for s in got.values())
    assert toxicity.train(none, labels) is None and toxicity.rate(none, None).count() == 0
    assert toxicity.train(docs, labels.limit(0)) is None


PAGES = [(1, "http://A.Example.com/en/7x?q#f", "<p>é</p>"), (2, "https://b.example.com/en/1", "<p>é</p>"), (3, None, None), (4, "no scheme", ""), (None, "http://x.net/de/1", "<p>é</p>"), (5, "http://y.example.net/de/80", "q"), (5, "http://y.example.net/de/80", "q"), (6, "ftp://host", "x" * 200_000), (7, "http://", "a\r\n\r\nWARC/1.1\r\n")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, digest string, id string")


def test_archive(spark, pages):
    root = scratch(spark, "test")
    warc.write_archive(pages, root)
    got = warc.read_archive(spark, root).collect()
    assert len(got) == len(PAGES) and all(r["verified"] for r in got)
    assert spark.read.parquet(f"{root}/payloads").count() == 5
    by = {r["page_id"]: r for r in got}
    assert by[2]["refers_to"] == 1 and by[None]["refers_to"] == 1 and by[1]["record_type"] == "response" and by[4]["refers_to"] == 3
    assert [r["record_type"] for r in got if r["page_id"] == 5] == ["response"] * 2
    for i, _, html in PAGES:
        if i is not None:
            assert bytes(by[i]["payload"]).decode() == (html or "")
            head, _, rest = bytes(by[i]["record"]).partition(b"\r\n\r\n")
            length = int(head.rpartition(b"Content-Length: ")[2])
            assert rest[length:] == b"\r\n\r\n"
    root = scratch(spark, "test")
    warc.write_archive(pages, root, least_bytes=5)
    kinds = {r["page_id"]: r["record_type"] for r in warc.index(spark, root).collect()}
    assert kinds[4] == "response" and kinds[2] == "revisit"
    path = scratch(spark, "export")
    warc.export_warc(spark, root, path)
    seen = []
    for r in spark.read.format("binaryFile").load(path).collect():
        members, rest = [], bytes(r["content"])
        while rest:  # every member can be read on its own
            one = zlib.decompressobj(31)
            members.append(one.decompress(rest))
            rest = one.unused_data
        seen += members[::2]
        assert not any(members[1::2])
    assert sorted(seen) == sorted(bytes(r["record"]) for r in warc.read_archive(spark, root).collect())
    root = scratch(spark, "test")
    warc.write_archive(pages.limit(0), root)
    assert warc.index(spark, root).count() == 0


def _header(page, url, html, first):
    body = (html or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(body)}\r\n\r\n"
    revisit = first is not None
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    more = f"WARC-Profile: {warc.PROFILE}\r\nWARC-Refers-To: {name(first)}\r\n" if revisit else ""
    line = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    head = f"WARC/1.1\r\nWARC-Type: {'revisit' if revisit else 'response'}\r\nWARC-Record-ID: {name(page)}\r\nWARC-Date: {warc.DATE}\r\nWARC-Target-URI: {line}\r\nWARC-Payload-Digest: sha1:{digest}\r\n{more}Content-Type: application/http; msgtype=response\r\nContent-Length: {len(http) + (0 if revisit else len(body))}\r\n\r\n{http}"
    return head.encode() + (b"" if revisit else body) + b"\r\n\r\n"


@pytest.mark.parametrize("broadcast_rows", [warc.BROADCAST_ROWS, -1])
def test_archive_byte_for_byte(spark, broadcast_rows):
    """Every record of a whole table, rebuilt by the path of the query, against bytes made plainly;
    with a payload that a third of the rows share, split URLs and an id at the end of its range."""
    table = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    last = 2**63 - 1
    table += [(10_000 + i, f"http://a.b/{i}\r\nX: y", "<p>hot</p>") for i in range(len(table) // 2)] + [(last, "http://last", "own"), (None, "http://none", "own"), (None, None, "alone"), (None, None, "alone")]
    df = spark.createDataFrame(table, "page_id long, url string, html string").repartition(4)
    root = scratch(spark, "test")
    warc.write_archive(df, root, broadcast_rows=broadcast_rows)
    owner = {}
    for i, _, html in table:
        key = (i is None, i or 0)
        owner[html or ""] = min(owner.get(html or "", key), key)
    want = []
    for i, url, html in table:
        first = owner[html or ""]
        want.append(_header(i, url, html, None if first == (i is None, i or 0) else first[1]))
    got = warc.read_archive(spark, root, share_rows=7).collect()
    assert sorted(bytes(r["record"]) for r in got) == sorted(want)
    assert sorted((r["url"] or "") for r in got) == sorted(u or "" for _, u, _ in table) and all(r["verified"] for r in got)
    assert spark.read.parquet(f"{root}/payloads").count() == len(owner)
    by = {r["page_id"]: r for r in warc.index(spark, root).collect() if r["page_id"] is not None}
    assert by[last]["record_type"] == "response" and by[last]["verified"] and by[10_000]["payload_bytes"] == 10


def test_hosts(pages):
    got = {r["page_id"]: r for r in hosts.judge(pages).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[2]["verdict"] == "block" and got[3]["host"] == got[4]["host"] == got[7]["host"] == "" and got[5]["rule"] == "example.net/de/8"
    assert got[6]["host"] == "host" and got[6]["path"] == ""
    assert hosts.judge(pages).count() == len(PAGES) and hosts.judge(pages.limit(0)).count() == 0
    assert hosts.judge(pages, rules=()).where("verdict = 'block'").count() == 0


def test_hosts_with_names_of_its_columns(spark, pages):
    """Columns called like the operator's own, and one host with most of the rows."""
    own = pages
    for c in ("host", "path", "rule", "verdict", "rows", "bad", "said", "blocked", "domain", "suffix"):
        own = own.withColumn(c, F.lit("x"))
    assert sorted(map(str, hosts.judge(own).collect())) == sorted(map(str, hosts.judge(pages).collect()))
    many = spark.range(2000).select(F.col("id").alias("page_id"), F.when(F.col("id") < 1500, "http://hot.org/es/1").otherwise(F.concat(F.lit("http://h"), F.col("id") % 7, F.lit(".co.uk:8080/x"))).alias("url"))
    got = hosts.judge(many).groupBy("host", "verdict").count().collect()
    assert {(r["host"], r["verdict"]): r["count"] for r in got}[("hot.org", "block")] == 1500 and sum(r["count"] for r in got) == 2000
    h = spark.createDataFrame([("a.b.co.uk:80",), ("co.uk",), ("x.y.de",), ("10.0.0.1:99",), ("[::1]:80",), ("",), ("local",)], "host string")
    domain, suffix = hosts.levels(F.col("host"))
    assert [tuple(r) for r in h.select(domain, suffix).collect()] == [("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("y.de", "de"), ("10.0.0.1", ""), ("[::1]", ""), ("", ""), ("local", "local")]


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    v = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [1.0, 0.0]), (None, [1.0, 0.0]), (100, [-1.0, 0.0]), (11, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x")).withColumn("score", F.lit("x"))
    got = {}
    for r in neighbours.nearest(df, answers=3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], round(r["score"], 6)))
    assert sorted(got[0]) == [(1, 9, 1.0), (2, 50, 1.0), (3, 2, 0.707107)]
    assert sorted(got[50]) == [(1, 0, 1.0), (2, 9, 1.0), (3, 2, 0.707107)]
    assert sorted(got[100])[0] == (1, 1, 0.0)
    assert neighbours.nearest(df.limit(0)).count() == 0
    assert neighbours.nearest(df.where("vec_id = 0")).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, docs, none, k):
    _, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, "unused")
    if k < 4:
        assert out.columns == docs.columns and {r[c] for r in out.collect() for c in CLASH} == {"x"}
    out.count()
    assert stage(spark, none, "unused").count() == 0
