"""A content-addressed web archive.

An archive is two tables in one folder. `payloads` holds each payload's bytes once, under their
SHA-256, with the number of records that have it. `records` holds, for each record, its exact
header bytes (the WARC header and the HTTP header) and the address of its payload. Joining the two
on the address gives back the records byte for byte; what is read back is checked by computing the
digests of the bytes again. A payload that very many records share is dealt out in copies, so that
no task has to rebuild all of them.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from .shared import materialise, read, scratch, small_batches

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records with one payload that one task rebuilds, about.
SHARE_ROWS = 500
#: Rows whose payloads needn't be stored, up to which they are broadcast (some 60 bytes each).
BROADCAST_ROWS = 500_000
END = b"\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits make four characters."""
    digits = F.sha1(payload)
    parts = []
    for i in range(8):
        n = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(ALPHABET), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def _header(kind: Column, record: Column, first: Column, uri: Column, digest: Column, size: Column) -> Column:
    """The WARC and HTTP headers of a record. A header line can't hold a line break, so CR and LF of
    an URI are written as %0D and %0A there; the table keeps the URI as it was."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    length = F.when(kind == "response", F.length(F.encode(http, "UTF-8")) + size).otherwise(F.length(F.encode(http, "UTF-8")))
    revisit = F.when(kind == "revisit", F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name(first), F.lit("\r\n"))).otherwise("")
    line = F.replace(F.replace(F.coalesce(uri, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.encode(
        F.concat(
            F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), name(record), F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "),
            line, F.lit("\r\nWARC-Payload-Digest: sha1:"), digest, F.lit("\r\n"), revisit,
            F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"), http,
        ),
        "UTF-8",
    )


def write_archive(pages: DataFrame, root: str, least_bytes: int = 0, broadcast_rows: int = BROADCAST_ROWS) -> None:
    """Archive pages(page_id long, url string, html string) under root.

    Of records whose payloads are equal and have least_bytes or more, that with the smallest
    page_id is the response and the others revisit it; rows that repeat that page_id are responses
    too. Smaller payloads are all responses. A null html is an empty payload, a null url an empty
    URI. A null page_id sorts after all others, its record is named null, and it is referred to only
    where all copies are null. Very long payloads are stored whole. An empty table gives two empty
    tables. Other columns, whatever their names, are not read.

    Digests alone are shuffled to find the owner of each payload. Payloads are then stored from
    where they are read: rows that don't own theirs are left out by an anti join, broadcast where
    there are few of them (counted), so that no duplicate's bytes are shuffled.
    """
    content = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    p = pages.select(F.col("page_id").cast("long").alias("id"), F.col("url").cast("string").alias("url"), content.alias("payload"))
    p = p.withColumn("address", F.sha2("payload", 256)).withColumn("order", F.struct(F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("n")))
    d = materialise(p.select("id", "order", "url", "address", base32_sha1(F.col("payload")).alias("digest"), F.length("payload").cast("long").alias("size")), "digests")
    owners = materialise(d.groupBy("address").agg(F.min("order").alias("owner"), F.count("*").alias("n_records")), "owners")
    many = owners.where("n_records > 1")
    # rows of shared payloads by whether they own theirs; an owner whose row repeats is stored from one of them
    rows = d.select("address", "order").join(many, "address").groupBy("address", "order").agg(F.count("*").alias("n"), F.first("owner").alias("owner"))
    rows = materialise(rows.where("order <> owner OR n > 1"), "unstored")
    small = rows.limit(broadcast_rows + 1).count() <= broadcast_rows
    out = p.join(F.broadcast(rows) if small else rows, ["address", "order"], "left_anti").select("address", "payload")
    again = rows.where("order = owner").select("address", "order")
    if not again.isEmpty():
        out = out.unionByName(p.join(F.broadcast(again) if small else again, ["address", "order"], "left_semi").dropDuplicates(["address"]).select("address", "payload"))
    copies = F.broadcast(many.select("address", "n_records")) if small else many.select("address", "n_records")
    out.join(copies, "address", "left").select("address", "payload", F.coalesce("n_records", F.lit(1).cast("long")).alias("n_records")).write.parquet(f"{root}/payloads")
    r = d.join(owners, "address")
    first = F.when(~F.col("owner.none"), F.col("owner.n"))
    kind = F.when((F.col("size") >= least_bytes) & (F.col("order") != F.col("owner")), F.lit("revisit")).otherwise(F.lit("response"))
    r = r.select("address", "n_records", "url", _header(kind, F.col("id"), first, F.col("url"), F.col("digest"), F.col("size")).alias("header"))
    r.write.parquet(f"{root}/records")


def _field(name: str) -> Column:
    return F.regexp_extract(F.col("head"), rf"\r\n{name}: ([^\r]*)\r\n", 1)


def parse_records(records: DataFrame) -> DataFrame:
    """The header fields of records(header binary, ...), beside the columns that are there."""
    h = records.withColumn("head", F.decode("header", "UTF-8"))
    number = lambda f: F.nullif(F.regexp_extract(_field(f), "<urn:page:([^>]*)>", 1), F.lit("null")).try_cast("long")
    return h.select(*records.columns, number("WARC-Record-ID").alias("page_id"), _field("WARC-Type").alias("record_type"), number("WARC-Refers-To").alias("refers_to"),
                    F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", "").alias("header_digest"))


def read_archive(spark: SparkSession, root: str, share_rows: int = SHARE_ROWS) -> DataFrame:
    """One row per record: its exact bytes (a revisit's end after the HTTP header), its payload, its
    URI and the header's fields. verified: the stored bytes have the digests under which they are
    kept. A payload of more than share_rows records is joined in copies."""
    shares = F.ceil(F.col("n_records") / share_rows).cast("int")
    stored = spark.read.parquet(f"{root}/payloads").select("address", "payload", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))
    records = spark.read.parquet(f"{root}/records")
    records = records.select("*", F.pmod(F.xxhash64("header"), shares).cast("int").alias("share")).drop("n_records")
    r = parse_records(records.join(stored, ["address", "share"]).drop("share"))
    whole = F.when(F.col("record_type") == "response", F.concat("header", "payload")).otherwise(F.col("header"))
    ok = (F.sha2("payload", 256) == F.col("address")) & (base32_sha1(F.col("payload")) == F.col("header_digest"))
    return r.withColumn("record", F.concat(whole, F.lit(END))).withColumn("verified", ok)


def export_warc(spark: SparkSession, root: str, path: str) -> None:
    """The archive as WARC files, one a partition: each record is a gzip member of its own, so a
    reader can start at any record's offset. Between records stands an empty member, since the sink
    asks for a separator."""
    small_batches(spark)

    @arrow_udf("binary")
    def member(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for records in batches:
            yield pa.array([gzip.compress(r, mtime=0) for r in records.to_pylist()], pa.binary())

    empty = gzip.compress(b"", mtime=0).decode("latin-1")
    packed = read_archive(spark, root).select(member("record").cast("string").alias("value"))
    packed.write.option("encoding", "ISO-8859-1").option("lineSep", empty).text(path)


def index(spark: SparkSession, root: str) -> DataFrame:
    """A row per record with what its rebuilt bytes say: a response's payload is cut out of the
    record after the two headers, a revisit's is the one that its address leads to."""
    r = read_archive(spark, root)
    head = F.length("header")
    own = F.substring(F.col("record"), head + 1, F.length("record") - head - len(END))
    r = r.withColumn("content", F.when(F.col("record_type") == "response", own).otherwise(F.col("payload")))
    declared = F.regexp_extract(F.decode("header", "UTF-8"), r"\r\nContent-Length: ([0-9]+)\r\n\r\n$", 1).cast("long")
    size, digest = F.length("content").cast("long"), base32_sha1(F.col("content"))
    verified = (digest == F.col("header_digest")) & (F.sha2("content", 256) == F.col("address")) & (size == declared)
    return r.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to", verified.alias("verified"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per page, written and then answered from what the join of headers and payloads
    rebuilds; see write_archive for nulls, repeats and empty tables."""
    root = scratch(spark, "archive")
    write_archive(read(spark, sf_dir, "pages"), root, least_bytes=0)
    return index(spark, root)


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, sha256(payload) AS address, octet_length(payload) AS n, sha1(payload) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY address) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to, true AS verified FROM f
"""
