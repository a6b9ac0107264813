"""A content-addressed WARC archive.

``archive`` writes two tables to the shared folder: payload bytes, once for each SHA-256 digest, and the exact
header bytes of every record. Of records with equal payloads of at least LEAST bytes, those of the largest id are
responses and the others revisits of it; smaller payloads are always responses. ``records`` joins headers and
payloads again, verifies each payload against its digest (a mismatch fails the query), and rebuilds each record's
bytes.

Null html counts as empty. Repeated rows of the largest id are all responses. A null id counts as smaller than any
other; a group whose ids are all null has responses only. Columns beside the three are left out, whatever their names. A null url leaves WARC-Target-URI out, and control
characters in a url are dropped. Empty tables give empty archives.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, table
from .graph import spread

LEAST = 1000
#: Records of one payload that are read in a task.
EACH = 256
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Archive:
    headers: str
    payloads: str


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = DATE) -> Archive:
    folder = shared_dir(pages.sparkSession, "warc")
    out = Archive(f"{folder}/headers", f"{folder}/payloads")
    payload = F.coalesce(F.encode(F.col(html), "UTF-8"), F.unhex(F.lit("")))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload")).withColumn("address", F.sha2("payload", 256))
    # one row an address, combined before the shuffle
    rows.groupBy("address").agg(F.first("payload").alias("payload"), F.count("*").alias("copies")).write.option("compression", "zstd").parquet(out.payloads)
    slim = rows.select("page_id", "url", "address", F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("digest"))
    shared = slim.groupBy("address").agg(F.max("page_id").alias("kept"), F.count("*").alias("copies")).where("copies > 1")
    # the commonest payload may be that of a third of all records
    marked = spread(slim, shared, "address", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    revisit = (F.col("bytes") >= LEAST) & F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", urn(F.col("page_id"))),
        _line("WARC-Target-URI", F.regexp_replace("url", r"\p{Cntrl}", "")),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        _line("WARC-Refers-To", F.when(revisit, urn(F.col("kept")))),
        _line("WARC-Profile", F.when(revisit, PROFILE)),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", block.cast("string")),
        F.lit("\r\n"),
        http,
    )
    # records of one payload are dealt to parts, each of which the payload goes to once
    part = F.pmod(F.monotonically_increasing_id(), F.ceil(F.col("copies") / EACH)).cast("int")
    marked.select("page_id", "address", "copies", part.alias("part"), F.encode(header, "UTF-8").alias("header")).write.option("compression", "zstd").parquet(out.headers)
    return out


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract(F.decode("header", "UTF-8"), rf"\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def records(spark, at: Archive) -> DataFrame:
    """(page_id, record_type, refers_to, digest, payload, record): every record read back; ``payload`` is the full one, ``record`` its own bytes."""
    headers, payloads = spark.read.parquet(at.headers), spark.read.parquet(at.payloads)
    checked = F.when(F.sha2("payload", 256) == F.col("address"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("the payload isn't that of "), "address")).cast("binary"))
    parts = F.explode(F.sequence(F.lit(0), F.ceil(F.col("copies") / EACH).cast("int") - 1))
    joined = headers.join(payloads.select("address", checked.alias("payload"), parts.alias("part")), ["address", "part"], "left")
    kind = _field("WARC-Type")
    end = F.encode(F.lit("\r\n\r\n"), "UTF-8")
    return joined.select(
        "page_id",
        kind.alias("record_type"),
        F.nullif(F.regexp_extract(_field("WARC-Refers-To"), "<urn:page:(.*)>", 1), F.lit("")).cast(headers.schema["page_id"].dataType).alias("refers_to"),
        F.substring(_field("WARC-Payload-Digest"), 6, 40).alias("digest"),
        F.coalesce("payload", F.raise_error(F.concat(F.lit("no payload at "), "address")).cast("binary")).alias("payload"),
        F.when(kind == "response", F.concat("header", "payload", end)).otherwise(F.concat(F.col("header"), end)).alias("record"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op7: pages archived and read back; bytes and digest are those of the payload that was read, and the last is that of the whole record."""
    at = archive(table(spark, sf_dir, "pages"))
    out = records(spark, at)
    return out.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", "refers_to", F.sha1("record").alias("record_sha1"))


SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages),
k AS (SELECT body, max(page_id) AS kept FROM p WHERE octet_length(encode(body)) >= 1000 GROUP BY body),
r AS (SELECT p.*, CASE WHEN k.kept IS NOT NULL AND p.page_id IS DISTINCT FROM k.kept THEN k.kept END AS refers_to, octet_length(encode(p.body)) AS bytes FROM p LEFT JOIN k ON k.body = p.body),
h AS (SELECT *, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, chr(13) || chr(10) AS nl,
  'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || bytes || chr(13) || chr(10) || chr(13) || chr(10) AS http FROM r)
SELECT page_id, bytes AS payload_bytes, sha1(body) AS payload_digest, record_type, refers_to,
  sha1('WARC/1.1' || nl || 'WARC-Type: ' || record_type || nl || 'WARC-Record-ID: <urn:page:' || page_id || '>' || nl || coalesce('WARC-Target-URI: ' || regexp_replace(url, '[[:cntrl:]]', '', 'g') || nl, '')
    || 'WARC-Date: 2024-01-01T00:00:00Z' || nl || 'WARC-Payload-Digest: sha1:' || sha1(body) || nl
    || CASE WHEN refers_to IS NULL THEN '' ELSE 'WARC-Refers-To: <urn:page:' || refers_to || '>' || nl || 'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' || nl END
    || 'Content-Type: application/http; msgtype=response' || nl || 'Content-Length: ' || (octet_length(encode(http)) + CASE WHEN refers_to IS NULL THEN bytes ELSE 0 END) || nl || nl
    || http || CASE WHEN refers_to IS NULL THEN body ELSE '' END || nl || nl) AS record_sha1
FROM h
"""
