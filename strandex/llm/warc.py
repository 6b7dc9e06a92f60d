"""WARC: a content-addressed archive of web pages.

Payload bytes are stored once, under a strong digest (SHA-256, verified on reading together with the length and the
SHA-1 of the record); record headers are kept exactly, apart from the payloads; whole records come back by a join.

archive() writes WARC/1.1 files: a `response` record with its payload for the row with the smallest page_id of each
payload, `revisit` records without payload for the others.  read_archive() parses such files into headers and payloads,
content_store() splits them into the two tables, reconstruct() joins them to full records.  Files are gzip-compressed
text files with the record separator as line separator, so Spark's own readers and writers reach them in any store, and
are never split; the parser streams and holds one record.

Edge cases: null html is empty; a null page_id comes last, so a payload that only such rows have is a response in each;
rows with equal page_id and payload are all responses if theirs is the smallest; a null url gives no target line.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, release, shared_dir, stored

MIN_BYTES = 0  # smaller payloads are stored in each record
RECORDS_PER_FILE = 50_000
SEPARATOR = "\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"  # pages carry no crawl time
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(hexed):
    """Base32 of 40 hex digits: each five of them are four characters."""
    parts = []
    for g in range(8):
        v = F.conv(F.substring(hexed, 5 * g + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(_BASE32), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def digests(pages: DataFrame) -> DataFrame:
    """page_id, url, n, sha1 (base32), key of each row's payload."""
    body = F.coalesce(F.col("html"), F.lit(""))
    hashed = pages.select("page_id", "url", F.octet_length(body).cast("long").alias("n"), F.sha1(F.encode(body, "UTF-8")).alias("x"), F.sha2(body, 256).alias("key"))
    return hashed.select("page_id", "url", "n", base32_of_hex(F.col("x")).alias("sha1"), "key")


def records(named: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Adds record_type, refers_to and header to what digests() gives."""
    first = named.where(F.col("n") >= min_bytes).groupBy("key").agg(F.min("page_id").alias("first"))
    both = named.join(first, "key", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    typed = both.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("first"))})
    name = lambda i: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(SEPARATOR))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")), F.lit(f"\r\nWARC-Date: {DATE}"),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("\r\nWARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]+", " "))).otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("sha1"), F.lit("\r\nX-Payload-SHA256: "), F.col("key"), F.lit("\r\nX-Payload-Length: "), F.col("n").cast("string"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("refers_to")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.when(revisit, F.lit("0")).otherwise((F.length(http) + F.col("n")).cast("string")),
    )
    return typed.select("page_id", "key", "record_type", "refers_to", "sha1", "n", header.alias("header"), F.when(~revisit, http).alias("http"))


def archive(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    """Writes a record for each row of pages(page_id, url, html, ...) as gzip-compressed WARC files under path."""
    named = stored(digests(pages), "digests")
    wanted = stored(records(named, min_bytes).select("page_id", "key", "record_type", "header", "http"), "headers")
    # A page_id that occurs once names its payload; only where one occurs twice are the payloads' digests taken again.
    alone = named.groupBy("page_id").count().where("count > 1").limit(1).isEmpty()
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("id")
    body = F.coalesce(F.col("html"), F.lit(""))
    bodies = pages.select(name, body.alias("body"), (F.lit("") if alone else F.sha2(body, 256)).alias("key"))
    # Rows equal in page_id, key and header meet once each: the headers are made distinct with their number.
    wanted = wanted.groupBy("page_id", "key", "record_type", "header", "http").count()
    answers = wanted.where("record_type = 'response'").select(name, (F.lit("") if alone else F.col("key")).alias("key"), "header", "http", "count")
    one = bodies.join(answers.select("id", "key"), ["id", "key"], "left_semi")
    full = answers.join(one if alone else one.dropDuplicates(["id", "key"]), ["id", "key"])
    value = F.concat(F.col("header"), F.lit(SEPARATOR), F.col("http"), F.col("body"))
    full = full.select(value.alias("value"), "count")
    again = wanted.where("record_type = 'revisit'").select(F.concat(F.col("header"), F.lit(SEPARATOR)).alias("value"), "count")
    if not alone:
        full = full.select("value", F.explode(F.array_repeat(F.lit(1), F.col("count").cast("int")))).select("value")
    again = again.select("value", F.explode(F.array_repeat(F.lit(1), F.col("count").cast("int")))).select("value")
    full.select("value").union(again).write.option("lineSep", SEPARATOR).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """header and payload (null for revisits) of each record under path."""

    def parse(batches):
        buffer = bytearray()
        end = SEPARATOR.encode()
        for b in batches:
            headers, payloads = [], []
            for piece in b.column(0):
                buffer += piece.as_buffer().to_pybytes() if piece.is_valid else b""
                buffer += end
                while True:
                    skip = len(buffer) - len(buffer.lstrip(b"\r\n")) if buffer[:1] in (b"\r", b"\n") else 0
                    cut = buffer.find(end, skip)
                    if cut < 0 or skip == len(buffer):
                        break
                    head = bytes(buffer[skip:cut])
                    size = int(re.search(rb"(?m)^Content-Length: (\d+)", head)[1])
                    stop = cut + len(end) + size
                    if len(buffer) < stop + len(end):
                        break
                    block = bytes(buffer[cut + len(end) : stop])
                    headers.append(head.decode())
                    payloads.append(block.partition(end)[2].decode() if size else None)
                    del buffer[: stop + len(end)]
            yield pa.RecordBatch.from_arrays([pa.array(headers, pa.string()), pa.array(payloads, pa.string())], ["header", "payload"])
        if buffer.strip():
            raise ValueError("an archive file ends inside a record")

    return spark.read.option("lineSep", SEPARATOR).text(path).mapInArrow(parse, "header string, payload string")


def field(name: str, pattern: str = r"[^\r\n]*"):
    return F.nullif(F.regexp_extract("header", rf"(?m)^{name}: ({pattern})", 1), F.lit(""))


def content_store(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """headers (header, key) and payloads (key, payload, sha1, payload_bytes), each payload once and held against its digests and length.

    No column of the payloads is had without that check, so that a reader of digests and lengths alone moves no payload.
    """
    headers = parsed.select("header", field("X-Payload-SHA256").alias("key"))
    full = parsed.where(F.col("payload").isNotNull()).select("header", "payload", field("X-Payload-SHA256").alias("key"), F.sha1(F.encode("payload", "UTF-8")).alias("x"))
    full = full.withColumn("sha1", base32_of_hex(F.col("x"))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    same = (F.sha2("payload", 256) == F.col("key")) & (F.col("payload_bytes") == field("X-Payload-Length").cast("long")) & (F.col("sha1") == field("WARC-Payload-Digest", "sha1:.*").substr(6, 32))
    names = ["payload", "sha1", "payload_bytes"]
    checked = full.select("key", F.when(same, F.struct(*names)).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest: "), "header"))).alias("good")).select("key", "good.*")
    return headers, checked.groupBy("key").agg(*[F.first(n).alias(n) for n in names])


def reconstruct(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """page_id, url, header and payload of each original record."""
    row = headers.join(payloads.select("key", "payload"), "key", "left")
    return row.select(F.regexp_extract("header", r"(?m)^WARC-Record-ID: <urn:page:(-?\d+)>", 1).try_cast("long").alias("page_id"), field("WARC-Target-URI").alias("url"), "header", "payload")


def query(spark, sf_dir) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archive(read(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    release(spark)  # of the shuffled payloads, as they are in the archive now
    headers, payloads = content_store(read_archive(spark, path))
    # What the result needs of a payload: its length and digest, taken from the bytes that came back and checked.
    seen = payloads.select("key", "payload_bytes", F.col("sha1").alias("payload_digest"))
    row = stored(headers, "record-headers").join(stored(seen, "payloads"), "key", "left")
    name = lambda f: F.regexp_extract("header", rf"(?m)^{f}: <urn:page:(-?\d+)>", 1).try_cast("long")
    return row.select(name("WARC-Record-ID").alias("page_id"), "payload_bytes", "payload_digest", field("WARC-Type").alias("record_type"), name("WARC-Refers-To").alias("refers_to"))


_SHIFTS = ", ".join(f"substr('{_BASE32}', ((('0x' || substr(x, {5 * g + 1}, 5))::INT >> {s}) & 31) + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT body, min(page_id) AS first FROM p GROUP BY body)
SELECT page_id, strlen(p.body)::BIGINT AS payload_bytes, concat({_SHIFTS}) AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (body)
"""
