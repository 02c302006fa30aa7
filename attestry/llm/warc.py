"""WARC derivatives: linked metadata and plain-text conversion records for response records.

Records are rows of RECORD: the named WARC headers in order, and the block. ``responses`` wraps web pages
in HTTP response records; ``derive`` makes for each response a metadata record (application/warc-fields:
source headers, payload digest and length) and a conversion record (text/plain: the page's text). Both carry
WARC-Refers-To with the response's WARC-Record-ID, its target URI and date, and digests of their own.
``write_warc`` writes records as WARC/1.1 files, ``read_warc`` reads them back.

Digests are sha1 in lower-case hexadecimal (the format leaves the encoding open). Record ids are
urn:uuid from a hash of what the record is made of, so a repeated run writes the same bytes.

Plain text: scripts, styles and comments go, block ends and <br> become line feeds, other tags go, the
entities amp, lt, gt, quot, apos/#39 and nbsp are decoded (amp last), runs of blanks and blank lines collapse.

Defined cases: a null html is an empty payload, a null url is the URI "urn:unknown"; rows that repeat give
records each, with equal ids; line breaks in a URL become %0A and %0D; an empty table gives no records;
extra columns are not read.

Scale: making records is rows only, no exchange, and every expression is built in. Reading takes a file per row (2 GB
at most, Spark's bound for one; WARC files are about 1 GB by convention), whose records stream out in small batches.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
#: Columns of a record; refers_to is null for responses.
RECORD = ("key", "type", "record_id", "refers_to", "target", "date", "content_type", "block_digest", "payload_digest", "length", "block")


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _digest(x: Column) -> Column:
    return F.concat(F.lit("sha1:"), F.sha1(x.cast("binary")))


def plain_text(html: Column) -> Column:
    t = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</(?:p|div|li|ul|ol|tr|table|h[1-6]|article|section|nav|title|header|footer)\s*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(sign))
    t = F.regexp_replace(t, r"[ \t\r\f]+", " ")
    t = F.regexp_replace(t, r" ?\n[ \n]*", "\n")
    return F.regexp_replace(t, r"^[ \n]+|[ \n]+$", "")


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """A response record per page (page_id, url, html)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    target = F.replace(F.replace(F.coalesce(F.col("url"), F.lit("urn:unknown")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    base = pages.select(F.col("page_id").alias("key"), target.alias("target"), html.alias("html"))
    base = base.withColumn("block", F.concat(F.lit(HTTP + "Content-Length: "), F.octet_length("html").cast("string"), F.lit(CRLF * 2), F.col("html")))
    return base.select(
        "key", F.lit("response").alias("type"), _uuid(F.lit("response"), F.coalesce(F.col("key").cast("string"), F.lit("null")), F.col("target")).alias("record_id"), F.lit(None).cast("string").alias("refers_to"), "target", F.lit(date).alias("date"),
        F.lit("application/http; msgtype=response").alias("content_type"), _digest(F.col("block")).alias("block_digest"), _digest(F.col("html")).alias("payload_digest"), F.octet_length("block").cast("long").alias("length"), "block",
    )


def payload(block: Column) -> Column:
    """What follows the first empty line of an HTTP message; nothing if there is none."""
    at = F.position(F.lit(CRLF * 2), block)
    return F.when(at > 0, block.substr(at + 4, F.length(block))).otherwise(F.lit(""))


def http_headers(block: Column) -> Column:
    at = F.position(F.lit(CRLF * 2), block)
    return F.when(at > 0, block.substr(F.lit(1), at - 1)).otherwise(block)


def derive(records: DataFrame) -> DataFrame:
    """The metadata and the conversion record of every response record; other types give none."""
    r = records.filter(F.col("type") == "response")
    fields = F.concat(
        F.lit("source-record-id: "), F.col("record_id"), F.lit(CRLF + "source-payload-digest: "), F.col("payload_digest"), F.lit(CRLF + "source-length: "), F.col("length").cast("string"), F.lit(CRLF),
        F.array_join(F.transform(F.split(http_headers(F.col("block")), CRLF), lambda h: F.concat(F.lit("source-http: "), h, F.lit(CRLF))), ""),
    )
    made = F.array(
        F.struct(F.lit("metadata").alias("type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("type"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(payload(F.col("block"))).alias("block")),
    )
    d = r.select("key", "target", "date", F.col("record_id").alias("refers_to"), F.explode(made).alias("d"))
    return d.select(
        "key", F.col("d.type").alias("type"), _uuid(F.col("d.type"), F.col("refers_to")).alias("record_id"), "refers_to", "target", "date", F.col("d.content_type").alias("content_type"),
        _digest(F.col("d.block")).alias("block_digest"), _digest(F.col("d.block")).alias("payload_digest"), F.octet_length("d.block").cast("long").alias("length"), F.col("d.block").alias("block"),
    )


def serialised(records: DataFrame) -> DataFrame:
    """One string column: header lines, an empty line and the block, without the two line ends that close a record."""
    line = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), c.cast("string"), F.lit(CRLF))).otherwise(F.lit(""))
    names = (("WARC-Type", "type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target"), ("WARC-Date", "date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "payload_digest"), ("Content-Type", "content_type"), ("Content-Length", "length"))
    return records.select(F.concat(F.lit("WARC/1.1" + CRLF), *[line(n, F.col(c)) for n, c in names], F.lit(CRLF), F.col("block")).alias("value"))


def write_warc(records: DataFrame, path: str) -> None:
    """A WARC file per task; a record's closing line ends are the writer's line separator."""
    serialised(records).write.option("lineSep", CRLF * 2).text(path)


def parse_warc(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a WARC stream (plain, or gzip as a whole or by record), one at a time: headers by lower-case name, and the block."""
    buffered = io.BufferedReader(source) if not hasattr(source, "peek") else source
    if buffered.peek(2)[:2] == b"\x1f\x8b":
        buffered = gzip.GzipFile(fileobj=buffered)
    line = buffered.readline()
    while line:
        if not line.strip():  # between records
            line = buffered.readline()
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        head, last = {}, ""
        while (line := buffered.readline()).strip():
            text = line.decode("utf-8").rstrip("\r\n")
            if text[0] in " \t" and last:  # a header goes on
                head[last] += " " + text.strip()
            else:
                last, _, value = text.partition(":")
                last = last.strip().lower()
                head[last] = value.strip()
        n = int(head["content-length"])
        block = buffered.read(n)
        if len(block) < n:
            raise ValueError("a record's block ends early")
        yield head, block
        line = buffered.readline()


class _Stream(io.RawIOBase):
    """An Arrow stream, as Python's buffered readers take it."""

    def __init__(self, stream):
        self.stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.stream.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


#: Bytes of blocks that make a batch.
BATCH_BYTES = 8 << 20


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records (RECORD without key) of the WARC files under path, plain or gzip. A block that isn't UTF-8 gets replacement characters; its digest is that of the header."""

    def run(batches):
        import pyarrow as pa

        names = ("warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-date", "content-type", "warc-block-digest", "warc-payload-digest")

        def made(own):
            return pa.RecordBatch.from_arrays([*[pa.array([h.get(n) for h, _ in own], pa.string()) for n in names], pa.array([len(b) for _, b in own], pa.int64()), pa.array([b.decode("utf-8", "replace") for _, b in own], pa.string())], names=list(RECORD[1:]))

        for batch in batches:
            for content in batch.column(0):
                own, size = [], 0
                for record in parse_warc(_Stream(pa.BufferReader(content.as_buffer()))):
                    own.append(record)
                    size += len(record[1])
                    if size >= BATCH_BYTES:
                        yield made(own)
                        own, size = [], 0
                if own:
                    yield made(own)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "type string, record_id string, refers_to string, target string, date string, content_type string, block_digest string, payload_digest string, length long, block string")


def op8_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    made = derive(responses(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))
    return made.select(F.col("key").alias("page_id"), "type", "record_id", "refers_to", "target", "content_type", "block_digest", "length", F.md5(F.col("block")).alias("block_md5"))


ORACLE = r"""
WITH src AS (
  SELECT page_id, replace(replace(coalesce(url, 'urn:unknown'), chr(13), '%0D'), chr(10), '%0A') AS target, coalesce(html, '') AS html FROM pages
), resp AS (
  SELECT page_id, target, html, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' AS h1, 'Content-Length: ' || strlen(html) AS h2,
    md5('response|' || coalesce(page_id::VARCHAR, 'null') || '|' || target) AS h FROM src
), ids AS (
  SELECT *, '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' AS rid, chr(13) || chr(10) AS nl FROM resp
), txt AS (
  SELECT *, h1 || nl || h2 AS head,
    regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'),
      '(?i)<br\s*/?>|</(?:p|div|li|ul|ol|tr|table|h[1-6]|article|section|nav|title|header|footer)\s*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t0 FROM ids
), txt2 AS (
  SELECT *, replace(replace(replace(replace(replace(replace(replace(t0, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&apos;', chr(39)), '&amp;', '&') AS t1 FROM txt
), blocks AS (
  SELECT page_id, target, rid, 'metadata' AS type, 'application/warc-fields' AS content_type,
    'source-record-id: ' || rid || nl || 'source-payload-digest: sha1:' || sha1(html) || nl || 'source-length: ' || (strlen(head) + 4 + strlen(html)) || nl
      || 'source-http: HTTP/1.1 200 OK' || nl || 'source-http: Content-Type: text/html; charset=utf-8' || nl || 'source-http: ' || h2 || nl AS block FROM txt2
  UNION ALL
  SELECT page_id, target, rid, 'conversion', 'text/plain; charset=utf-8',
    regexp_replace(regexp_replace(regexp_replace(t1, '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') FROM txt2
), named AS (SELECT *, md5(type || '|' || rid) AS h FROM blocks)
SELECT page_id, type, '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' AS record_id, rid AS refers_to, target, content_type,
  'sha1:' || sha1(block) AS block_digest, strlen(block)::BIGINT AS length, md5(block) AS block_md5 FROM named
"""
