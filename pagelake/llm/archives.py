"""Web archives: legacy ARC files converted to WARC, and WARC read back.

ARC: a file starts with a version block whose second line names the version
and whose third line names the header fields; each record is one header line
of these fields and a block of the declared length.  Version 1 headers have
five fields (URL, IP, date, content type, length), version 2 ten.  The
converter reads the fields by the names in the version block and the block by
its declared length, and makes the WARC record that a crawler would have
written: a UUID from the record's content and place, the 14-digit date as a
W3C date, type by block, SHA-1 digests of block and payload, and a revisit
record where an equal payload is kept as the response of a smaller page.

Scale: archives are written by Spark's text writer (gzip) into the shared
folder, each file of at most ``FILE_RECORDS`` records, and read with
``binaryFile``, one file a row, so a task holds one compressed file and one
record at a time.  Payload groups are resolved on slim digest rows (a heavy
payload's group is combined map-side); only the revisits join back, broadcast
when a count of them proves small, else by a shuffle.

Defined results: null html is an empty payload; a null url is written as ``-``
and read back as null; a null page_id is kept (its record has no page header
and it sorts last in its group); repeated rows are records of their own, one
of which is the response; an empty table gives empty archives; other columns
are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm.common import bounded_broadcast, map_batches, register, scratch, spill, table

#: Records of an archive file at most.
FILE_RECORDS = 1_000
#: Payloads of fewer bytes are always responses.
LEAST_REVISIT = 0
ARC_DATE = "20240101000000"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: The header fields of the two ARC versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_CRLF = "\r\n"
_HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)")


def first_of_file() -> Column:
    """Whether a row opens a new file: the text writer starts one every FILE_RECORDS rows."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) % FILE_RECORDS == 0


def write_lines(rows: DataFrame, path: str) -> None:
    """One archive member a row; the writer adds the line feed that ends it."""
    (rows.write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
     .option("maxRecordsPerFile", FILE_RECORDS).text(path))


def write_arc(pages: DataFrame, path: str, version: int = 1, date: str = ARC_DATE) -> None:
    """Pages (page_id, url, html) as ARC files of the given version.

    The block is an HTTP response whose ``X-Page-Id`` header keeps the key."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    page = F.col("page_id").cast("long").cast("string")
    url = F.coalesce(F.regexp_replace(F.nullif(F.trim("url"), F.lit("")), r"[\s\x00-\x1f]", "%20"), F.lit("-"))
    head = F.concat(F.lit("HTTP/1.1 200 OK" + _CRLF + "Content-Type: text/html; charset=utf-8" + _CRLF),
                    F.when(page.isNotNull(), F.concat(F.lit("X-Page-Id: "), page, F.lit(_CRLF))).otherwise(F.lit("")),
                    F.lit("Content-Length: "), F.octet_length("body").cast("string"), F.lit(_CRLF + _CRLF))
    size = (F.octet_length("head") + F.octet_length("body")).cast("string")
    middle = " text/html " if version == 1 else " text/html 200 - - 0 pages.arc "
    block = f"{version} 0 pages\n{ARC_FIELDS[version]}\n\n"
    opening = f"filedesc://pages.arc 0.0.0.0 {date} text/plain {len(block)}\n{block}\n"
    if version == 2:
        opening = f"filedesc://pages.arc 0.0.0.0 {date} text/plain 200 - - 0 pages.arc {len(block)}\n{block}\n"
    write_lines(
        pages.select(url.alias("url"), html.alias("body"), F.col("page_id")).withColumn("head", head)
        .select(F.concat(F.when(first_of_file(), F.lit(opening)).otherwise(F.lit("")), "url",
                         F.lit(f" 0.0.0.0 {date}{middle}"), size, F.lit("\n"), "head", "body").alias("value")), path)


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def parse_arc(stream) -> "iter":
    """(offset, fields, block) of every record after the version block."""
    names, place = None, 0
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            place += len(line)
            continue
        parts = line.rstrip(b"\r\n").split(b" ")
        length = int(parts[-1])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError(f"ARC record at {place} is cut short: {len(block)} of {length} bytes")
        if line.startswith(b"filedesc:"):
            lines = block.split(b"\n")
            version = int(lines[0].split(b" ")[0])
            names = lines[1].decode().split()
            if names != ARC_FIELDS.get(version, "").split():
                raise ValueError(f"unknown ARC header of version {version}")
        else:
            if names is None or len(parts) != len(names):
                raise ValueError(f"ARC header at {place} does not have the fields of its version")
            yield place, dict(zip(names, (p.decode("utf-8", "replace") for p in parts))), block
        place += len(line) + length


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Header (with the empty line) and body."""
    cut = block.find(b"\r\n\r\n")
    return (block[:cut + 4], block[cut + 4:]) if block.startswith(b"HTTP/") and cut >= 0 else (b"", block)


def _page_of(head: bytes) -> int | None:
    found = re.search(rb"(?im)^X-Page-Id:[ \t]*(-?\d+)", head)
    return int(found.group(1)) if found else None


_RECORD = [("record", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()),
           ("kind", pa.string()), ("head", pa.string()), ("body", pa.string()), ("payload_bytes", pa.int64()),
           ("payload_digest", pa.string()), ("block_digest", pa.string()), ("head_digest", pa.string())]


def _batch(rows, kinds):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], [n for n, _ in kinds])


def _batches(found, kinds, size_at: int | None):
    """Record batches of bounded size from an iterator of tuples."""
    rows, held = [], 0
    for r in found:
        rows.append(r)
        held += 200 + (len(r[size_at]) if size_at is not None else 0)
        if held > 4 << 20:
            yield _batch(rows, kinds)
            rows, held = [], 0
    if rows:
        yield _batch(rows, kinds)


def _streams(batches):
    for b in batches:
        for path, content in zip(b.column("path"), b.column("content")):
            yield path.as_py().rsplit("/", 1)[-1], gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))


def _spark_type(kinds) -> str:
    return ", ".join(f"{n} {'long' if k == pa.int64() else 'string'}" for n, k in kinds)


def convert_arc(spark: SparkSession, path: str, bodies: bool = True) -> DataFrame:
    """The WARC fields of every ARC record under ``path``; without ``bodies``
    only what is needed to find equal payloads."""
    def records(batches):
        for name, stream in _streams(batches):
            part = "-".join(name.split("-")[:2]) + name[-16:]  # the writer's random part left out
            for place, f, block in parse_arc(stream):
                head, body = split_http(block)
                digest = base32_sha1(body)
                key = hashlib.md5(f"{part} {place} {f['URL']} {f['Archive-date']} {digest}".encode()).hexdigest()
                d = f["Archive-date"]
                yield (f"<urn:uuid:{key[:8]}-{key[8:12]}-{key[12:16]}-{key[16:20]}-{key[20:]}>", _page_of(head),
                       f["URL"], f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
                       "response" if head else "resource", head.decode() if bodies else "",
                       body.decode() if bodies else "", len(body), digest, base32_sha1(block) if bodies else "",
                       base32_sha1(head) if bodies else "")

    return map_batches(files(spark, path), lambda b: _batches(records(b), _RECORD, 6), _spark_type(_RECORD))


def revisits(records: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(record, refers_record, refers_url, refers_date) of the records whose
    payload an earlier page has: the smallest page_id of a payload answers."""
    slim = records.where(F.col("payload_bytes") >= least).select("record", "page_id", "url", "date", "payload_bytes",
                                                                 "payload_digest")
    first = F.struct(F.col("page_id").isNull().alias("no"), "page_id", "record", "url", "date")
    kept = (slim.groupBy("payload_digest", "payload_bytes").agg(F.min(first).alias("first"), F.count("*").alias("n"))
            .where("n > 1"))
    return (slim.select("record", "payload_digest", "payload_bytes")
            .join(bounded_broadcast(spill(kept, "payloads")), ["payload_digest", "payload_bytes"])
            .where(F.col("record") != F.col("first.record"))
            .select("record", F.col("first.record").alias("refers_record"), F.col("first.url").alias("refers_url"),
                    F.col("first.date").alias("refers_date")))


def write_warc(records: DataFrame, again: DataFrame, path: str) -> None:
    """Records as WARC 1.1; those in ``again`` as revisits, with the HTTP
    header but without the payload."""
    rows = records.join(bounded_broadcast(again), "record", "left")
    revisit = F.col("refers_record").isNotNull()
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(_CRLF))
    body = F.when(revisit, F.lit("")).otherwise(F.col("body"))
    size = (F.octet_length("head") + F.octet_length(body)).cast("string")
    head = F.concat(
        F.lit("WARC/1.1" + _CRLF), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.col("kind"))),
        line("WARC-Record-ID", F.col("record")), line("WARC-Date", F.col("date")), line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.when(revisit, F.col("head_digest")).otherwise(F.col("block_digest")))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.col("refers_record")),
                                 line("WARC-Refers-To-Target-URI", F.col("refers_url")),
                                 line("WARC-Refers-To-Date", F.col("refers_date")))).otherwise(F.lit("")),
        line("Content-Type", F.when(F.col("kind") == "response", F.lit("application/http; msgtype=response"))
             .otherwise(F.lit("text/html"))), F.lit("Content-Length: "), size, F.lit(_CRLF + _CRLF))
    note = "software: pagelake" + _CRLF
    info = (f"WARC/1.1{_CRLF}WARC-Type: warcinfo{_CRLF}WARC-Record-ID: <urn:uuid:00000000-0000-4000-8000-000000000000>{_CRLF}"
            f"WARC-Date: 2024-01-01T00:00:00Z{_CRLF}Content-Type: application/warc-fields{_CRLF}"
            f"Content-Length: {len(note)}{_CRLF}{_CRLF}{note}{_CRLF}{_CRLF}")
    # a record ends with two CRLFs, the last line feed of which the writer adds
    write_lines(rows.select(F.concat(F.when(first_of_file(), F.lit(info)).otherwise(F.lit("")), head, "head", body,
                                     F.lit(_CRLF + "\r")).alias("value")), path)


def parse_warc(stream) -> "iter":
    """(headers, block) of every record, by declared lengths."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, value = _HEADER.match(line).groups()
            headers[name.decode().lower()] = value.decode()
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError(f"WARC record {headers.get('warc-record-id')} is cut short")
        yield headers, block


_READ = [("record", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()),
         ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
         ("refers_record", pa.string()), ("payload", pa.string())]


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records of the archives under ``path``.  Digests are checked against the
    bytes; a revisit's payload length is that of its HTTP header."""
    def records(batches):
        for _, stream in _streams(batches):
            for h, block in parse_warc(stream):
                if h["warc-type"] not in ("response", "resource", "revisit"):
                    continue
                if h["warc-block-digest"] != "sha1:" + base32_sha1(block):
                    raise ValueError(f"digest of {h['warc-record-id']} does not match")
                head, body = split_http(block)
                digest = h["warc-payload-digest"].removeprefix("sha1:")
                size = len(body)
                if h["warc-type"] == "revisit":
                    size = int(re.search(rb"(?im)^Content-Length:[ \t]*(\d+)", head).group(1))
                elif digest != base32_sha1(body):
                    raise ValueError(f"payload digest of {h['warc-record-id']} does not match")
                url = h["warc-target-uri"]
                yield (h["warc-record-id"], _page_of(head), None if url == "-" else url, h["warc-date"], h["warc-type"],
                       size, digest, h.get("warc-refers-to"),
                       body.decode() if payloads and h["warc-type"] != "revisit" else None if payloads else "")

    return map_batches(files(spark, path), lambda b: _batches(records(b), _READ, None), _spark_type(_READ))


def convert(spark: SparkSession, arc: str, warc: str, least: int = LEAST_REVISIT) -> None:
    """ARC files under ``arc`` as WARC files under ``warc``."""
    again = spill(revisits(spill(convert_arc(spark, arc, bodies=False).select(
        "record", "page_id", "url", "date", "payload_bytes", "payload_digest"), "records"), least), "revisits")
    write_warc(convert_arc(spark, arc), again, warc)


def page_records(records: DataFrame) -> DataFrame:
    """Records with ``refers_to``, the page_id of the response a revisit names."""
    told = spill(records.select("record", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_record"), "warc")
    named = told.where("record_type = 'revisit'").select(F.col("refers_record").alias("record")).distinct()
    answers = (told.select("record", "page_id").join(named, "record", "left_semi")
               .select(F.col("record").alias("refers_record"), F.col("page_id").alias("refers_to")))
    return told.join(bounded_broadcast(spill(answers, "answers")), "refers_record", "left")


@register("op9_arc_to_warc", r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha1(body) AS hex FROM p),
b AS (SELECT page_id, payload_bytes, hex, array_to_string([substr(
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(hex, 1 + 5 * (k // 4), 5))::BIGINT
          >> (15 - 5 * (k % 4))) & 31 AS INTEGER), 1) for k in range(0, 32)], '') AS payload_digest FROM h)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = min(page_id) OVER g THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = min(page_id) OVER g THEN NULL ELSE min(page_id) OVER g END AS refers_to
FROM b WINDOW g AS (PARTITION BY hex)
""")
def op9_arc_to_warc(spark, sf_dir):
    arc, warc = scratch(spark, "arc"), scratch(spark, "warc")
    write_arc(table(spark, sf_dir, "pages"), arc)
    convert(spark, arc, warc)
    return page_records(read_warc(spark, warc)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
