"""Legacy web archives (ARC) to WARC: writing, reading and converting, over Spark's text source and sink.

Both formats are plain bytes with declared lengths. A text sink with the format's own line end writes any bytes (values
are binary cast to string), one gzip file per partition through Spark's committer, so a lost executor leaves no half file.
The text source hands out a gzip file whole and in order, so a reader can follow declared lengths line by line with
no more than one record in memory.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kongrid.llm.common import attach_left, scratch

# Fixed values of the two formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
CAPTURED = "20240101000000"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
RECORD_FIELDS = "page_id long, url string, ip string, captured string, mime string, head binary, payload binary, payload_bytes long, payload_digest string, record_id string"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _token(value: str | None) -> str:
    """A header field without blanks or control characters."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value or "") or "-"


def arc_intro(name: str, version: int) -> bytes:
    body = f"{version} 0 kongrid\n{ARC_FIELDS[version]}\n".encode()
    line = f"filedesc://{name} 0.0.0.0 {CAPTURED} text/plain"
    line += f" {len(body)}" if version == 1 else f" 200 - - 0 {name} {len(body)}"
    return line.encode() + b"\n" + body


def arc_record(page_id: int | None, url: str | None, payload: bytes, version: int, offset: int, name: str) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page_id is None else page_id}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    doc = head + payload
    line = f"{_token(url)} 0.0.0.0 {CAPTURED} text/html"
    line += f" {len(doc)}" if version == 1 else f" 200 {hashlib.md5(doc).hexdigest()} - {offset} {name} {len(doc)}"
    return line.encode() + b"\n" + doc


def _values(df: DataFrame, make, path: str, sep: str) -> str:
    lines = df.mapInArrow(make, "value binary").select(F.col("value").cast("string"))
    lines.write.option("lineSep", sep).option("compression", "gzip").text(path)
    return path


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> str:
    """ARC files of the pages, one per partition, of version 1 or 2 by turns. Null html is an empty document."""
    source = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.coalesce(F.col(html_col), F.lit("")).cast("binary"), F.spark_partition_id())

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offset = version = 0
        name = ""
        for batch in batches:
            out = []
            for page_id, url, html, part in zip(*(c.to_pylist() for c in batch.columns)):
                if not version:
                    version, name = 1 + part % 2, f"part-{part:05d}.arc.gz"
                    out.append(arc_intro(name, version))
                    offset += len(out[-1]) + 1
                out.append(arc_record(page_id, url, html, version, offset, name))
                offset += len(out[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    return _values(source, make, path, "\n")


class Feed:
    """Lines of the archives of one partition, in order."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.lines = (x for b in batches for x in b.column(0).to_pylist())

    def line(self) -> bytes | None:
        return next(self.lines, None)

    def block(self, length: int, sep: bytes) -> bytes:
        """`length` bytes, put together again from the lines they span."""
        parts, have = [], -len(sep)
        while have < length:
            if (x := self.line()) is None:
                raise ValueError(f"an archive ends {length - max(have, 0)} bytes before a declared length")
            parts.append(x)
            have += len(x) + len(sep)
        if have != length:
            raise ValueError(f"a record runs {have - length} bytes over its declared length")
        return sep.join(parts)


def split_http(doc: bytes) -> tuple[bytes, bytes]:
    head, gap, payload = doc.partition(b"\r\n\r\n")
    return (head + gap, payload) if gap and head.startswith(b"HTTP/") else (b"", doc)


def http_field(head: bytes, name: bytes) -> bytes | None:
    m = re.search(rb"(?mi)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return m[1].strip() if m else None


def arc_records(feed: Feed) -> Iterator[tuple]:
    """(URL, IP, date, mime, document) of each record; filedesc records set the version of what follows."""
    version = 1
    while (line := feed.line()) is not None:
        if not line:
            continue
        fields = line.decode("utf-8", "replace").split(" ")
        length = int(fields[-1])
        if fields[0].startswith("filedesc://"):
            version = int(feed.line().split(b" ")[0])
            names = feed.line().decode()
            if names != ARC_FIELDS.get(version):
                raise ValueError(f"unknown ARC fields {names!r} for version {version}")
            continue
        if len(fields) != len(ARC_FIELDS[version].split(" ")):
            raise ValueError(f"an ARC header of version {version} with {len(fields)} fields")
        yield (*fields[:4], feed.block(length, b"\n"))


def _read(spark: SparkSession, path: str, sep: str) -> DataFrame:
    return spark.read.option("lineSep", sep).text(path).select(F.col("value").cast("binary"))


def _batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 8 << 20, size=lambda r: sum(len(x) for x in r if isinstance(x, bytes))):
    held, have = [], 0
    for r in rows:
        held.append(r)
        have += size(r)
        if have > most or len(held) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, have = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _mapped(df: DataFrame, rows_of, schema: str) -> DataFrame:
    target = df.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        return _batched(rows_of(Feed(batches)), to_arrow_schema(target))

    return df.mapInArrow(run, target)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """One row per ARC document with the identifier, time and digest of its WARC record.

    The record id is a name-based UUID of URL, date and page id, so converting an archive again gives the same ids.
    A record whose declared length is not that of its bytes stops the job with a message.
    """

    def rows(feed: Feed) -> Iterator[tuple]:
        for url, ip, date, mime, doc in arc_records(feed):
            head, payload = split_http(doc)
            page = http_field(head, b"X-Page-Id")
            stamp = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
            name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {page}')}>"
            yield int(page) if page else None, url, ip, stamp, mime, head, payload, len(payload), payload_digest(payload), name

    return _mapped(_read(spark, path, "\n"), rows, RECORD_FIELDS)


def warc_record(kind: str, record_id: str, captured: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record up to the first of its two closing line ends; the sink adds the other."""
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {captured}", *(f"{k}: {v}" for k, v in fields)]
    lines.append(f"WARC-Block-Digest: sha1:{payload_digest(block)}")
    return ("\r\n".join(lines) + f"\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n"


def convert_to_warc(records: DataFrame, path: str, least_bytes: int = 0) -> str:
    """WARC files of `read_arc`'s records: a response, or a revisit of the response with the same payload.

    Of records with equal payloads of at least `least_bytes`, those with the smallest page_id are responses (rows that
    repeat that id too) and the others revisits without payload. Records without a page_id are responses only where no
    equal payload has one. Payload digests are compared, payloads never leave the task that read them.
    """
    twin = F.col("payload_bytes") >= least_bytes
    best = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id"))
    first = records.where(twin).groupBy("payload_digest").agg(best.alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    many = attach_left(records, first, ["payload_digest"], "_n")
    kind = F.coalesce(twin & F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first.page_id")), F.lit(False))
    rows = many.select(
        "record_id", "captured", "url", "ip", "head", F.when(~kind, F.col("payload")).alias("payload"), "payload_digest",
        kind.alias("again"), F.col("_first.page_id").alias("page"), F.col("_first.record_id").alias("other"), F.spark_partition_id().alias("part"),
    )

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for batch in batches:
            out = []
            for name, captured, url, ip, head, payload, digest, again, page, other, part in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun:
                    info = b"software: kongrid\r\nformat: WARC File Format 1.0\r\n"
                    out.append(warc_record("warcinfo", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'part {part}')}>", captured, [("Content-Type", "application/warc-fields")], info))
                    begun = True
                fields = [("WARC-Target-URI", url), ("WARC-IP-Address", ip), ("WARC-Payload-Digest", f"sha1:{digest}")]
                if again:
                    fields += [("WARC-Refers-To", other), ("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Page", str(page))]
                fields.append(("Content-Type", "application/http; msgtype=response"))
                out.append(warc_record("revisit" if again else "response", name, captured, fields, head if again else head + payload))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    return _values(rows, make, path, "\r\n")


def warc_records(feed: Feed) -> Iterator[tuple[dict[str, str], bytes]]:
    while (line := feed.line()) is not None:
        if line != b"WARC/1.0":
            raise ValueError(f"a WARC record begins with {line[:40]!r}")
        fields = {}
        while line := feed.line():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.lower()] = v.strip()
        block = feed.block(int(fields["content-length"]), b"\r\n")
        if feed.line() != b"":
            raise ValueError("a WARC record doesn't end with two line ends")
        yield fields, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response and revisit records: page_id, payload_bytes, payload_digest, record_type, refers_to, url, record_id.

    Length and digest of a response are those of the bytes read; a digest that the header contradicts stops the job. Of a
    revisit they are the declared ones of the full payload.
    """

    def rows(feed: Feed) -> Iterator[tuple]:
        for fields, block in warc_records(feed):
            kind = fields["warc-type"]
            if kind == "warcinfo":
                continue
            head, payload = split_http(block)
            page, digest = http_field(head, b"X-Page-Id"), fields["warc-payload-digest"].removeprefix("sha1:")
            if kind == "response":
                size = len(payload)
                if payload_digest(payload) != digest:
                    raise ValueError(f"the payload of {fields['warc-record-id']} is not that of its digest")
            else:
                size = int(http_field(head, b"Content-Length"))
            other = fields.get("x-refers-to-page")
            yield int(page) if page else None, size, digest, kind, int(other) if other not in (None, "None") else None, fields["warc-target-uri"], fields["warc-record-id"]

    return _mapped(_read(spark, path, "\r\n"), rows, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string")


def archive_round_trip(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages to ARC files, those converted to WARC files, those read back.

    Null url becomes "-"; null html is an empty payload; an empty table gives no rows. Other columns are ignored.
    """
    spark = pages.sparkSession
    arc = write_arc(pages, scratch(spark, "arc"), id_col, url_col, html_col)
    warc = convert_to_warc(read_arc(spark, arc), scratch(spark, "warc"), least_bytes)
    return read_warc(spark, warc)
