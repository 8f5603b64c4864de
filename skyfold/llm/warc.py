"""WARC records, and the builder of derivatives: linked metadata and plain-text conversion records for each response.

A conversion record holds the page's visible text; a metadata record holds its links, title and lengths as WARC fields. Both refer to the response by its record id
(WARC-Refers-To) with its URI and date, and carry the response's own digests and chosen source headers on, so that each derivative can be checked against the original.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html_text import plain

VERSION = b"WARC/1.1"
CRLF = b"\r\n"
#: Response headers that derivatives carry on.
CARRIED = ("content-type", "last-modified", "etag", "content-language")
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


@dataclass
class Record:
    """One WARC record: named fields in order, and the block."""

    headers: list[tuple[str, str]] = field(default_factory=list)
    block: bytes = b""

    def get(self, name: str) -> str | None:
        return next((v for k, v in self.headers if k.lower() == name.lower()), None)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """An id that the same record gets each time."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(31).join(parts))}>"


def to_bytes(record: Record) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in record.headers if k.lower() != "content-length"), f"Content-Length: {len(record.block)}".encode()]
    return CRLF.join(lines) + CRLF * 2 + record.block + CRLF * 2


def parse(data: bytes) -> Iterator[Record]:
    """Records of a WARC file, plain or in gzip members. A damaged tail ends the file."""
    if data[:2] == b"\x1f\x8b":
        out = []
        while data[:2] == b"\x1f\x8b":
            z = zlib.decompressobj(31)
            try:
                out.append(z.decompress(data) + z.flush())
            except zlib.error:
                break
            data = z.unused_data
        data = b"".join(out)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(CRLF * 2, at)
        if end < 0:
            return
        headers: list[tuple[str, str]] = []
        for line in data[at:end].split(CRLF)[1:]:
            text = line.decode("utf-8", "replace")
            if text[:1] in " \t" and headers:
                headers[-1] = (headers[-1][0], headers[-1][1] + " " + text.strip())
            elif ":" in text:
                k, v = text.split(":", 1)
                headers.append((k.strip(), v.strip()))
        size = next((v for k, v in headers if k.lower() == "content-length"), "")
        if not size.isdigit() or end + 4 + int(size) > len(data):
            return
        yield Record(headers, data[end + 4 : end + 4 + int(size)])
        at = end + 4 + int(size)


def response(uri: str, body: bytes, date: str, key: str, content_type: str = "text/html; charset=utf-8") -> Record:
    """A response record of an HTTP message with the given body."""
    message = CRLF.join([b"HTTP/1.1 200 OK", f"Content-Type: {content_type}".encode(), f"Content-Length: {len(body)}".encode()]) + CRLF * 2 + body
    return Record([("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", key, uri, digest(body))), ("WARC-Date", date), ("WARC-Target-URI", uri), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(message))], message)


def http_parts(block: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and body of an HTTP message."""
    head, gap, body = block.partition(CRLF * 2)
    if not gap or not head.startswith(b"HTTP/"):
        return {}, block
    lines = [x.decode("latin-1").split(":", 1) for x in head.split(CRLF)[1:] if b":" in x]
    headers = {k.strip().lower(): v.strip() for k, v in lines}
    if headers.get("content-encoding", "").lower() == "gzip":
        try:
            body = gzip.decompress(body)
        except (OSError, EOFError, zlib.error):
            return headers, b""
    return headers, body


def decoded(body: bytes, headers: dict[str, str]) -> str:
    m = re.search(r"charset=[\"']?([\w-]+)", headers.get("content-type", "")) or re.search(r"charset=[\"']?([\w-]+)", body[:1024].decode("latin-1"))
    try:
        return body.decode(m[1] if m else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def absolute(links: list[str], base: str) -> list[str]:
    """Links as absolute addresses, in page order, each once; scripts and mail addresses are left out."""
    out: dict[str, None] = {}
    for x in dict.fromkeys(x.strip() for x in links):
        if x.lower().startswith(("javascript:", "mailto:")):
            continue
        try:
            out[urljoin(base, x)] = None
        except ValueError:
            continue
    return list(out)


def derivatives(source: Record) -> list[Record]:
    """The conversion and the metadata record of a response; none for other records."""
    if (source.get("WARC-Type") or "").lower() != "response":
        return []
    headers, body = http_parts(source.block)
    html, uri, date, own = decoded(body, headers), source.get("WARC-Target-URI") or "", source.get("WARC-Date") or "", source.get("WARC-Record-ID") or ""
    payload, block = source.get("WARC-Payload-Digest") or digest(body), source.get("WARC-Block-Digest") or digest(source.block)
    page = plain(html)
    text = page.text.encode("utf-8", "replace")
    refers = [("WARC-Refers-To", own), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Source-Payload-Digest", payload), ("WARC-Source-Block-Digest", block)]
    carried = [(f"WARC-Source-{k.title()}", headers[k]) for k in CARRIED if k in headers]
    ids = {kind: record_id(kind, own) for kind in ("conversion", "metadata")}
    links = absolute(page.links, uri)
    facts = [("title", page.title), ("language", page.language), ("html-bytes", str(len(body))), ("text-bytes", str(len(text))), ("conversion", ids["conversion"]), *(("outlink", x) for x in links)]
    fields = b"".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}".encode() + CRLF for k, v in facts)
    out = []
    for kind, content_type, data in (("conversion", "text/plain; charset=utf-8", text), ("metadata", "application/warc-fields", fields)):
        concurrent = [] if kind == "conversion" else [("WARC-Concurrent-To", ids["conversion"])]
        out.append(Record([("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Date", date), ("WARC-Target-URI", uri), *refers, *concurrent, *carried, ("Content-Type", content_type), ("WARC-Block-Digest", digest(data)), ("WARC-Payload-Digest", digest(data)), ("Content-Length", str(len(data)))], data))
    return out


FIELDS = "warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, source_digest string, block_digest string, headers map<string,string>, block binary"
_TYPES = pa.struct([*((n, pa.string()) for n in ("warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "source_digest", "block_digest")), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])


def row_of(r: Record) -> dict:
    return {"warc_type": r.get("WARC-Type"), "record_id": r.get("WARC-Record-ID"), "refers_to": r.get("WARC-Refers-To"), "target_uri": r.get("WARC-Target-URI"), "warc_date": r.get("WARC-Date"), "content_type": r.get("Content-Type"), "source_digest": r.get("WARC-Source-Payload-Digest"), "block_digest": r.get("WARC-Block-Digest"), "headers": list(dict(r.headers).items()), "block": r.block}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_struct_array(pa.array(rows, _TYPES))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under ``path`` (.warc or .warc.gz), read by Spark; one task a file."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                part, size = [], 0
                for r in parse(content.as_py() or b""):
                    part.append(row_of(r))
                    size += len(r.block)
                    if size > 4 << 20:
                        yield _batch(part)
                        part, size = [], 0
                if part:
                    yield _batch(part)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(of, FIELDS)


def derive(records: DataFrame) -> DataFrame:
    """Conversion and metadata records of the responses among ``records`` (columns as ``read`` gives them)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                rows = [row_of(d) for r in batch.slice(a, 256).to_pylist() for d in derivatives(Record([*dict(r["headers"] or {}).items()], r["block"] or b""))]
                if rows:
                    yield _batch(rows)

    return records.select("headers", "block").mapInArrow(of, FIELDS)


def page_derivatives(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """page_id, the fields and the block of the conversion and metadata records of each row of ``pages`` (page_id, url, html; others are ignored).

    Pages are wrapped as response records first, dated ``date``. A null page is an empty body, a null url an empty URI; both still give two records. Repeated rows give repeated records with the
    same ids; an empty table an empty result.
    """
    kind = dict(pages.dtypes)["page_id"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                ids, rows = [], []
                for i, (page, url, html) in enumerate(zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html")))):
                    made = derivatives(response(re.sub(r"[\r\n]+", "", url or ""), (html or "").encode(), date, str(page)))
                    rows += [row_of(r) for r in made]
                    ids += [i] * len(made)
                out = _batch(rows)
                yield pa.RecordBatch.from_arrays([part.column("page_id").take(pa.array(ids, pa.int32())), *out.columns], ["page_id", *out.schema.names])

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(of, f"page_id {kind}, {FIELDS}")


def write(records: DataFrame, path: str, per_file: int = 50_000) -> None:
    """WARC files of gzip members: one binary row a file part, written through Spark so that any file system works."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = [base64.b64encode(gzip.compress(to_bytes(Record([*dict(r["headers"] or {}).items()], r["block"] or b"")), mtime=0)).decode() for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.string())], ["value"])

    records.select("headers", "block").mapInArrow(of, "value string").write.mode("errorifexists").option("maxRecordsPerFile", per_file).text(path)


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """Records that ``write`` wrote."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row_of(r) for v in batch.column("value") for r in parse(base64.b64decode(v.as_py()))]
            if rows:
                yield _batch(rows)

    return spark.read.text(path).mapInArrow(of, FIELDS)
