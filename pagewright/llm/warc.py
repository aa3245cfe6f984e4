"""WARC derivatives (op10): from response records, linked metadata and plain-text conversion records.

Every response gives two records that refer to it by ``WARC-Refers-To``. The
``conversion`` record's block is the plain text of the page; the ``metadata`` record's block tells, as
``application/warc-fields``, what the conversion was made of: the source's content type, its payload
digest, its HTTP headers and the identifier of the conversion. Record identifiers are derived from the
response's, so a rerun after a lost executor writes the same records. Each response is handled on
its own: nothing is shuffled.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "record_id string, refers_to string, type string, target_uri string, date string, content_type string, block_digest string, payload_digest string, content_length long, block binary"
SCHEMA = f"page_id long, {RECORD}"
UNSEEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
BREAK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|body|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>", re.I)
TAG = re.compile(r"<[/!?]?[A-Za-z][^>]*>|<[!?][^>]*>")
SPACES, LINES = re.compile(r"[^\S\n]{2,}|[^\S\n ]"), re.compile(r" ?\n[ \n]*")
ZEROS, NO_CHARACTER = re.compile(r"(&#[xX]?)0+(?=[0-9a-fA-F])"), re.compile(r"&#(?:[1-9][0-9]{7,}|[xX][1-9a-fA-F][0-9a-fA-F]{6,});?")


def plain_text(page: str) -> str:
    """What a reader sees: scripts, styles and comments go, block elements end lines, entities are resolved. Takes time in proportion to the page.

    A tag that the page's end cuts off is one. For this a ``>`` is put behind the page, led by a character that no page may hold; so
    each ``<`` finds the end of its tag, and no text is looked through twice.
    """
    closed = page.replace("\0", "\ufffd").replace("\n", " ") + "\0>"
    seen = TAG.sub("", BREAK.sub("\n", UNSEEN.sub("", closed))).removesuffix("\0>")
    seen = NO_CHARACTER.sub("\ufffd", ZEROS.sub(r"\1", seen)) if "&#" in seen else seen
    return LINES.sub("\n", SPACES.sub(" ", html.unescape(seen))).strip()


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, source + '#' + kind)}>"


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP response; without a blank line all is payload."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap:
        return "", [], block
    status, *lines = head.decode("utf-8", "replace").split("\r\n")
    return status, [(k.strip(), v.strip()) for k, _, v in (line.partition(":") for line in lines)], payload


def charset(headers: list[tuple[str, str]]) -> str:
    for name, value in headers:
        if name.lower() == "content-type" and (found := re.search(r"charset=\"?([\w.:-]+)", value, re.I)):
            try:
                "".encode(found[1])
                return found[1]
            except LookupError:
                pass
    return "utf-8"


def derive(record_id: str, uri: str | None, date: str | None, block: bytes) -> list[tuple]:
    """The conversion and the metadata record of one response, as tuples in the order of RECORD."""
    status, headers, payload = split_http(block)
    text = plain_text(payload.decode(charset(headers), "replace")).encode()
    conversion, metadata = derived_id(record_id, "conversion"), derived_id(record_id, "metadata")
    source = digest(payload)
    clean = lambda x: re.sub(r"[\r\n]+", " ", x)
    fields = [("conversion-record-id", conversion), ("source-payload-digest", source), ("source-payload-length", str(len(payload))), ("source-status", clean(status)),
              *((f"source-header-{k.lower()}", v) for k, v in headers), ("text-length", str(len(text)))]
    told = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    own = digest(text)
    return [(conversion, record_id, "conversion", uri, date, "text/plain; charset=utf-8", own, own, len(text), text),
            (metadata, record_id, "metadata", uri, date, "application/warc-fields", digest(told), source, len(told), told)]


def responses(pages: DataFrame, *, date: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of a table of pages. A page's identifier is derived from its id, URL and content, so rows that repeat a page have its record; null HTML is an empty payload.

    A null id or URL stays null; an empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    body = F.coalesce(F.col(html_col), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    name = F.sha1(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(url_col), F.lit("")), F.sha1(body)))
    record = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "^(.{8})(.{4}).(.{3}).(.{3})(.{12}).*$", "$1-$2-5$3-a$4-$5"), F.lit(">"))
    return pages.select(F.col(id_col).cast("long").alias("page_id"), record.alias("record_id"), F.col(url_col).alias("target_uri"), F.lit(date).alias("date"), F.encode(F.concat(head, body), "UTF-8").alias("block"))


def derivatives(records: DataFrame) -> DataFrame:
    """Two rows per response (page_id, record_id, target_uri, date, block): its conversion and its metadata record.

    Null HTML or an empty page gives a conversion with an empty block. A null URL or date stays null, and its header is left
    out when written. Rows that repeat a response give the same records again. An empty table gives an empty
    result; of a record without a block all is empty. Other columns are ignored, whatever their names. A page is held whole, however long, and read once; batches bound the rest.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        types = [kinds[x.split()[1]] for x in SCHEMA.split(", ")]
        for batch in batches:
            rows = [(page, *row) for page, name, uri, date, block in zip(*(c.to_pylist() for c in batch.columns), strict=True) for row in derive(name or "", uri, date, block or b"")]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    return records.select("page_id", "record_id", "target_uri", "date", "block").mapInArrow(run, SCHEMA)


def record_bytes(kind: str, record_id: str, uri: str | None, date: str | None, content_type: str, block: bytes, refers_to: str | None = None, payload_digest: str | None = None) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Refers-To", refers_to), ("WARC-Target-URI", uri), ("WARC-Date", date),
            ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", payload_digest), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v is not None).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a WARC file, gzipped (by record or whole) or not. One record is held at a time."""
    stream = io.BytesIO(data) if isinstance(data, bytes) else data
    zipped = stream.read(2) == b"\x1f\x8b"
    stream.seek(0)
    lines = gzip.GzipFile(fileobj=stream) if zipped else stream
    while True:
        while (first := lines.readline()) and not first.strip():  # records end in two line breaks
            pass
        if not first:
            return
        headers = {}
        while (line := lines.readline().strip()):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip()] = value.strip()
        yield headers, lines.read(int(headers.get("Content-Length", 0)))


def write_warc(records: DataFrame, path: str) -> None:
    """Each record as gzipped bytes in Parquet, in column ``warc``: the concatenation of any of them is a WARC file."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"record_id": batch["record_id"], "warc": [
                gzip.compress(record_bytes(r.type, r.record_id, r.target_uri, r.date, r.content_type, r.block, r.refers_to, r.payload_digest), mtime=0) for r in batch.itertuples()]})

    records.mapInPandas(run, "record_id string, warc binary").write.parquet(path)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The response records of the WARC files under ``path``, one held at a time; a file's bytes are one row, so files should be of usual size (about 1 GB)."""
    names = ["page_id", "record_id", "target_uri", "date", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for h, block in parse(pa.BufferReader(content.as_buffer())):
                    if h.get("WARC-Type") == "response":
                        rows.append((None, h.get("WARC-Record-ID"), h.get("WARC-Target-URI"), h.get("WARC-Date"), block))
                        held += len(block)
                    if held > 1 << 24:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), *[pa.string()] * 3, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "page_id long, record_id string, target_uri string, date string, block binary")
