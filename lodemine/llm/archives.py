"""Legacy archives: ARC files are parsed and converted into equivalent WARC files.

ARC files of version 1 and 2 begin with a version block that names the fields of the record lines that follow; a record is such a line,
whose last field declares the length of the content, then the content. The converter reads the fields by name and cuts by the declared length.
For each record it makes a WARC record: the id is a UUID derived from file name, offset and header line (so a retry makes the same), the date is the
14-digit date in ISO form, the type is ``response`` for HTTP content and ``resource`` otherwise, and SHA-1 digests of block and payload are
computed. HTTP records whose payload of at least ``least_bytes`` occurs several times become revisits, without the payload, of the one
with the largest key.

Every record is a gzip member of its own, so a record can be read by its offset alone. A task joins members into files of at most ``per_file``
records and ``per_bytes`` bytes of records (a larger record has a file to itself), so what a task holds of a file, in writing and reading, is bounded
by these and the largest record. A file is one row for Spark's text writer, which writes bytes as they are.

Defined results: a null html is an empty payload, a null url is ``urn:page:<id>``, blanks and control characters in urls are percent-encoded. A null id
is left out of the record and read back as null; among equal payloads it counts as the smallest. Repeated rows are records of their own; of those with
the largest id, the one with the largest record id is the response. Content shorter than declared is kept and marked WARC-Truncated. An
empty table gives archives without records. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemine.session import materialize

#: Field lines of the two ARC versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PAGE_ID = "X-Page-Id"
CHUNK = 4_000_000
#: Bytes of records in a file, before compression.
PER_BYTES = 32_000_000
#: Bytes decompressed at a time.
STEP = 65_536


def member(record: bytes, level: int = 3) -> bytes:
    """A record as gzip members that end with a zero byte: the last one's length is below 16 MB, if need be as it is empty."""
    made = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = made.compress(record) + made.flush()
    return out if out[-1] == 0 else out + member(b"")


def archive_files(records: Iterable[bytes], per_file: int, per_bytes: int, opening: Callable[[int], bytes] | None = None) -> Iterator[bytes]:
    """Contents of files; ``opening`` makes the record that the file of a number begins with, which is not counted."""
    out: list[bytes] = []
    n = size = number = 0
    for record in records:
        if n and (n == per_file or size + len(record) > per_bytes):
            yield b"".join(out)
            out, n, size, number = [], 0, 0, number + 1
        if not n and opening:
            out.append(member(opening(number)))
        out.append(member(record))
        n += 1
        size += len(record)
    if n:
        yield b"".join(out)


def file_batches(contents: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """A batch per file, without the last byte, which the writer adds as the end of its line."""
    for content in contents:
        yield pa.RecordBatch.from_pydict({"content": pa.array([content[:-1]], pa.binary())})


def write_files(contents: DataFrame, path: str) -> None:
    lines = contents.select(F.col("content").cast("string").alias("value"))
    lines.write.option("maxRecordsPerFile", 1).option("lineSep", "\0").option("compression", "none").text(path)


def arc_record(version: int, url: str, stamp: str, content: bytes) -> bytes:
    values = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": stamp, "Content-type": "text/html", "Result-code": "200", "Archive-length": str(len(content))}
    line = " ".join(values.get(f, "-") for f in ARC_FIELDS[version].split())
    return line.encode() + b"\n" + content


def arc_version_block(version: int, name: str, stamp: str) -> bytes:
    body = f"{version} 0 lodemine\n{ARC_FIELDS[version]}\n".encode()
    line = f"filedesc://{name}.arc 0.0.0.0 {stamp} text/plain"
    return f"{line}{' 200 - - 0 ' + name if version == 2 else ''} {len(body)}\n".encode() + body


def write_arc(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", stamp: str = "20200101000000", per_file: int = 500, per_bytes: int = PER_BYTES
) -> None:
    """Pages as ARC files, each with a version block; tasks with even numbers write version 1, the others version 2."""
    address = F.coalesce(F.col(url), F.concat(F.lit("urn:page:"), F.coalesce(F.col(page_id).cast("string"), F.lit(""))))
    rows = pages.select(F.col(page_id).cast("bigint").alias("id"), address.alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        version = 1 + task % 2

        def records() -> Iterator[bytes]:
            for batch in batches:
                for page, address, payload in zip(*[batch.column(c) for c in ("id", "url", "payload")], strict=True):
                    page, address, payload = page.as_py(), address.as_py(), payload.as_py()
                    safe = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in address) or "-"
                    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                    head += f"{PAGE_ID}: {page}\r\n" if page is not None else ""
                    yield arc_record(version, safe, stamp, f"{head}Content-Length: {len(payload)}\r\n\r\n".encode() + payload) + b"\n"

        yield from file_batches(archive_files(records(), per_file, per_bytes, lambda k: arc_version_block(version, f"pages-{task:06d}-{k:06d}", stamp) + b"\n"))

    write_files(rows.mapInArrow(write, "content binary"), path)


def plain(content: bytes) -> bytes:
    """The content of a file, whether or not it is gzip-compressed, in one or several members."""
    if content[:2] != b"\x1f\x8b":
        return content
    out, opened = [], zlib.decompressobj(31)
    for at in range(0, len(content), STEP):
        left = content[at : at + STEP]
        while left:
            out.append(opened.decompress(left))
            left = b""
            if opened.eof:
                left, opened = opened.unused_data, zlib.decompressobj(31)
                if left and left[:1] != b"\x1f":  # something else behind the last member
                    return b"".join(out)
    return b"".join([*out, opened.flush()])


def arc_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes, bool]]:
    """(offset, fields, content, complete) of each record after the version block."""
    at, fields = 0, None
    while True:
        while data[at : at + 1] in (b"\n", b"\r") and at < len(data):
            at += 1
        if at >= len(data):
            return
        end = data.find(b"\n", at)
        if end < 0:
            return
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        parts = line.split(" ")
        length = int(parts[-1]) if parts[-1].isdigit() else 0
        content = data[end + 1 : end + 1 + length]
        if fields is None:
            listed = content.decode("utf-8", "replace").split("\n")
            fields = (listed[1] if len(listed) > 1 else ARC_FIELDS[1]).strip().split(" ")
        else:
            yield at, {**dict(zip(fields, parts, strict=False)), "line": line}, content, len(content) == length
        at = end + 1 + length


def sha1_name(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def http_parts(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """Head (with its blank line), payload, and the headers in lower case."""
    end = block.find(b"\r\n\r\n")
    head = block[: end + 4] if end >= 0 else block
    headers = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            headers[name.strip().lower()] = value.strip()
    return head, block[len(head) :], headers


def parsed_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all ARC files below ``path``, as WARC fields."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "uri", "date", "ip", "kind", "content_type", "http_head", "payload", "payload_digest", "payload_bytes", "block_digest", "key", "complete"]
        kinds = [*[pa.string()] * 6, pa.binary(), pa.binary(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

        def sent(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows, size = [], 0
                for offset, fields, block, complete in arc_records(plain(content)):
                    source = f"{name.rsplit('/', 1)[-1]} {offset} {fields['line']}"
                    record = f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(source.encode()).digest()[:16], version=5)}>"
                    d = fields.get("Archive-date", "").ljust(14, "0")[:14]
                    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
                    http = block.startswith(b"HTTP/")
                    head, payload, headers = http_parts(block) if http else (b"", block, {})
                    page = headers.get(PAGE_ID.lower(), "")
                    rows.append(
                        (record, fields.get("URL"), date, fields.get("IP-address"), "response" if http else "resource",
                         "application/http; msgtype=response" if http else fields.get("Content-type"), head, payload,
                         sha1_name(payload), len(payload), sha1_name(block), int(page) if page.lstrip("-").isdigit() else None, complete)
                    )
                    size += len(block)
                    if size > CHUNK:
                        yield sent(rows)
                        rows, size = [], 0
                yield sent(rows)

    schema = (
        "record_id string, uri string, date string, ip string, kind string, content_type string, http_head binary, payload binary, "
        "payload_digest string, payload_bytes bigint, block_digest string, key bigint, complete boolean"
    )
    return files.mapInArrow(parse, schema)


def convert(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = 1000, per_file: int = 500, per_bytes: int = PER_BYTES) -> None:
    """Convert all ARC files below ``arc_path`` into WARC files in ``warc_path``."""
    records = parsed_records(spark, arc_path)
    # The one record of each repeated payload that stays whole, by digest; only digests met more than once.
    whole = (
        records.where((F.col("kind") == "response") & (F.col("payload_bytes") >= least_bytes))
        .groupBy("payload_digest")
        .agg(F.max(F.struct("key", "record_id", "uri", "date")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("payload_digest", "first")
    )
    joined = records.join(materialize(whole), "payload_digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("kind") == "response") & (F.col("payload_bytes") >= least_bytes) & (F.col("first.record_id") != F.col("record_id"))
    block = F.when(revisit, F.col("http_head")).otherwise(F.concat("http_head", "payload"))

    def header(name: str, value: Column | str) -> Column:
        value = F.col(value) if isinstance(value, str) else value
        return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))

    head = F.concat(
        F.lit("WARC/1.0\r\n"),
        header("WARC-Type", F.when(revisit, "revisit").otherwise(F.col("kind"))),
        header("WARC-Record-ID", "record_id"),
        header("WARC-Date", "date"),
        header("WARC-Target-URI", "uri"),
        header("WARC-IP-Address", "ip"),
        header("WARC-Payload-Digest", "payload_digest"),
        header("WARC-Block-Digest", F.when(~revisit, F.col("block_digest"))),
        header("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))),
        header("WARC-Refers-To", F.when(revisit, F.col("first.record_id"))),
        header("WARC-Refers-To-Target-URI", F.when(revisit, F.col("first.uri"))),
        header("WARC-Refers-To-Date", F.when(revisit, F.col("first.date"))),
        header("WARC-Truncated", F.when(~F.col("complete"), F.lit("length"))),
        header("Content-Type", "content_type"),
        header("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
    )
    made = joined.select(F.concat(head.cast("binary"), block, F.lit("\r\n\r\n").cast("binary")).alias("record"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = (record.as_py() for batch in batches for record in batch.column("record"))
        yield from file_batches(archive_files(records, per_file, per_bytes))

    write_files(made.mapInArrow(write, "content binary"), warc_path)


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record."""
    at = 0
    while True:
        start = data.find(b"WARC/", at)
        if start < 0:
            return
        end = data.index(b"\r\n\r\n", start)
        headers = {}
        for line in data[start:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        at = end + 4 + int(headers["content-length"])
        yield headers, data[end + 4 : at]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, kind, refers_to, uri, date, key, payload_bytes, payload_digest) of all WARC files below ``path``.

    Digests (bare hexadecimal SHA-1) and sizes are of the full payload: of a response computed from its block, of a revisit as its headers say.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "kind", "refers_to", "uri", "date", "key", "payload_bytes", "payload_digest"]
        kinds = [*[pa.string()] * 5, pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            for content in batch.column("content").to_pylist():
                rows = []
                for headers, block in warc_records(plain(content)):
                    http = headers.get("content-type", "").startswith("application/http")
                    _, payload, fields = http_parts(block) if http else (b"", block, {})
                    kind = headers.get("warc-type")
                    if kind == "revisit":
                        size = int(fields.get("content-length", 0))
                        digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                    else:
                        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    page = fields.get(PAGE_ID.lower(), "")
                    rows.append((headers.get("warc-record-id"), kind, headers.get("warc-refers-to"), headers.get("warc-target-uri"), headers.get("warc-date"),
                                 int(page) if page.lstrip("-").isdigit() else None, size, digest))
                columns = zip(*rows, strict=True) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return files.mapInArrow(parse, "record_id string, kind string, refers_to string, uri string, date string, key bigint, payload_bytes bigint, payload_digest string")
