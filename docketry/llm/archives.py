"""Web archives: a legacy ARC reader and writer, the conversion to WARC, and WARC files written and read by Spark.

ARC has two versions of record header. Version 1: URL, IP address, date, content type, length. Version 2 puts
result code, checksum, location, offset and file name before the length. A file begins with a version block that
names its version. The converter reads each header by its file's version, takes as many bytes as it declares, and
makes up what WARC wants besides: record ids, ISO timestamps, types and digests. Headers are read from both ends, as
addresses and content types may hold blanks; blank lines between records are passed over; a header that cannot be
read is reported, and reading goes on at the next line that is one.

WARC files are written by Spark's text writer, one value a file, so the files are committed as any other output of
Spark is and can be on any file system that it knows. A file is a gzip stream of standard records behind a warcinfo
record, of about FILE_BYTES before compression.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the two formats.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
WARC_VERSION = "WARC/1.0"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
CRLF = b"\r\n"

SHORTEST = 100  # payloads under so many bytes are never revisits
DATE = "20240101000000"
FILE_BYTES = 32 << 20  # of records in one WARC file

_HEADER = re.compile(r"(?P<url>\S.*?) (?P<ip>[0-9A-Fa-f.:\-]+) (?P<date>\d{4,17}) (?P<rest>\S.*)")


class ArchiveError(ValueError):
    """A header line or declared length that does not fit the bytes."""


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    content_type: str
    body: bytes
    extra: dict[str, str] = field(default_factory=dict)


def arc_url(url: str | None) -> str:
    """ARC header fields are parted by spaces, so an address may hold none."""
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "") or "urn:none"


def write_arc(records: list[ArcRecord], version: int, name: str = "segment.arc") -> bytes:
    """One ARC file: the version block, then each record behind its header line."""
    names = " ".join(ARC_FIELDS[version])
    about = f"{version} 0 docketry\n{names}\n".encode()
    out = [_arc_header(ArcRecord(f"filedesc://{name}", "0.0.0.0", DATE, "text/plain", about), version, name, 0), about, b"\n"]
    offset = sum(map(len, out))
    for r in records:
        part = [_arc_header(r, version, name, offset), r.body, b"\n"]
        offset += sum(map(len, part))
        out += part
    return b"".join(out)


def _arc_header(r: ArcRecord, version: int, name: str, offset: int) -> bytes:
    middle = [] if version == 1 else ["200", "-", "-", str(offset), name]
    return (" ".join([arc_url(r.url), r.ip, r.date, r.content_type, *middle, str(len(r.body))]) + "\n").encode()


def arc_header(line: bytes, fields: list[str]) -> dict[str, str] | None:
    """A header line by its fields' names, or None if it is none.

    The address, which may hold blanks, ends in front of the IP address and the date; from the right, every field but
    the content type is one word.
    """
    m = _HEADER.fullmatch(line.rstrip(b"\r").decode("utf-8", "surrogateescape"))
    after = fields[4:]
    parts = m["rest"].split(" ") if m else []
    if len(parts) < len(after) + 1 or not parts[-1].isdecimal():
        return None
    kind, last = " ".join(parts[: -len(after)]), parts[-len(after) :]
    return dict(zip(fields, [m["url"], m["ip"], m["date"], kind, *last], strict=True))


def read_arc(chunks: bytes | Iterator[bytes], strict: bool = True) -> Iterator[ArcRecord | ArchiveError]:
    """The records of one ARC file (its bytes, whole or in pieces), without its version block.

    strict: the first fault ends the reading. Otherwise faults are yielded as errors, and reading goes on with the next
    line that is a header. At most one record and one piece are held.
    """
    stream = Buffered(iter([chunks]) if isinstance(chunks, bytes) else chunks)
    fields: list[str] | None = None
    lost = False
    while stream.need(1):
        line = stream.line()
        if not line.strip():
            continue
        error = head = None
        if fields is None:
            first = line.decode("utf-8", "surrogateescape").split(" ")
            if not first[0].startswith("filedesc://") or not first[-1].strip().isdecimal():
                error = ArchiveError("the file has no version block")
            else:
                about = stream.take(int(first[-1]))
                fields = ARC_FIELDS.get(int(about[:1])) if about[:1].isdigit() else None
                error = None if fields else ArchiveError(f"unknown version {about[:1]!r}")
            if error is not None:
                if strict:
                    raise error
                yield error
                return
            continue
        head = arc_header(line, fields)
        if head is None:
            error = None if lost else ArchiveError(f"no header of {len(fields)} fields: {line[:80]!r}")
            lost = True
        else:
            lost = False
            size = int(head.pop("Archive-length"))
            body = stream.take(size)
            if len(body) < size:
                error = ArchiveError("the file ends inside a record")
            else:
                yield ArcRecord(head.pop("URL"), head.pop("IP-address"), head.pop("Archive-date"), head.pop("Content-type"), body, head)
        if error is not None:
            if strict:
                raise error
            yield error


class Buffered:
    """A stream of pieces that is read by lines and by lengths."""

    def __init__(self, chunks: Iterator[bytes]) -> None:
        self.chunks, self.held = chunks, b""

    def need(self, n: int) -> bool:
        parts, size = [self.held], len(self.held)
        while size < n and (chunk := next(self.chunks, None)) is not None:
            parts.append(chunk)
            size += len(chunk)
        self.held = b"".join(parts)
        return size >= n

    def take(self, n: int) -> bytes:
        self.need(n)
        out, self.held = self.held[:n], self.held[n:]
        return out

    def line(self) -> bytes:
        """The bytes up to the next line feed, which is passed over."""
        while (end := self.held.find(b"\n")) < 0:
            if not self.need(len(self.held) + 1):
                return self.take(len(self.held))
        return self.take(end + 1)[:-1]


def iso_date(arc_date: str) -> str:
    d = arc_date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head, with its blank line, and payload of an HTTP message; a block without a head is all payload."""
    end = block.find(CRLF + CRLF) if block.startswith(b"HTTP/") else -1
    return (block[: end + 4], block[end + 4 :]) if end >= 0 else (b"", block)


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(key.encode('utf-8', 'surrogateescape')).digest())}>"


def warc_record(r: ArcRecord, key: str, refers_key: str | None = None) -> bytes:
    """The WARC record for an ARC record, up to the first of its two closing CRLFs.

    refers_key: the key of an earlier record with the same payload; the record is then a revisit, without payload.
    """
    head, payload = split_http(r.body)
    digest = hashlib.sha256(payload).hexdigest()
    block = head if refers_key is not None else r.body
    fields = [
        ("WARC-Type", "response" if refers_key is None else "revisit"),
        ("WARC-Record-ID", record_id(key)),
        ("WARC-Date", iso_date(r.date)),
        ("WARC-Target-URI", r.url),
        ("WARC-IP-Address", r.ip),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("X-Payload-Length", str(len(payload))),
        ("X-Source-Key", key),
        ("Content-Type", "application/http; msgtype=response" if head else r.content_type),
    ]
    if refers_key is not None:
        fields += [("WARC-Refers-To", record_id(refers_key)), ("X-Refers-To-Key", refers_key), ("WARC-Profile", REVISIT_PROFILE)]
    fields.append(("Content-Length", str(len(block))))
    lines = [WARC_VERSION, *(f"{k}: {v}" for k, v in fields), "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + block + CRLF


def warcinfo(key: str) -> bytes:
    """The record that begins a file, up to the first of its two closing CRLFs."""
    about = b"software: docketry\r\nformat: WARC File Format 1.0\r\n"
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(key)), ("WARC-Date", iso_date(DATE)), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(about)))]
    return "\r\n".join([WARC_VERSION, *(f"{k}: {v}" for k, v in fields), "", ""]).encode() + about + CRLF


def read_warc_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and block of each record of a WARC stream; at most one record and one piece are held."""
    stream = Buffered(chunks)
    while stream.need(1):
        while (end := stream.held.find(CRLF + CRLF)) < 0:
            if not stream.need(len(stream.held) + 1):
                raise ArchiveError("the file ends inside a header")
        version, *lines = stream.take(end + 4)[:end].decode("utf-8", "surrogateescape").split("\r\n")
        if not version.startswith("WARC/"):
            raise ArchiveError(f"no record begins with {version[:20]!r}")
        fields = {k: v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = int(fields["Content-Length"])
        block = stream.take(size + 4)
        if len(block) < size + 4 or block[size:] != CRLF + CRLF:
            raise ArchiveError("a record is not as long as it says")
        yield fields, block[:size]


def gunzip(data: bytes, step: int = 1 << 18) -> Iterator[bytes]:
    """A gzip file of any number of members, in pieces."""
    at, machine = 0, zlib.decompressobj(31)
    while at < len(data):
        piece = machine.decompress(data[at : at + step])
        at = min(at + step, len(data))
        if machine.eof:
            at -= len(machine.unused_data)
            machine = zlib.decompressobj(31)
        if piece:
            yield piece


def revisits(pages: DataFrame, id_col: str, shortest: int = SHORTEST) -> DataFrame:
    """(id, digest, refers_to) of the records that repeat the payload of a record with a smaller id.

    Narrow rows only. A payload that a third of all pages share is one row of the partial aggregation, and in the
    join back one key whose partition adaptive execution splits.
    """
    long_ones = pages.where(F.col("n") >= shortest)
    first = long_ones.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    return long_ones.select("id", "digest").join(first, "digest").where("id is null or id > refers_to").where("refers_to is not null").distinct()


def convert_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shortest: int = SHORTEST) -> DataFrame:
    """WARC records (column `record`, binary) for a table of pages, by way of ARC files of both versions.

    A null html is an empty payload, a null url becomes urn:none. Among records with equal payloads of at least
    `shortest` bytes those with the smallest id are responses (all of them, should rows repeat an id), the others
    revisit; a null id sorts last, and where all ids are null all are responses.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload"))
    again = revisits(rows.select("id", "digest", "n"), "id", shortest).select(F.col("id").alias("a_id"), F.col("digest").alias("a_digest"), "refers_to")
    joined = rows.join(again, (F.col("digest") == F.col("a_digest")) & F.col("id").eqNullSafe(F.col("a_id")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                columns = [c.to_pylist() for c in whole.slice(at, 512).columns]
                out: list[bytes] = []
                for version in ARC_FIELDS:
                    mine = [(i, u, p, r) for i, u, p, r in zip(*columns, strict=True) if (i or 0) % 2 + 1 == version]
                    heads = [f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(p)}\r\n\r\n".encode() for _, _, p, _ in mine]
                    segment = write_arc([ArcRecord(u, "127.0.0.1", DATE, "text/html", h + p) for h, (_, u, p, _) in zip(heads, mine, strict=True)], version)
                    for (i, _, _, refers), r in zip(mine, read_arc(segment), strict=True):
                        out.append(warc_record(r, f"page:{'' if i is None else i}", None if refers is None else f"page:{refers}"))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return joined.select("id", "url", "payload", "refers_to").mapInArrow(run, "record binary")


def read_arc_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, or fault, of the ARC files in a folder, gzip or not: file, place, url, ip, arc_date,
    content_type, body (binary), error. place counts a file's records and faults; a fault has nulls but for its text.

    A file is read by one task, piece by piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_buffer()
                chunks = gunzip(data) if bytes(data[:2]) == b"\x1f\x8b" else (bytes(data[i : i + (1 << 20)]) for i in range(0, len(data), 1 << 20))
                for place, r in enumerate(read_arc(chunks, strict=False)):
                    row = [None] * 5 + [str(r)] if isinstance(r, ArchiveError) else [r.url, r.ip, r.date, r.content_type, r.body, None]
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([name, place, *row], kinds, strict=True)], names)

    names = ["file", "place", "url", "ip", "arc_date", "content_type", "body", "error"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, place long, url string, ip string, arc_date string, content_type string, body binary, error string")


def convert_arc(records: DataFrame) -> DataFrame:
    """WARC records (column `record`, binary) for the rows of read_arc_files without a fault; all are responses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, place, url, ip, date, kind, body = (c[i].as_py() for c in batch.columns)
                yield pa.RecordBatch.from_arrays([pa.array([warc_record(ArcRecord(url, ip, date, kind, body), f"arc:{name}:{place}")], pa.binary())], ["record"])

    good = records.where("error is null").select("file", "place", "url", "ip", "arc_date", "content_type", "body")
    return good.mapInArrow(run, "record binary")


def write_warc(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Gzipped WARC files of about file_bytes each before compression, or of one record that is longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size, made = TaskContext.get().partitionId(), [], 0, 0
        for batch in batches:
            for record in batch.column(0):
                if held and size + len(record.as_buffer()) > file_bytes:
                    yield whole(part, made, held)
                    held, size, made = [], 0, made + 1
                held.append(record.as_py())
                size += len(held[-1])
        if held:
            yield whole(part, made, held)

    def whole(part: int, made: int, held: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([CRLF.join([warcinfo(f"file:{part}:{made}"), *held])], pa.binary())], ["file"])

    # The cast keeps all bytes as they are, and the writer closes the last record with its line end.
    files = records.select("record").mapInArrow(run, "file binary").select(F.col("file").cast("string"))
    files.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record but for warcinfo: key, type, refers_key, declared digest and length, and those of the payload it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                for f, block in read_warc_records(gunzip(content.as_buffer())):
                    if f["WARC-Type"] == "warcinfo":
                        continue
                    payload = split_http(block)[1]
                    kind = f["WARC-Type"]
                    digest, size = f["WARC-Payload-Digest"].removeprefix("sha256:"), int(f["X-Payload-Length"])
                    if kind == "response" and (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, size):
                        raise ArchiveError(f"{f['WARC-Record-ID']}: the payload differs from its digest")
                    rows.append((f["X-Source-Key"], kind, f.get("X-Refers-To-Key"), digest, size, f["WARC-Target-URI"], f["WARC-Date"]))
                    if len(rows) == 10_000:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    names = ["key", "record_type", "refers_key", "payload_digest", "payload_bytes", "uri", "warc_date"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, "key string, record_type string, refers_key string, payload_digest string, payload_bytes long, uri string, warc_date string")


def archive_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the pages as WARC files to `path` (a new folder) and read them back: one row per page.

    Returns the id column, payload_bytes, payload_digest, record_type, refers_to. Other columns are ignored; an
    empty table gives no rows.
    """
    write_warc(convert_pages(pages, id_col, url_col, html_col), path)
    page = lambda c: F.substring(F.col(c), 6, 40).try_cast("long")
    return read_warc(pages.sparkSession, path).select(page("key").alias(id_col), "payload_bytes", "payload_digest", "record_type", page("refers_key").alias("refers_to"))
