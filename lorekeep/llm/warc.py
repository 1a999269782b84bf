"""WARC: a legacy archive converter.

ARC files, versions 1 and 2, open with a version block that names the fields of the record lines; a record is a
line of these fields and as many bytes as its last field declares. The converter reads them and synthesises
equivalent WARC records: identifiers from the place of the record in its archive, timestamps from the 14 digits,
types from the content, and SHA-1 digests of block and payload. Records whose payload another record holds can be
written as revisits of it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import materialise, shared_dir, write_file

#: Field names of the record line, by version (fixed by the format).
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes after which an archive is closed.
ARCHIVE_BYTES = 16 << 20
LEVEL = 3
#: Rows of repeated payloads that may be broadcast (about 100 bytes each); more are joined.
BROADCAST_ROWS = 200_000


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    content_type: str
    body: bytes
    offset: str = "-"
    filename: str = "-"
    status: str = "-"


def arc_header(version: int, name: str, date: str) -> bytes:
    block = f"{version} 0 lorekeep\n{' '.join(FIELDS[version])}\n".encode()
    rest = f"{'- - - 0 - ' if version == 2 else ''}"
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {rest}{len(block)}\n".encode() + block + b"\n"


def arc_record(version: int, r: ArcRecord) -> bytes:
    more = f" {r.status} - - {r.offset} {r.filename}" if version == 2 else ""
    return f"{r.url} {r.ip} {r.date} {r.content_type}{more} {len(r.body)}\n".encode() + r.body + b"\n"


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file after its version block, by declared lengths. Raises ValueError where the form is broken."""
    at, fields, name = 0, None, "-"
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("record line without end")
        line = data[at:end].decode("utf-8", errors="replace").rstrip("\r")
        if not line:
            at = end + 1
            continue
        start = at
        if fields is None:
            if not line.startswith("filedesc://"):
                raise ValueError("no version block")
            name, size = line[11:].split(" ")[0], int(line.rsplit(" ", 1)[1])
            block = data[end + 1 : end + 1 + size].decode("utf-8", errors="replace").split("\n")
            version = int(block[0].split(" ")[0])
            fields = block[1].split() if len(block) > 1 and block[1].strip() else FIELDS[version]
            at = end + 1 + size
            continue
        values = line.split(" ")
        extra = len(values) - len(fields)
        if extra < 0:
            raise ValueError(f"record line with {len(values)} fields")
        if extra:  # an unescaped space in the first field, or in the content type's parameters
            kind = fields.index("Content-type")
            dates = [i for i in range(2, 3 + extra) if re.fullmatch(r"\d{8,14}", values[i])]
            inner = (dates[0] if dates else 2) - 2
            values = [" ".join(values[: inner + 1]), *values[inner + 1 :]]
            extra -= inner
            values[kind : kind + 1 + extra] = [" ".join(values[kind : kind + 1 + extra])]
        row = dict(zip(fields, values))
        size = int(row["Archive-length"])
        body = data[end + 1 : end + 1 + size]
        if len(body) != size:
            raise ValueError("record shorter than declared")
        yield ArcRecord(row["URL"], row["IP-address"], row["Archive-date"], row["Content-type"], body, row.get("Offset") if row.get("Offset", "-") != "-" else str(start), row.get("Filename") if row.get("Filename", "-") != "-" else name, row.get("Result-code", "-"))
        at = end + 1 + size


def record_id(filename: str, offset: str) -> str:
    """Identifier of the record at a place of an archive: the archive's digest and the place, so the place can be read off."""
    high = int.from_bytes(hashlib.md5(filename.encode()).digest()[:8], "big")
    if re.fullmatch(r"-?\d+", offset):
        low = int(offset) & 0xFFFFFFFFFFFFFFFF
    else:
        high, low = ~high & 0xFFFFFFFFFFFFFFFF, 0
    x = f"{high:016x}{low:016x}"
    return f"<urn:uuid:{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:]}>"


def place_of(identifier: str, filename: str) -> int | None:
    x = identifier[10:-1].replace("-", "")
    if bytes.fromhex(x[:16]) != hashlib.md5(filename.encode()).digest()[:8]:
        return None
    low = int(x[16:], 16)
    return low - (1 << 64) if low >> 63 else low


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_date(digits: str) -> str:
    d = (digits if digits.isdigit() else "").ljust(14, "0")[:14]
    month, day = max(d[4:6], "01"), max(d[6:8], "01")
    return f"{d[:4]}-{month}-{day}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def convert_record(r: ArcRecord, refers_to: str | None = None) -> bytes:
    """The WARC record of an ARC record: response where it begins with an HTTP status line, else resource; revisit where refers_to names the record that holds its payload."""
    http = r.body[:5] == b"HTTP/"
    cut = r.body.find(b"\r\n\r\n") + 4 if http else 0
    cut = cut if cut >= 4 or not http else len(r.body)
    head, payload = r.body[:cut], r.body[cut:]
    headers = [
        ("WARC-Type", "revisit" if refers_to else "response" if http else "resource"),
        ("WARC-Record-ID", record_id(r.filename, r.offset)),
        ("WARC-Date", warc_date(r.date)),
        ("WARC-Target-URI", r.url),
        ("WARC-IP-Address", r.ip),
        ("WARC-Payload-Digest", "sha1:" + sha1(payload)),
    ]
    block = r.body
    if refers_to:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", refers_to), ("WARC-Truncated", "length")]
        block = head
    return warc_record([*headers, ("WARC-Block-Digest", "sha1:" + sha1(block)), ("Content-Type", "application/http; msgtype=response" if http else r.content_type)], block)


def convert_arc(data: bytes, refers_to: dict[str, str] | None = None) -> Iterator[bytes]:
    """WARC records of an ARC file; refers_to: by identifier of a record, that of the one it revisits."""
    for r in read_arc(data):
        yield convert_record(r, (refers_to or {}).get(record_id(r.filename, r.offset)))


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record, from gzip members or plain bytes. Broken forms raise ValueError."""
    if data[:2] == b"\x1f\x8b":
        plain, rest = [], data
        while rest:
            d = zlib.decompressobj(31)
            plain.append(d.decompress(rest) + d.flush())
            if not d.eof:
                raise ValueError("archive cut short")
            rest = d.unused_data
            if len(plain) >= 64:
                yield from _records(b"".join(plain))
                plain = []
        data = b"".join(plain)
    yield from _records(data)


def _records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n") if end >= 0 else [""]
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError("record shorter than declared")
        yield headers, block
        at = end + 8 + size


class _Archives:
    """Writes records to numbered archives of a task and tells what it wrote."""

    def __init__(self, out_dir: str):
        self.out_dir, self.part, self.number = out_dir, TaskContext.get().partitionId(), 0
        self.members: list[bytes] = []
        self.bytes = 0

    def add(self, records: Iterator[bytes]) -> Iterator[pd.DataFrame]:
        for r in records:
            self.members.append(gzip.compress(r, LEVEL, mtime=0))
            self.bytes += len(self.members[-1])
            if self.bytes >= ARCHIVE_BYTES:
                yield self.close()

    def close(self) -> pd.DataFrame:
        name = f"{self.part:06d}-{self.number:06d}.warc.gz"
        info = warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name, "0")), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"software: lorekeep\r\nformat: WARC File Format 1.1\r\n")
        write_file(self.out_dir, name, gzip.compress(info, LEVEL, mtime=0) + b"".join(self.members))
        row = pd.DataFrame({"archive": [name], "records": [len(self.members)], "bytes": [self.bytes]})
        self.number, self.members, self.bytes = self.number + 1, [], 0
        return row


MANIFEST = "archive string, records long, bytes long"


def convert_arc_files(spark: SparkSession, arc_dir: str, out_dir: str) -> DataFrame:
    """Convert every ARC file (``*.arc``, ``*.arc.gz``) below arc_dir; returns the manifest of the archives written.

    A task reads one file at a time; files are as large as the crawler closed them. Empty files give no record.
    """

    def run(batches):
        archives = _Archives(out_dir)
        for pdf in batches:
            for data in pdf["content"]:
                yield from archives.add(convert_arc(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data))
        if archives.members:
            yield archives.close()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{arc,arc.gz}").load(arc_dir).select("content")
    return materialise(files.mapInPandas(run, MANIFEST), "warc-manifest")


def archive_pages(pages: DataFrame, out_dir: str, least_bytes: int = 0, source: str = "pages", date: str = "20240101000000", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write each page as a legacy record, convert it, and write the WARC archives; returns their manifest.

    Of pages with equal payloads of at least least_bytes, that of the largest id is the response and the others
    revisit it; rows that repeat that id are responses too. A null html is an empty payload; null ids are written
    and revisit like others, but nothing refers to them; null urls become urn:page:<id>.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    digests = rows.where(F.octet_length("payload") >= least_bytes).select("id", F.sha1("payload").alias("digest"))
    shared = materialise(digests.groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("c")).where("c > 1 and first is not null").drop("c"), "shared-payloads")
    small = shared.count() <= BROADCAST_ROWS
    marked = rows.withColumn("digest", F.sha1("payload")).join(F.broadcast(shared) if small else shared, "digest", "left").drop("digest")

    def run(batches):
        archives = _Archives(out_dir)
        for pdf in batches:
            for at in range(0, len(pdf), 200):
                part, refers = [arc_header(2, source, date)], {}
                for key, url, body, first in zip(*[pdf[c].iloc[at : at + 200].astype(object) for c in ("id", "url", "payload", "first")]):
                    offset = "null" if key is None or key != key else str(int(key))
                    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or f"urn:page:{offset}")
                    if first is not None and first == first and str(int(first)) != offset:
                        refers[record_id(source, offset)] = record_id(source, str(int(first)))
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                    if offset == "null":
                        r = ArcRecord(target, "0.0.0.0", date, "text/html", head + body, offset, source, "200")
                        yield from archives.add(iter([convert_record(r, record_id(source, str(int(first))) if first is not None and first == first else None)]))
                    else:
                        part.append(arc_record(2, ArcRecord(target, "0.0.0.0", date, "text/html", head + body, offset, source, "200")))
                yield from archives.add(convert_arc(b"".join(part), refers))
        if archives.members:
            yield archives.close()

    return materialise(marked.mapInPandas(run, MANIFEST), "warc-manifest")


def read_archives(spark: SparkSession, out_dir: str, source: str = "pages") -> DataFrame:
    """One row per record of the archives below out_dir but their own headers.

    ``record_place`` (in its source), ``url``, ``date``, ``payload_bytes``, ``payload_digest``, ``record_type``,
    ``refers_to`` (place of the record that holds the payload). Digests of responses are computed again and
    compared; a mismatch raises ValueError.
    """

    def run(batches):
        for pdf in batches:
            for data in pdf["content"]:
                out = []
                for headers, block in read_warc(data):
                    kind = headers["warc-type"]
                    if kind == "warcinfo":
                        continue
                    http = headers["content-type"].startswith("application/http")
                    cut = block.find(b"\r\n\r\n") + 4 if http else 0
                    digest, size = headers["warc-payload-digest"].removeprefix("sha1:"), len(block) - cut
                    if kind == "revisit":
                        found = re.search(rb"(?im)^content-length:\s*(\d+)", block)
                        size = int(found[1]) if found else None
                    elif sha1(block[cut:]) != digest:
                        raise ValueError(f"payload of {headers['warc-record-id']} doesn't have its digest")
                    refers = headers.get("warc-refers-to")
                    out.append((place_of(headers["warc-record-id"], source), headers["warc-target-uri"], headers["warc-date"], size, digest, kind, place_of(refers, source) if refers else None))
                got = pd.DataFrame(out, columns=["record_place", "url", "date", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                yield got.astype({c: "Int64" for c in ("record_place", "payload_bytes", "refers_to")})

    schema = "record_place long, url string, date string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(out_dir).select("content")
    return files.mapInPandas(run, schema)


def archive_digest(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages as archives in the shared folder and return what reading them back gives."""
    spark = pages.sparkSession
    out_dir = shared_dir(spark, "archives")
    manifest = archive_pages(pages, out_dir, least_bytes)
    if manifest.isEmpty():
        return spark.createDataFrame([], "record_place long, url string, date string, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read_archives(spark, out_dir)
