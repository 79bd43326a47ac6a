"""Legacy ARC archives to WARC, and WARC files written and read by Spark.

An ARC file opens with a version block, whose second line gives the version
and whose third line names the fields of every later header line (five in
version 1, ten in version 2).  Each record is such a line and as many bytes as
its last field declares.  The converter reads exactly those lengths and makes
the equivalent WARC records: an id derived from what the record says, the
14-digit time as ISO 8601, the type (response for HTTP messages, resource for
others) and SHA-256 digests.

Equal payloads of at least ``REVISIT_BYTES`` bytes are stored once: the record
with the smallest key is the response, the others become revisit records that
keep only their HTTP head.  Smaller ones are all responses.  If rows share both
key and payload, all of them that have the smallest key are responses; rows
with a null key are revisits unless the whole group's keys are null.

WARC files are written by Spark's text sink (records end in two CRLF, which is
its line separator), so any store that Spark can write works.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVISIT_BYTES = 100
#: Bytes of records after which a new archive begins.
ARCHIVE_BYTES = 1 << 20
#: FIXED VALUES of the format: header fields by version.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
RECORD = "key long, url string, date string, ip string, http_head binary, payload binary, payload_bytes long, payload_digest string, record_type string"


def arc_header(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 barline\n{FIELDS[version]}\n"
    fill = f"filedesc://{name} 0.0.0.0 {date} text/plain"
    if version == 2:
        fill += f" 200 - - 0 {name}"
    return f"{fill} {len(body)}\n{body}".encode()


def arc_record(url: str, block: bytes, version: int, date: str, offset: int, name: str, mime: str = "text/html") -> bytes:
    url = quote(url, safe="!#$&'()*+,/:;=?@[]~%") or "-"
    line = f"{url} 127.0.0.1 {date} {mime}"
    if version == 2:
        line += f" 200 {hashlib.md5(block).hexdigest()} - {offset} {name}"
    return f"\n{line} {len(block)}\n".encode() + block


def pages_to_arc(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", version: int = 1, date: str = "20200101000000") -> DataFrame:
    """(name, arc): archives of about ``ARCHIVE_BYTES``, one HTTP message for each row."""

    def run(batches):
        name, parts, size = "", [], 0
        for batch in batches:
            for k, u, h in zip(*(c.to_pylist() for c in batch.columns)):
                if not parts:
                    name = f"{uuid.uuid4().hex}.arc"
                    parts = [arc_header(name, version, date)]
                    size = len(parts[0])
                payload = (h or "").encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Key: {'' if k is None else k}\r\nContent-Length: {len(payload)}\r\n\r\n"
                parts.append(arc_record(u or "", head.encode() + payload, version, date, size, name))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(parts) + b"\n"], pa.binary())], names=["name", "arc"])
                    parts = []
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(parts) + b"\n"], pa.binary())], names=["name", "arc"])

    return pages.select(F.col(key).cast("long"), url, html).mapInArrow(run, "name string, arc binary")


def parse_arc(data: bytes):
    """Yield (fields by name, block) of each record after the version block.

    ValueError if a line has another number of fields than the archive's
    version has, or fewer bytes follow than it declares.
    """
    line_end = data.index(b"\n")
    length = int(data[:line_end].split(b" ")[-1])
    body = data[line_end + 1 : line_end + 1 + length].decode().splitlines()
    version = int(body[0].split(" ")[0])
    if version not in FIELDS:
        raise ValueError(f"ARC version {version}")
    names = body[1].split(" ") if len(body) > 1 else FIELDS[version].split(" ")
    at = line_end + 1 + length
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        line_end = data.index(b"\n", at)
        values = data[at:line_end].decode("utf-8", "replace").rstrip("\r").split(" ")
        if len(values) > len(names):  # blanks inside a URL, as old crawlers wrote
            extra = len(values) - len(names)
            values = [" ".join(values[: extra + 1]), *values[extra + 1 :]]
        if len(values) != len(names):
            raise ValueError(f"{len(values)} fields, not {len(names)}")
        n = int(values[-1])
        block = data[line_end + 1 : line_end + 1 + n]
        if len(block) < n:
            raise ValueError("a record is cut short")
        yield dict(zip(names, values)), block
        at = line_end + 1 + n


def _iso(date: str) -> str:
    d = re.sub(r"\D", "", date).ljust(14, "0")
    return f"{d[:4]}-{d[4:6] if d[4:6] != '00' else '01'}-{d[6:8] if d[6:8] != '00' else '01'}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def convert(archives: DataFrame, arc: str = "arc") -> DataFrame:
    """Records of ARC archives in WARC's terms (columns ``RECORD``)."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = []
                for fields, block in parse_arc(data) if data else ():
                    head, cut, payload = block.partition(b"\r\n\r\n")
                    http = bool(cut) and head.startswith(b"HTTP/")
                    if not http:
                        head, payload = b"", block
                    found = re.search(rb"(?im)^X-Key: (-?\d+)", head)
                    rows.append((int(found[1]) if found else None, fields["URL"], _iso(fields["Archive-date"]), fields["IP-address"], head, payload, len(payload), hashlib.sha256(payload).hexdigest(), "response" if http else "resource"))
                yield from _batch(rows)

    return archives.select(arc).mapInArrow(run, RECORD)


_TYPES = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.string())
_NAMES = [x.split()[0] for x in RECORD.split(", ")]


def _batch(rows):
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)


def mark_revisits(records: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Add ``first_key`` (smallest key with an equal payload, where large enough) and set ``record_type``.

    The first keys come from a pre-aggregated group by digest; the join back
    has one row for each digest on its small side, so a hot digest's rows can
    be split among tasks.
    """
    firsts = records.groupBy("payload_digest").agg(F.min("key").alias("first_key"))
    joined = records.join(firsts, "payload_digest", "left")
    again = (F.col("payload_bytes") >= least) & F.col("first_key").isNotNull() & ~F.col("key").eqNullSafe(F.col("first_key"))
    return joined.withColumn("record_type", F.when(again, "revisit").otherwise(F.col("record_type"))).withColumn("first_key", F.when(again, F.col("first_key")))


def record_id(key, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(f'{key}|{digest}'.encode()).hexdigest()[:32])}>"


def warc_column(records: DataFrame) -> DataFrame:
    """(record string): each row of ``mark_revisits`` as a WARC 1.1 record."""
    order = ("key", "url", "date", "ip", "http_head", "payload", "payload_digest", "record_type", "first_key")

    def run(batches):
        for batch in batches:
            out = []
            for key, url, date, ip, head, payload, digest, kind, first in zip(*(c.to_pylist() for c in batch.columns)):
                block = (head + b"\r\n\r\n" if head else b"") + (b"" if kind == "revisit" else payload)
                mime = "application/http; msgtype=response" if head else "application/octet-stream"
                lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(key, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {url}", f"WARC-IP-Address: {ip}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
                if kind == "revisit":
                    lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(first, digest)}", f"X-Refers-To-Key: {first}"]
                lines += [f"Content-Type: {mime}", f"Content-Length: {len(block)}"]
                out.append("\r\n".join(lines).encode() + b"\r\n\r\n" + block)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return records.select(*order).mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("record"))


def write_warc(records: DataFrame, path: str, per_file: int = 2000) -> None:
    """WARC files (gzip) of at most ``per_file`` records under ``path``."""
    warc_column(records).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse_warc(data: bytes):
    """Yield (fields by lower-case name, block) of each record."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC version line")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(fields["content-length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) < n or hashlib.sha256(block).hexdigest() != fields.get("warc-block-digest", "sha256:" + hashlib.sha256(block).hexdigest()).removeprefix("sha256:"):
            raise ValueError("a record is cut short or damaged")
        yield fields, block
        at = end + 4 + n


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(key, url, payload_bytes, payload_digest, record_type, refers_to) of the records under ``path``."""
    added = "key long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = []
                for fields, block in parse_warc(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    kind, (head, cut, payload) = fields["warc-type"], block.partition(b"\r\n\r\n")
                    if not head.startswith(b"HTTP/"):
                        head, payload = b"", block
                    found = re.search(rb"(?im)^X-Key: (-?\d+)", head)
                    if kind == "revisit":  # the head still declares the payload's length
                        size, digest = int(re.search(rb"(?im)^Content-Length: (\d+)", head)[1]), fields["warc-payload-digest"].removeprefix("sha256:")
                    else:
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    refers = fields.get("x-refers-to-key")
                    rows.append((int(found[1]) if found else None, fields["warc-target-uri"], size, digest, kind, int(refers) if refers else None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in added.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, added)
