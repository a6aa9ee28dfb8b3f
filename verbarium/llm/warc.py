"""Legacy archive converter: ARC 1 and 2 records to WARC 1.1, and a WARC reader.

An ARC archive is a version block followed by records; each has a header line of the version's fields separated by
single spaces, the last being the declared length, then that many bytes, then a newline. The converter parses header
lines by version and takes contents by declared length (never by searching), splits HTTP head from body, and
synthesises what ARC lacks: a record identifier, a WARC date from the 14-digit archive date, a record type
(response, or revisit for a payload that an earlier record holds) and SHA-1 digests of block and payload.

WARC files are written by Spark's text writer with CRLF CRLF as the line end: that is exactly the end of a WARC
record, so the part files are valid WARC files, written by executors to any file system Spark can write to, with
its commit protocol. They are read back as whole binary files of bounded size and parsed by declared length.

Edge cases: a null html is the empty payload; a null or blank url is written as ``urn:unknown``; white space and control
characters in urls are percent-encoded, since ARC separates fields by spaces and headers end at line ends; a row with a
null page_id gets a record identifier of its own kind (a version 4 UUID from its url and digest), is read back as null, and is
a response unless a page with an identifier has its payload; repeated rows with the smallest page_id of their payload are
all responses; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbarium.llm.common import shared_dir, small_batches, staged, table, tidy

#: Fixed values of the two ARC versions: the fields of a record's header line.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length"),
}
CRLF = b"\r\n"
_UNSAFE = re.compile(r"[\x00-\x20\x7f-\x9f\s]")
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records in a WARC file, which bounds what a reader holds at a time.
#: (payload bytes below, records in a file at most): a file holds about 64 MB, or one record beyond that.
FILE_CLASSES = ((64 << 10, 1000), (1 << 20, 64), (16 << 20, 4), (1 << 40, 1))
#: Revisits up to this number are broadcast (24 bytes each); beyond it pages are joined by shuffle.
BROADCAST_ROWS = 200_000


@dataclass
class ArcRecord:
    version: int
    fields: dict[str, str]
    content: bytes

    def http(self) -> tuple[bytes, bytes]:
        """Head (with its empty line) and body."""
        at = self.content.find(CRLF + CRLF)
        return (self.content, b"") if at < 0 else (self.content[: at + 4], self.content[at + 4 :])


def escaped(field: str) -> str:
    """A header field with white space and control characters percent-encoded."""
    return _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "surrogatepass")), field)


def arc_header(version: int, **fields: str) -> bytes:
    return (" ".join(escaped(str(fields.get(name) or "-")) for name in ARC_FIELDS[version]) + "\n").encode("utf-8", "surrogatepass")


def arc_archive(version: int, date: str, records: list[tuple[dict, bytes]], name: str = "part.arc") -> bytes:
    """An ARC file: the version block and the records, each ended by a newline."""
    about = f"{version} 0 verbarium\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    out = [arc_header(version, url=f"filedesc://{name}", ip="0.0.0.0", date=date, type="text/plain", result="200", offset="0", filename=name, length=len(about)), about, b"\n"]
    for fields, content in records:
        out += [arc_header(version, **fields, length=len(content)), content, b"\n"]
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file, by the version that its first block declares. Raises ValueError if it is cut short."""
    version, at = 0, 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("header line without end")
        parts = data[at:end].decode("utf-8", "surrogateescape").rstrip("\r").split(" ")
        length = int(parts[-1])
        content = data[end + 1 : end + 1 + length]
        if len(content) != length:
            raise ValueError(f"declared {length} bytes, found {len(content)}")
        at = end + 1 + length
        if not version:
            version = int(content.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version}")
            continue
        if len(parts) != len(ARC_FIELDS[version]):
            raise ValueError(f"{len(parts)} fields in a version {version} header")
        yield ArcRecord(version, dict(zip(ARC_FIELDS[version], parts, strict=True)), content)


def record_id(page_id: int | None, nameless: bytes = b"") -> str:
    """A version 8 UUID that holds the identifier's 64 bits; without one, a version 4 UUID from what tells the record apart."""
    if page_id is None:
        return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(nameless).digest()[:16], version=4)}>"
    n = page_id & 0xFFFFFFFFFFFFFFFF
    return f"<urn:uuid:{uuid.UUID(int=(0x7665726261 << 80) | (0x8 << 76) | ((n >> 62) << 64) | (0x2 << 62) | (n & ((1 << 62) - 1)))}>"


def page_of(identifier: str) -> int | None:
    found = uuid.UUID(identifier.strip("<>").removeprefix("urn:uuid:"))
    if found.version != 8:
        return None
    n = found.int
    value = (((n >> 64) & 0x3) << 62) | (n & ((1 << 62) - 1))
    return value - (1 << 64) if value >> 63 else value


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_date(arc_date: str) -> str:
    d = arc_date
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def to_warc(record: ArcRecord, page_id: int | None, refers_to: int | None) -> bytes:
    """A WARC record without the CRLF CRLF that ends it: a response, or a revisit of the response of refers_to."""
    head, body = record.http()
    block = head if refers_to is not None else record.content
    nameless = record.fields["url"].encode("utf-8", "surrogateescape") + hashlib.sha256(body).digest() if page_id is None else b""
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, nameless)),
        ("WARC-Date", warc_date(record.fields["date"])),
        ("WARC-Target-URI", record.fields["url"]),
        ("WARC-IP-Address", record.fields["ip"]),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(body)}"),
        *([] if refers_to is None else [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", IDENTICAL)]),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogateescape") + CRLF + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record, by declared length."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no record at byte {at}")
        end = data.index(CRLF + CRLF, at)
        lines = data[at:end].decode("utf-8", "surrogateescape").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(fields["content-length"])
        block = data[end + 4 : end + 4 + length]
        if len(block) != length or data[end + 4 + length : end + 8 + length] != CRLF + CRLF:
            raise ValueError(f"record at byte {at} is cut short")
        yield fields, block
        at = end + 8 + length


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of pages -> an ARC archive of the batch (versions alternate by batch) -> WARC records."""
    for k, batch in enumerate(batches):
        rows, version = batch.to_pylist(), 1 + k % 2
        records = []
        for r in rows:
            body = (r["html"] or "").encode()
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
            records.append(({"url": (r["url"] or "").strip() or "urn:unknown", "ip": "0.0.0.0", "date": "20260101000000", "type": "text/html", "result": "200", "checksum": "-", "offset": "0", "filename": "pages.arc"}, head + body))
        found = parse_arc(arc_archive(version, "20260101000000", records))
        yield pa.RecordBatch.from_arrays([pa.array([to_warc(a, r["page_id"], r["refers_to"]) for a, r in zip(found, rows, strict=True)], pa.binary())], names=["record"])


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, date string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files -> their records' metadata; a digest that doesn't fit its response's payload raises."""
    for batch in batches:
        for i in range(batch.num_rows):
            out = []
            for fields, block in parse_warc(batch.column(0)[i].as_buffer().to_pybytes()):
                head, _, body = block.partition(CRLF + CRLF)
                declared = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(CRLF)[1:])}
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                if fields["warc-type"] == "response" and digest != sha1_base32(body):
                    raise ValueError(f"payload digest of {fields['warc-record-id']}")
                refers = fields.get("warc-refers-to")
                out.append((page_of(fields["warc-record-id"]), int(declared[b"content-length"]), digest, fields["warc-type"], page_of(refers) if refers else None, fields["warc-target-uri"], fields["warc-date"]))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, kinds, strict=True)], names=[x.split(" ")[0] for x in _READ.split(", ")])


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with refers_to: the smallest page_id of an equal payload, if that is another one.

    Equal means equal SHA-256 and length. Only digests are shuffled unless revisits are too many to broadcast.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    slim = pages.where(F.octet_length(html) >= least_bytes).select("page_id", F.unhex(F.sha2(html, 256)).alias("key"), F.octet_length(html).alias("n"))
    slim = staged(slim, "payloads")
    firsts = slim.groupBy("key", "n").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    firsts = staged(firsts.where("rows > 1").drop("rows"), "first-payloads")
    again = staged(slim.join(firsts, ["key", "n"]).where("NOT page_id <=> first").select("page_id", "key", F.col("first").alias("refers_to")).distinct(), "revisits")
    if again.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    rows = pages.select("page_id", "url", "html", F.unhex(F.sha2(html, 256)).alias("key"))
    own = rows["page_id"].eqNullSafe(again["page_id"]) & (rows["key"] == again["key"])
    return rows.join(again, own, "left").select(rows["page_id"], "url", "html", "refers_to")


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """WARC files of pages under path, which any file system of Spark's may hold; one write for each class of sizes.

    Spark limits a file's records, not its bytes, so larger payloads go to files of fewer records.
    """
    small_batches(pages.sparkSession)
    known = with_revisits(pages, least_bytes)
    size, low = F.coalesce(F.octet_length("html"), F.lit(0)), 0
    there = pages.agg(F.max(size)).first()[0]
    for high, records in FILE_CLASSES:
        if low and (there is None or there < low):
            break  # no payload is that large
        some = known.where((size >= low) & (size < high)).mapInArrow(tidy(_convert), "record binary")
        some.select(F.col("record").cast("string").alias("value")).write.mode("append").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records).text(path)
        low = high


def read_warc(spark, path: str) -> DataFrame:
    """One row per record of the WARC files under path."""
    small_batches(spark)  # a row is a whole file: a batch ends at 8 MB
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(tidy(_read), _READ)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: all pages through ARC to WARC files in the shared folder, and back."""
    path = f"{shared_dir(spark)}/warc/{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
             CAST(unhex(sha1(html)) AS BIT)::VARCHAR AS bits, min(page_id) OVER (PARTITION BY html) AS first
      FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT)
           + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT)
           + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""
