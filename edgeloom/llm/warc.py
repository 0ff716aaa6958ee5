"""Legacy ARC to WARC conversion.

``pages_to_arc`` frames each page as an ARC record (version 1 or 2 header line,
declared length), ``arc_to_warc`` parses ARC bytes and builds WARC records,
``write_archives`` stores them as gzipped ``.warc`` files with Spark's own
writer, and ``read_archives`` reads such files back, record by record, trusting
declared lengths only.

Identifiers are UUIDs of version 8 (free layout) that carry the 64-bit page id
and a hash of the url, so a reference to a record names its page. Equal
payloads of ``min_revisit`` bytes or more are stored once: the record with the
smallest page id is the response, the others are revisits that refer to it.

How it scales: digests and the smallest page id per digest are one partial
aggregation over (digest, page id); only digests that occur twice are joined
back. Files hold at most ``records_per_file`` records and are read as streams, so
neither a file's nor a task's size matters, only a record's. A lost executor's
files are rewritten by Spark's commit protocol.

Defined cases: a null html is an empty payload, a null url an empty target; a
null page id never counts as the smallest while another exists and is read back
as null; rows that repeat a page id with the same payload are all responses or
all revisits; rows that repeat page id and url are one capture and share their
identifier; payloads of any length are kept whole; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.common import scratch_path

CRLF = b"\r\n"
#: Fixed values of the two formats: header fields of ARC version 1 and 2, in order.
ARC_FIELDS = {
    1: ["url", "ip", "date", "type", "length"],
    2: ["url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Capture time given to pages, which have none of their own.
CAPTURED = "20240101000000"


# ---- ARC ------------------------------------------------------------------


def arc_version_block(version: int, name: str = "pages.arc") -> bytes:
    """The record that opens an ARC file and names its version's fields."""
    names = {
        1: "URL IP-address Archive-date Content-type Archive-length",
        2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
    }[version]
    body = f"{version} 0 edgeloom\n{names}\n".encode()
    fields = {"url": f"filedesc://{name}", "ip": "0.0.0.0", "date": CAPTURED, "type": "text/plain", "result": "200", "checksum": "-", "location": "-", "offset": "0", "filename": name, "length": str(len(body))}
    return " ".join(fields[f] for f in ARC_FIELDS[version]).encode() + b"\n" + body + b"\n"


def arc_record(version: int, url: str, payload: bytes, date: str = CAPTURED, filename: str = "pages.arc", offset: int = 0) -> bytes:
    """One ARC record: header line, HTTP response of the declared length, newline."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = {
        "url": _arc_url(url),
        "ip": "0.0.0.0",
        "date": date,
        "type": "text/html",
        "result": "200",
        "checksum": hashlib.md5(payload).hexdigest(),
        "location": "-",
        "offset": str(offset),
        "filename": filename,
        "length": str(len(http) + len(payload)),
    }
    return " ".join(fields[f] for f in ARC_FIELDS[version]).encode() + b"\n" + http + payload + b"\n"


def _arc_url(url: str) -> str:
    """ARC fields end at a space: blanks and control characters are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) or "-"


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of ARC bytes. The version block sets the fields of the lines after it."""
    at, version = 0, 1
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].rstrip(b"\r").decode("utf-8", "surrogateescape")
        fields = _arc_fields(line, version)
        start = end + 1
        block = data[start : start + int(fields["length"])]
        if len(block) < int(fields["length"]):
            raise ValueError(f"ARC record of {fields['url']} is cut short")
        at = start + len(block)
        if fields["url"].startswith("filedesc:"):
            version = int(block.split(b" ", 1)[0])
        yield fields | {"version": version, "block": block}


def _arc_fields(line: str, version: int) -> dict[str, str]:
    parts = line.split(" ")
    if line.startswith("filedesc:"):
        version = 2 if len(parts) == len(ARC_FIELDS[2]) else 1
    names = ARC_FIELDS[version]
    if len(parts) != len(names):
        # A url with spaces in it: the fields are counted from the right.
        extra = len(parts) - len(names)
        if extra < 0:
            raise ValueError(f"ARC header of version {version} needs {len(names)} fields: {line!r}")
        parts = [" ".join(parts[: extra + 1]), *parts[extra + 1 :]]
    return dict(zip(names, parts))


# ---- WARC -----------------------------------------------------------------


def record_id(page_id: int | None, url: str) -> str:
    """UUID of version 8: 48 + 9 bits of the url's hash, a null flag, then the page id."""
    seed = int.from_bytes(hashlib.blake2b(url.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")
    number = (page_id or 0) & (1 << 64) - 1
    high = seed >> 16
    middle = (seed & 0x1FF) << 3 | (page_id is None) << 2 | number >> 62
    value = high << 80 | 8 << 76 | middle << 64 | 2 << 62 | number & (1 << 62) - 1
    return f"<urn:uuid:{uuid.UUID(int=value)}>"


def page_of(identifier: str) -> int | None:
    """The page id that ``record_id`` put into an identifier."""
    value = uuid.UUID(identifier.strip("<>").removeprefix("urn:uuid:")).int
    middle = value >> 64 & 0xFFF
    if middle >> 2 & 1:
        return None
    number = (middle & 3) << 62 | value & (1 << 62) - 1
    return number - (1 << 64) if number >> 63 else number


def arc_to_warc(record: dict, page_id: int | None, refers_to: str | None = None) -> bytes:
    """The WARC record equal to a parsed ARC record, without the blank lines that end it;
    a revisit where ``refers_to`` is given, the identifier of the response it repeats."""
    is_revisit = refers_to is not None
    head, _, payload = record["block"].partition(CRLF + CRLF)
    when = datetime.strptime(record["date"], "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc)
    http = head + CRLF + CRLF
    body = http if is_revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, record["url"])),
        ("WARC-Date", when.strftime("%Y-%m-%dT%H:%M:%SZ")),
        ("WARC-Target-URI", record["url"]),
        ("WARC-IP-Address", record["ip"]),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(payload).hexdigest()),
        ("WARC-Block-Digest", "sha256:" + hashlib.sha256(body).hexdigest()),
    ]
    if is_revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", refers_to)]
    fields.append(("Content-Length", str(len(body))))
    lines = CRLF.join(f"{k}: {v}".encode("utf-8", "surrogateescape") for k, v in fields)
    return b"WARC/1.1" + CRLF + lines + CRLF + CRLF + body


def parse_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record; the declared length alone ends a block."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("WARC record is cut short")
        yield fields, block


# ---- Spark ----------------------------------------------------------------


def pages_to_records(pages: DataFrame, min_revisit: int = 100) -> DataFrame:
    """(record): one WARC record per page, by way of an ARC record of version 1 or 2."""
    slim = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    digest = F.when(F.octet_length("html") >= min_revisit, F.sha2(F.col("html").cast("binary"), 256))
    response = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", F.coalesce("url", F.lit("")).alias("url")))).alias("response")
    twice = (
        slim.select("page_id", "url", digest.alias("digest"))
        .where("digest IS NOT NULL")
        .groupBy("digest")
        .agg(response, F.count("*").alias("n"))
        .where("n > 1 AND response IS NOT NULL")
        .select("digest", "response")
    )
    # Small payloads get a key each, which no digest equals: a null key would be one hot task.
    alone = F.concat_ws("-", F.lit("page"), F.col("page_id").cast("string"), F.xxhash64("url").cast("string"))
    joined = slim.withColumn("digest", F.coalesce(digest, alone)).join(twice, "digest", "left")
    joined = joined.select("page_id", "url", "html", F.col("response.page_id").alias("first_id"), F.col("response.url").alias("first_url"))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows, out = batch.slice(lo, 256).to_pydict(), []
                for page_id, url, html, first, first_url in zip(*(rows[c] for c in ("page_id", "url", "html", "first_id", "first_url"))):
                    version = 1 + (page_id or 0) % 2
                    arc = arc_version_block(version) + arc_record(version, url or "", html.encode())
                    *_, record = parse_arc(arc)
                    revisit = first is not None and first != page_id
                    out.append(arc_to_warc(record, page_id, record_id(first, _arc_url(first_url)) if revisit else None))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return joined.mapInArrow(convert, "record binary")


def write_archives(records: DataFrame, path: str, records_per_file: int = 4000) -> None:
    """Gzipped WARC files. Two blank lines end each record: they are the line separator."""
    (
        records.select(F.col("record").cast("string").alias("value"))
        .write.option("lineSep", "\r\n\r\n")
        .option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per WARC record: page_id, payload_bytes, payload_digest, record_type, refers_to,
    url, warc_date, record_id, refers_to_id.

    Spark inflates the files and cuts them at blank lines; the pieces are put together again
    as a stream, in which declared lengths alone end a record, one record in memory at a
    time. The payload digest of a response is checked against its bytes.
    """
    pieces = spark.read.option("lineSep", "\r\n\r\n").option("pathGlobFilter", "*.gz").text(path).select(F.col("value").cast("binary").alias("piece"))
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, warc_date string, record_id string, refers_to_id string"
    names = [c.split()[0] for c in schema.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for fields, block in parse_warc(io.BufferedReader(_Pieces(batches), 1 << 16)):
            rows.append(_summary(fields, block))
            if len(rows) == 2000:
                yield _rows(rows, names)
                rows = []
        if rows:
            yield _rows(rows, names)

    return pieces.mapInArrow(parse, schema)


class _Pieces(io.RawIOBase):
    """Pieces of files, each followed by the blank lines it was cut at, read as a stream."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.pieces = (v.as_buffer() for batch in batches for v in batch.column(0))
        self.rest: memoryview | bytes = b""
        self.ended = True

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not len(self.rest):
            if not self.ended:
                self.rest, self.ended = CRLF + CRLF, True
                continue
            piece = next(self.pieces, None)
            if piece is None:
                return 0
            self.rest, self.ended = memoryview(piece).cast("B"), False
        n = min(len(into), len(self.rest))
        into[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def _summary(fields: dict[str, str], block: bytes) -> tuple:
    head, _, payload = block.partition(CRLF + CRLF)
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    kind = fields["warc-type"]
    if kind == "revisit":
        size = int(re.search(rb"(?im)^content-length:\s*(\d+)", head)[1])
        refers = page_of(fields["warc-refers-to"])
    else:
        size, refers = len(payload), None
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload digest of {fields['warc-record-id']} does not match")
    return page_of(fields["warc-record-id"]), size, digest, kind, refers, fields["warc-target-uri"], fields["warc-date"], fields["warc-record-id"], fields.get("warc-refers-to")


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.string()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def convert_pages(pages: DataFrame, path: str | None = None, min_revisit: int = 100) -> DataFrame:
    """Write all pages as WARC archives (to ``path`` or the shared folder) and read them back."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages_to_records(pages, min_revisit), path)
    return read_archives(spark, path)
