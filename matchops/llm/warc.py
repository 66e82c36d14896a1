"""Legacy web archives: ARC files written, converted to WARC files, and read back.

An ARC file opens with a version block, whose second line names the fields of
all later header lines: five in version 1, ten in version 2.  A header line
ends with the length of the block that follows.  The converter reads header
lines by the names of their own file, takes exactly the declared bytes, and
makes up what WARC asks for beyond that: a record id from the archive's name
and the record's place in it (the same in every run), an ISO timestamp, a
type, block and payload digests.  Of several equal payloads one stays a
response, the others become revisits of it.

Archives are gzip files of Spark's text sink, one per task, so a file is read
by one task from its start, line by line, and lines are put together again by
the declared lengths; no file is ever whole in memory, whatever payloads hold.

Contract: a null payload is empty, a null id has no header and comes back
null, a null url is '-' in an ARC file and missing in a WARC file; blanks and
control characters of a url are percent-encoded.  Payloads are any bytes of
any length.  Repeated rows are records of their own.  Of equal payloads the
largest id is the response (nulls count as smallest), among equal ids the
last one by archive and position.  A 12-digit date counts from second 0; one
that cannot be read takes its archive's.  A declared length that does not end
at a record's end, a file that ends within a record, and a payload that does
not have its digest are errors.  An empty table makes archives without
records.  Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import replace
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchops.config import DEFAULT
from matchops.operators.joins import salted_join
from matchops.session import materialize

#: Fixed values of the ARC format: field names of a header line, by version.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
CAPTURED = "19991231235959"  # for pages without a date
ID_FIELD = b"X-Page-Id"
HELD_BYTES, HELD_ROWS = 4 << 20, 4096
GZIP = {"compression": "gzip", "zlib.compress.level": "FOUR"}  # on HTML a third of the time of level 6, 4 % larger
#: A payload is hot from so few copies on: its rows carry whole blocks.
HOT = replace(DEFAULT, hot_key_min_rows=500)


# --- lines of archives ----------------------------------------------------

class Lines:
    """The lines of one archive after the other, with the byte position of the next one."""

    def __init__(self, batches: Iterable[pa.RecordBatch]):
        self._stream = ((a, line) for b in batches for a, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        self._ahead = next(self._stream, None)
        self.archive, self.position = "", 0

    def next_archive(self) -> bool:
        """Go to the archive of the next line, if there is one."""
        if self._ahead is None:
            return False
        self.archive, self.position = self._ahead[0], 0
        return True

    def line(self) -> bytes | None:
        """The next line of this archive; None at its end."""
        if self._ahead is None or self._ahead[0] != self.archive:
            return None
        line = self._ahead[1]
        self._ahead = next(self._stream, None)
        self.position += len(line) + 1
        return line

    def block(self, length: int) -> bytes:
        """The next ``length`` bytes, which must end their line."""
        start, parts, size = self.position, [], -1
        while size < length:
            if (line := self.line()) is None:
                raise ValueError(f"{self.archive}: the record at {start} ends before its {length} bytes")
            parts.append(line)
            size += len(line) + 1
        data = b"\n".join(parts)
        if data[length:] not in (b"", b"\r"):
            raise ValueError(f"{self.archive}: the record at {start} goes on after its {length} bytes")
        return data[:length]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("archive"), F.col("value").cast("binary").alias("line"))


def _sent(rows: Iterator[tuple], schema: pa.Schema, sized: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size; ``sized`` is the place of the long column."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[sized])
        if size > HELD_BYTES or len(held) >= HELD_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _write(rows: DataFrame, make: Callable[[Iterable[dict]], Iterator[bytes]], path: str, end: str) -> None:
    """One archive a task: what ``make`` gives for its rows, each with ``end`` behind it."""
    schema = pa.schema([("record", pa.binary())])

    def run(batches):
        return _sent(((x,) for x in make(row for b in batches for row in b.to_pylist())), schema, 0)

    records = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string"))
    records.write.mode("overwrite").options(**GZIP).option("lineSep", end).text(path)


# --- ARC --------------------------------------------------------------------

def http_block(item: int | None, payload: bytes) -> bytes:
    """An HTTP response that carries the item's id."""
    own = b"" if item is None else ID_FIELD + b": %d\r\n" % item
    return b"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%sContent-Length: %d\r\n\r\n" % (own, len(payload)) + payload


def http_parts(block: bytes) -> tuple[int | None, bytes]:
    """(id, payload) of a block; one that is no HTTP response is all payload."""
    if not block.startswith(b"HTTP/"):
        return None, block
    head, _, payload = block.partition(b"\r\n\r\n")
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == ID_FIELD.lower():
            return int(value), payload
    return None, payload


def arc_header(version: int, fields: dict[str, str | bytes | int]) -> bytes:
    """A header line of that version."""
    texts = (fields[name] for name in ARC_FIELDS[version].split())
    return b" ".join(x if isinstance(x, bytes) else str(x).encode() for x in texts)


def write_arc(pages: DataFrame, path: str, version: int, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
              date: Column | None = None) -> None:
    """ARC files of that version with a record for every row."""
    rows = pages.select(F.col(id_col).cast("long").alias("item"), F.coalesce(F.col(url_col).cast("string"), F.lit("-")).alias("url"),
                        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
                        (F.lit(CAPTURED) if date is None else date).cast("string").alias("date"))

    def archive(items):
        name = "pages.arc"
        about = f"{version} 0 matchops\n{ARC_FIELDS[version]}\n\n".encode()
        rest = {"IP-address": "0.0.0.0", "Result-code": 200, "Checksum": "-", "Location": "-", "Filename": name}
        first = arc_header(version, rest | {"URL": f"filedesc://{name}", "Archive-date": CAPTURED, "Content-type": "text/plain",
                                            "Offset": 0, "Archive-length": len(about)}) + b"\n" + about
        position = len(first) + 1
        yield first
        for one in items:
            url = re.sub(rb"[\x00-\x20\x7F]", lambda m: b"%%%02X" % m[0][0], one["url"].encode()) or b"-"
            block = http_block(one["item"], one["payload"])
            record = arc_header(version, rest | {"URL": url, "Archive-date": one["date"], "Content-type": "text/html",
                                                 "Offset": position, "Archive-length": len(block)}) + b"\n" + block
            position += len(record) + 1
            yield record

    _write(rows, archive, path, "\n")


def arc_records(lines: Lines) -> Iterator[tuple[str, int, dict[str, str], bytes]]:
    """(archive, position, header fields, block) of every record, version blocks included."""
    while lines.next_archive():
        names: list[str] = []
        while (position := lines.position, header := lines.line())[1] is not None:
            if not header.strip():
                continue
            if not names:
                if not header.startswith(b"filedesc:"):
                    raise ValueError(f"{lines.archive}: no version block")
                block = lines.block(int(header.rpartition(b" ")[2]))
                names = block.decode("latin-1").split("\n")[1].split()
                values = header.rsplit(b" ", len(names) - 1)
            else:
                values = header.rsplit(b" ", len(names) - 1)  # an old url may hold blanks
                block = None
            if len(values) != len(names):
                raise ValueError(f"{lines.archive}: the header at {position} has no {len(names)} fields")
            fields = {n: v.decode("utf-8", "surrogateescape") for n, v in zip(names, values, strict=True)}
            yield lines.archive, position, fields, lines.block(int(fields["Archive-length"])) if block is None else block


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """(archive, position, fields, block) of ARC files of both versions."""
    schema = pa.schema([("archive", pa.string()), ("position", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])

    def read(batches):
        clean = ((a, p, [(n, v.encode("utf-8", "surrogateescape").decode("utf-8", "replace")) for n, v in f.items()], b)
                 for a, p, f, b in arc_records(Lines(batches)))
        return _sent(clean, schema, 3)

    return _lines(spark, path).mapInArrow(read, "archive string, position long, fields map<string,string>, block binary")


# --- ARC to WARC ------------------------------------------------------------

def sha1(data: bytes) -> str:
    return hashlib.sha1(data).hexdigest()


def labelled(digest: str) -> bytes:
    """A digest as WARC headers have it."""
    return b"sha1:" + base64.b32encode(bytes.fromhex(digest))


def iso_date(date: str, otherwise: str) -> str:
    """The timestamp of a 14- or 12-digit date."""
    for text in (date, otherwise, CAPTURED):
        for size, form in ((14, "%Y%m%d%H%M%S"), (12, "%Y%m%d%H%M")):
            if len(text) == size and text.isascii() and text.isdigit():
                try:
                    return datetime.strptime(text, form).strftime("%Y-%m-%dT%H:%M:%SZ")
                except ValueError:
                    break
    raise AssertionError


_WARC = pa.schema([
    ("archive", pa.string()), ("position", pa.int64()), ("record_id", pa.string()), ("warc_type", pa.string()), ("date", pa.string()),
    ("uri", pa.binary()), ("ip", pa.string()), ("content_type", pa.string()), ("item", pa.int64()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("block_digest", pa.string()), ("block", pa.binary())])
_WARC_DDL = ("archive string, position long, record_id string, warc_type string, date string, uri binary, ip string, content_type string, "
             "item long, payload_bytes long, payload_digest string, block_digest string, block binary")


def as_warc(records: Iterator[tuple[str, int, dict[str, str], bytes]]) -> Iterator[tuple]:
    """A WARC record for every ARC record; the version block becomes a warcinfo record."""
    archive_date = CAPTURED
    for archive, position, fields, block in records:
        about = fields["URL"].startswith("filedesc:")
        if about:
            archive_date = fields["Archive-date"]
        http = block.startswith(b"HTTP/")
        item, payload = http_parts(block)
        kind = fields["Content-type"]
        name = archive.rsplit("/", 1)[-1]
        yield (archive, position, f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{position}')}>",
               "warcinfo" if about else "response" if http else "resource", iso_date(fields["Archive-date"], archive_date),
               None if about or fields["URL"] == "-" else fields["URL"].encode("utf-8", "surrogateescape"),
               None if fields["IP-address"] in ("0.0.0.0", "-") else fields["IP-address"],
               "application/http; msgtype=response" if http else kind if "/" in kind else "application/octet-stream",
               item, len(payload), sha1(payload), sha1(block), block)


def convert(spark: SparkSession, path: str) -> DataFrame:
    """The WARC records of ARC files, without revisits."""
    return _lines(spark, path).mapInArrow(lambda batches: _sent(as_warc(arc_records(Lines(batches))), _WARC, 12), _WARC_DDL)


def with_revisits(records: DataFrame, least: int = 1000) -> DataFrame:
    """Records whose payload of at least ``least`` bytes is that of a response
    with a larger id become its revisits: ``first`` is that response."""
    known = records.where("warc_type <> 'warcinfo'").select(
        "payload_digest", "payload_bytes", "record_id", "item", "archive", "position", "date", "uri", "warc_type")
    groups = materialize(known.groupBy("payload_digest").agg(
        F.count(F.lit(1)).alias("copies"), F.first("payload_bytes").alias("size"),
        F.max(F.when(F.col("warc_type") == "response", F.struct("item", "archive", "position", "record_id", "date", "uri"))).alias("first")),
        "payloads")
    shared = groups.where((F.col("copies") > 1) & (F.col("size") >= least) & F.col("first").isNotNull()).select("payload_digest", "first")
    joined = salted_join(records, shared, groups.select("payload_digest", "copies"), "payload_digest", "copies", "record_id", cfg=HOT)
    again = (F.col("warc_type") == "response") & (F.col("first.record_id") != F.col("record_id"))
    return joined.withColumns({"warc_type": F.when(again, F.lit("revisit")).otherwise(F.col("warc_type")),
                               "first": F.when(again, F.col("first"))})


# --- WARC -------------------------------------------------------------------

def warc_record(fields: Iterable[tuple[bytes, bytes | str | None]], block: bytes) -> bytes:
    """Header fields (those with a value) and block of one record."""
    lines = [name + b": " + (v if isinstance(v, bytes) else v.encode()) for name, v in fields if v is not None]
    return b"\r\n".join([b"WARC/1.0", *lines, b"Content-Length: %d" % len(block), b"", b""]) + block


def write_warc(records: DataFrame, path: str) -> None:
    """WARC files; a revisit keeps the HTTP headers of its block only."""

    def archive(rows):
        for row in rows:
            block, first = row["block"], row["first"]
            if row["warc_type"] == "revisit":
                block = block.partition(b"\r\n\r\n")[0] + b"\r\n\r\n"
            about = row["warc_type"] == "warcinfo"
            yield warc_record([
                (b"WARC-Type", row["warc_type"]), (b"WARC-Record-ID", row["record_id"]), (b"WARC-Date", row["date"]),
                (b"WARC-Target-URI", row["uri"]), (b"WARC-IP-Address", row["ip"]), (b"Content-Type", row["content_type"]),
                (b"WARC-Filename", row["archive"].rsplit("/", 1)[-1] if about else None),
                (b"WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest" if first else None),
                (b"WARC-Refers-To", first and first["record_id"]), (b"WARC-Refers-To-Target-URI", first and first["uri"]),
                (b"WARC-Refers-To-Date", first and first["date"]),
                (b"WARC-Block-Digest", labelled(sha1(block) if first else row["block_digest"])),
                (b"WARC-Payload-Digest", None if about else labelled(row["payload_digest"]))], block)

    _write(records, archive, path, "\r\n\r\n")


def warc_records(lines: Lines) -> Iterator[tuple[str, int, dict[bytes, bytes], bytes]]:
    """(archive, position, header fields by lower-case name, block) of every record."""
    while lines.next_archive():
        while (position := lines.position, line := lines.line())[1] is not None:
            if line.rstrip(b"\r") == b"":
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{lines.archive}: no record at {position}")
            fields = {}
            while (line := lines.line()) is not None and line.rstrip(b"\r"):
                name, _, value = line.partition(b":")
                fields[name.strip().lower()] = value.strip()
            yield lines.archive, position, fields, lines.block(int(fields[b"content-length"]))


_READ = pa.schema([
    ("archive", pa.string()), ("position", pa.int64()), ("record_id", pa.string()), ("warc_type", pa.string()), ("date", pa.string()),
    ("uri", pa.binary()), ("refers_to", pa.string()), ("item", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
_READ_DDL = ("archive string, position long, record_id string, warc_type string, date string, uri binary, refers_to string, item long, "
             "payload_digest string, payload binary")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(archive, position, record_id, warc_type, date, uri, refers_to, item,
    payload_digest, payload) of WARC files; a revisit has an empty payload
    and the digest of the one it refers to."""

    def rows(records):
        for archive, position, fields, block in records:
            item, payload = http_parts(block)
            kind, refers = fields[b"warc-type"].decode(), fields.get(b"warc-refers-to")
            said = fields.get(b"warc-payload-digest")
            digest = sha1(payload) if said is None else base64.b32decode(said.partition(b":")[2]).hex()
            if kind != "revisit" and digest != sha1(payload):
                raise ValueError(f"{archive}: the payload at {position} does not have its digest")
            yield (archive, position, fields[b"warc-record-id"].decode(), kind, fields[b"warc-date"].decode(),
                   fields.get(b"warc-target-uri"), refers and refers.decode(), item, digest, payload)

    return _lines(spark, path).mapInArrow(lambda batches: _sent(rows(warc_records(Lines(batches))), _READ, 9), _READ_DDL)


def resolved(records: DataFrame) -> DataFrame:
    """(item, payload_bytes, payload_digest, record_type, refers_to) of all
    records but warcinfo: revisits take size and id of their response."""
    rows = materialize(records.where("warc_type <> 'warcinfo'").select(
        "item", F.length("payload").cast("long").alias("payload_bytes"), "payload_digest", F.col("warc_type").alias("record_type"),
        "record_id", F.col("refers_to").alias("of")), "records")
    again = rows.where("record_type = 'revisit'")
    full = rows.where("record_type <> 'revisit'").select(F.col("record_id").alias("of"), F.col("payload_bytes").alias("full_bytes"),
                                                        F.col("item").alias("refers_to"))
    found = salted_join(again, full, again.groupBy("of").agg(F.count(F.lit(1)).alias("n")), "of", "n", "record_id", cfg=HOT)
    own = rows.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    columns = ["item", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return own.select(columns).union(found.withColumn("payload_bytes", F.col("full_bytes")).select(columns))
