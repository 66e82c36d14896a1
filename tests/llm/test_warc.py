"""ARC files, their conversion, and WARC files, against plain sequential readers."""

import base64
import glob
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from matchops.llm import warc
from matchops.llm.common import importable

SCHEMA = "page_id long, url string, html string, record_id string, first int, block string, n long"
LONG = "long payload é " * 90
PAYLOADS = [
    "<p>one</p>", "", None, "a\nb\n", "\n", "\r\n\r\n", "x" * 999, "x" * 1000, LONG, LONG, LONG + "\n", "WARC/1.0\r\nWARC-Type: response\r\n\r\n" * 40,
    "http://a.b 0.0.0.0 20000101000000 text/html 5\nabcde\n" * 30, "nul\x00and\x85  lines", "é" * 500, "é" * 500, "tail\r", "\r" * 1200, "y" * 300_000,
    "HTTP/1.0 200 OK\r\nX-Page-Id: 5\r\n\r\ninner" + "z" * 1000,
]


def rows_of(payloads):
    return [(i, f"http://s{i}.example/ä b\t?q={i}" if i % 5 else None, p, "r", 1, "b", 2) for i, p in enumerate(payloads)]


def frame(spark, rows):
    importable(spark)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def brute(rows, least=1000):
    """(page_id, bytes, digest, type, refers_to) in sorted order."""
    out, by = [], {}
    for i, _, p, *_ in rows:
        by.setdefault((p or "").encode(), []).append(i)
    for payload, ids in by.items():
        ids.sort(key=lambda i: (i is not None, i))
        digest = hashlib.sha1(payload).hexdigest()
        for nth, i in enumerate(ids):
            again = len(payload) >= least and nth + 1 < len(ids)
            out.append((i, len(payload), digest, "revisit" if again else "response", ids[-1] if again else None))
    return sorted(out, key=str)


def through(spark, frame, folder, version=1, least=1000):
    warc.write_arc(frame, f"{folder}/arc", version)
    warc.write_warc(warc.with_revisits(warc.convert(spark, f"{folder}/arc"), least), f"{folder}/warc")
    return sorted((tuple(r) for r in warc.resolved(warc.read_warc(spark, f"{folder}/warc")).collect()), key=str)


def walk(data):
    """(fields, block) of a WARC file, by its lengths alone."""
    at, out = 0, []
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].split(b"\r\n")
        assert version == b"WARC/1.0"
        fields = dict(x.split(b": ", 1) for x in lines)
        at = end + 4 + int(fields[b"Content-Length"])
        out.append((fields, data[end + 4:at]))
        assert data[at:at + 4] == b"\r\n\r\n"
        at += 4
    return out


@pytest.mark.parametrize("version", [1, 2])
def test_round_trip(spark, tmp_path, version):
    rows = rows_of(PAYLOADS + [LONG] * 7)
    rows += [rows[9], rows[9], (None, "http://n", LONG, "r", 1, "b", 2), (None, None, "w" * 2000, "r", 1, "b", 2), (None, None, "w" * 2000, "r", 1, "b", 2)]
    assert through(spark, frame(spark, rows), tmp_path, version) == brute(rows)


def test_hot_payload_is_salted(spark, tmp_path, monkeypatch):
    from dataclasses import replace

    monkeypatch.setattr(warc, "HOT", replace(warc.HOT, hot_key_min_rows=5, hot_key_shares=8))
    rows = rows_of([LONG if i % 3 == 0 else f"{i} " * 400 for i in range(120)])
    assert through(spark, frame(spark, rows), tmp_path) == brute(rows)


def test_files_are_valid_and_records_equivalent(spark, tmp_path):
    rows = rows_of(PAYLOADS)
    through(spark, frame(spark, rows), tmp_path, 2)
    seen, ids = {}, set()
    for name in glob.glob(f"{tmp_path}/warc/*.gz"):
        for fields, block in walk(gzip.open(name).read()):
            ids.add(fields[b"WARC-Record-ID"])
            assert fields[b"WARC-Block-Digest"] == b"sha1:" + base64.b32encode(hashlib.sha1(block).digest())
            assert fields[b"WARC-Date"] == b"1999-12-31T23:59:59Z"
            if fields[b"WARC-Type"] == b"warcinfo":
                assert fields[b"WARC-Filename"].startswith(b"part-")
                continue
            item, payload = warc.http_parts(block)
            seen[item] = fields
            if fields[b"WARC-Type"] == b"response":
                assert payload == (PAYLOADS[item] or "").encode()
            else:
                assert payload == b"" and fields[b"WARC-Profile"].endswith(b"identical-payload-digest")
    assert set(seen) == set(range(len(PAYLOADS)))
    assert len(ids) > len(seen)  # a warcinfo record for every archive
    assert b"WARC-Target-URI" not in seen[0]
    assert seen[1][b"WARC-Target-URI"] == "http://s1.example/ä%20b%09?q=1".encode()
    assert seen[8][b"WARC-Type"] == b"revisit" and seen[8][b"WARC-Refers-To"] == seen[9][b"WARC-Record-ID"]
    assert seen[8][b"WARC-Refers-To-Target-URI"] == seen[9][b"WARC-Target-URI"] and b"WARC-Refers-To-Target-URI" not in seen[14]


def test_conversion_is_the_same_in_every_run(spark, tmp_path):
    warc.write_arc(frame(spark, rows_of(PAYLOADS)), f"{tmp_path}/arc", 1)
    one, two = ({tuple(r) for r in warc.convert(spark, f"{tmp_path}/arc").select("record_id", "item", "block_digest").collect()} for _ in "ab")
    assert one == two and len(one) == len({r[0] for r in one})


def arc_file(folder, version, records, about=None):
    """A foreign ARC file, written by hand."""
    about = about or f"{version} 0 someone\n{warc.ARC_FIELDS[version]}\n\n".encode()
    middle = b" 200 - - 0 x.arc" if version == 2 else b""
    data = b"filedesc://x.arc 1.2.3.4 19970214 text/plain" + middle + b" %d\n" % len(about) + about + b"\n"
    with gzip.open(f"{folder}/x{version}.arc.gz", "wb") as f:
        f.write(data + b"".join(head + b" %d\n" % len(block) + block + b"\n" for head, block in records))


def test_foreign_files_of_both_versions(spark, tmp_path):
    importable(spark)
    http = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n\xff\xfe binary \n\n"
    arc_file(tmp_path, 1, [(b"http://a.example/with blank/x 10.0.0.1 199610241232 text/html", http),
                           (b"dns:a.example 10.0.0.2 19961024123456 text/dns", b"a.example. IN A 10.0.0.1"),
                           (b"http://b.example/ 0.0.0.0 never no-type", b"")])
    arc_file(tmp_path, 2, [(b"http://c.example/ 10.0.0.3 20010101000000 image/gif 200 abc - 77 x.arc", http)])
    rows = {bytes(r.uri): r for r in warc.convert(spark, f"{tmp_path}/*.gz").where("warc_type <> 'warcinfo'").collect()}
    first = rows[b"http://a.example/with blank/x"]
    assert (first.date, first.ip, first.warc_type, first.block) == ("1996-10-24T12:32:00Z", "10.0.0.1", "response", http)
    assert first.payload_digest == hashlib.sha1(b"\xff\xfe binary \n\n").hexdigest()
    dns = rows[b"dns:a.example"]
    assert (dns.warc_type, dns.content_type, dns.date) == ("resource", "text/dns", "1996-10-24T12:34:56Z")
    odd = rows[b"http://b.example/"]
    assert (odd.date, odd.ip, odd.content_type, odd.payload_bytes) == ("1999-12-31T23:59:59Z", None, "application/octet-stream", 0)
    assert rows[b"http://c.example/"].date == "2001-01-01T00:00:00Z"
    fields = {r.fields["URL"]: r.fields for r in warc.read_arc(spark, f"{tmp_path}/x2.arc.gz").collect()}
    assert fields["http://c.example/"]["Checksum"] == "abc" and fields["http://c.example/"]["Offset"] == "77"
    again = f"{tmp_path}/warc"
    warc.write_warc(warc.with_revisits(warc.convert(spark, f"{tmp_path}/*.gz"), 5), again)
    read = {bytes(r.uri): r for r in warc.read_warc(spark, again).where("uri IS NOT NULL").collect()}
    kinds = sorted(read[u].warc_type for u in (b"http://a.example/with blank/x", b"http://c.example/"))
    assert kinds == ["response", "revisit"]  # equal payloads, no ids: the later archive's stays
    assert read[b"dns:a.example"].payload == b"a.example. IN A 10.0.0.1"


@pytest.mark.parametrize("head, block, tail", [
    (b"http://a 1.1.1.1 19961024123456 text/html 3\n", b"abcdef", b"\n"),    # goes on behind its length
    (b"http://a 1.1.1.1 19961024123456 text/html 30\n", b"abcdef", b"\n"),   # the file ends before
    (b"http://a 19961024123456 3\n", b"abc", b"\n"),                          # fields are missing
])
def test_wrong_archives_fail(spark, tmp_path, head, block, tail):
    importable(spark)
    arc_file(tmp_path, 1, [])
    with gzip.open(f"{tmp_path}/x1.arc.gz", "ab") as f:
        f.write(head + block + tail)
    with pytest.raises(Exception, match="goes on after|ends before|has no 5 fields"):
        warc.convert(spark, f"{tmp_path}/x1.arc.gz").collect()


def test_empty_table(spark, tmp_path):
    importable(spark)
    assert through(spark, spark.createDataFrame([], SCHEMA), tmp_path) == []


def test_blocks_of_random_lines():
    import pyarrow as pa

    rng = random.Random(7)
    for _ in range(300):
        blocks = [bytes(rng.choices(b"ab\r\n", k=rng.randint(0, 9))) for _ in range(4)]
        data = b"".join(b"%d\n" % len(b) + b + end for b, end in ((b, rng.choice([b"\n", b"\r\n"])) for b in blocks))
        lines = data.split(b"\n")[:-1]
        read = warc.Lines([pa.record_batch({"archive": ["x"] * len(lines), "line": lines})])
        assert read.next_archive()
        assert [read.block(int(read.line())) for _ in blocks] == blocks and not read.next_archive()


def test_dates():
    assert warc.iso_date("20240230000000", "19970101000000") == "1997-01-01T00:00:00Z"
    assert warc.iso_date("199702141201", "") == "1997-02-14T12:01:00Z"
    assert warc.iso_date("x", "y") == "1999-12-31T23:59:59Z"


def test_payloads_without_ids_or_headers():
    assert warc.http_parts(b"plain") == (None, b"plain")
    assert warc.http_parts(warc.http_block(None, b"x\r\n\r\ny")) == (None, b"x\r\n\r\ny")
    assert warc.http_parts(warc.http_block(7, b"")) == (7, b"")


def test_url_column_may_be_absent_of_text(spark, tmp_path):
    rows = [(1, "\n ", "p", "r", 1, "b", 2), (2, "", "q", "r", 1, "b", 2)]
    warc.write_arc(frame(spark, rows), f"{tmp_path}/arc", 1)
    uris = {bytes(r.uri) if r.uri else None for r in warc.convert(spark, f"{tmp_path}/arc").where(F.col("item").isNotNull()).collect()}
    assert uris == {b"%0A%20", None}
