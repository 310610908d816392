import base64
import gzip
import hashlib
import os
import zlib

from lodemine.llm import archives
from lodemine.session import scratch_path

F = archives.F


def sha(data):
    return hashlib.sha1(data).hexdigest()


def test_parses_both_versions_by_field_names_and_declared_lengths():
    inner = b"HTTP/1.0 200 OK\r\n\r\nhttp://x 1.2.3.4 20010101000000 text/html 5\n"
    for version in (1, 2):
        data = archives.arc_version_block(version, "n", "19990101000000") + b"\n"
        data += archives.arc_record(version, "http://a/", "19990101120000", inner) + b"\n\n" + archives.arc_record(version, "dns:b", "1999", b"") + b"\n"
        data += archives.arc_record(version, "http://c/", "19990101120000", b"0123456789")[:-3]
        got = list(archives.arc_records(data))
        assert [(f["URL"], f["Archive-date"], c, ok) for _, f, c, ok in got] == [
            ("http://a/", "19990101120000", inner, True),
            ("dns:b", "1999", b"", True),
            ("http://c/", "19990101120000", b"0123456", False),
        ]
        assert [data[o:].startswith(f["URL"].encode()) for o, f, _, _ in got] == [True] * 3
    assert archives.plain(gzip.compress(b"ab") + gzip.compress(b"c")) == b"abc" and archives.plain(b"x") == b"x" and archives.plain(gzip.compress(b"ab") + b"\n\n") == b"ab"
    assert list(archives.arc_records(b"")) == []


def test_files_are_bounded_and_have_a_member_per_record():
    records = [b"a" * 10, b"b" * 10, b"c" * 25, b"", b"d" * 5, b"e", b"f", os.urandom(1000)]
    files = list(archives.archive_files(records, per_file=3, per_bytes=30))
    assert [archives.plain(f) for f in files] == [b"".join(x) for x in (records[:2], records[2:5], records[5:7], records[7:])]
    assert all(f.endswith(b"\0") for f in files) and list(archives.archive_files([], 3, 30)) == []
    at = len(archives.member(records[2])) + len(archives.member(records[3]))
    assert zlib.decompressobj(31).decompress(files[1][at:]) == records[4]  # by its offset alone
    headed = list(archives.archive_files([b"x", b"y", b"z"], 2, 30, lambda k: b"%d:" % k))
    assert [archives.plain(f) for f in headed] == [b"0:xy", b"1:z"]
    huge = b"0123456789abcdef" * (17 << 16)  # its length has a last byte other than zero
    assert archives.member(huge)[-1] == 0 and archives.plain(archives.member(huge) + archives.member(b"next")) == huge + b"next"


def through(spark, pages, per_file=500):
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    archives.write_arc(pages, arc, per_file=per_file)
    archives.convert(spark, arc, warc, per_file=per_file)
    return arc, warc


PAGES = "page_id bigint, url string, html string, record_id string"


def test_round_trip_with_revisits(spark):
    big, large = "é" * 600, "WARC/1.0\r\n\r\n" + "x" * 2000 + "\r\n\r\nWARC/1.0\r\n"
    rows = [(1, "http://a b/\n", big, "z"), (5, None, big, "z"), (3, "u", big, None), (7, "u", "short", "z"), (8, "u", "short", "z"), (9, "u", None, "z"), (10, "", "", "z")]
    rows += [(20 + i, f"http://h/{i}", large, "z") for i in range(20)] + [(None, None, large, None), (39, "again", large, "z"), (50, "u", "y" * 3_000_000, "z")]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    arc, warc = through(spark, pages, per_file=4)
    records = archives.read_warc(spark, warc).collect()
    assert len(records) == len(rows) and len({r["record_id"] for r in records}) == len(rows)
    by_id = {r["record_id"]: r for r in records}
    want = sorted((str(i), len((h or "").encode()), sha((h or "").encode())) for i, _, h, _ in rows)
    assert sorted((str(r["key"]), r["payload_bytes"], r["payload_digest"]) for r in records) == want
    for r in records:
        if r["kind"] == "revisit":
            first = by_id[r["refers_to"]]
            assert first["kind"] == "response" and first["payload_digest"] == r["payload_digest"] and first["key"] == (5 if r["key"] in (1, 3) else 39)
    assert sum(r["kind"] == "revisit" for r in records) == 2 + 21


def test_synthesised_records(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>", "")], PAGES)
    arc, warc = through(spark, pages)
    content = archives.plain(spark.read.format("binaryFile").load(warc).where("length > 0").orderBy("length", ascending=False).first()["content"])
    (headers, block), = archives.warc_records(content)
    assert content.startswith(b"WARC/1.0\r\n") and content.endswith(block + b"\r\n\r\n")
    assert headers["warc-type"] == "response" and headers["warc-date"] == "2020-01-01T00:00:00Z" and headers["warc-target-uri"] == "http://a/"
    assert headers["warc-record-id"].startswith("<urn:uuid:") and int(headers["content-length"]) == len(block)
    for name, data in (("warc-block-digest", block), ("warc-payload-digest", b"<p>")):
        assert headers[name] == "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_empty(spark):
    arc, warc = through(spark, spark.createDataFrame([], PAGES))
    assert archives.read_warc(spark, warc).count() == 0
