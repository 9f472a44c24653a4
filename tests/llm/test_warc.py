"""The archive: records byte by byte, revisits, odd rows, damage."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import warc

ROWS = [(3, "http://a/", "x" * 100), (1, "http://b/", "x" * 100), (2, None, "x" * 99), (4, "http://c/", "x" * 99), (5, "e", None), (6, "e", ""),
        (None, "n", "y" * 200), (7, "é\r\nWARC-Type: fake", "y" * 200), (8, "h", "line\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\n" * 9), (1, "http://b/", "x" * 100),
        (9, "z", "ü" * 60), (10, "z", "ü" * 60), (None, "only", "q" * 300), (None, "only", "q" * 300), (11, "big", "html " * 400_000)]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("warc") / "a")
    df = spark.createDataFrame([(*r, "clash", 0) for r in ROWS], "page_id long, url string, html string, digest string, bytes int").repartition(4)
    warc.write_archive(df, folder)
    return folder


def expected():
    first = {}
    for i, _, html in ROWS:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, _, html in ROWS:
        body = (html or "").encode()
        smallest = first.get(html or "")
        revisit = len(body) >= 100 and smallest is not None and i != smallest
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", smallest if revisit else None))
    return sorted(out, key=str)


def test_index(spark, archive):
    rows = warc.read_index(spark, archive).select("record_id", "payload_bytes", "digest", "record_type", "refers_to").collect()
    assert sorted((tuple(r) for r in rows), key=str) == expected()


def test_payloads_are_stored_once(spark, archive):
    stored = warc.read_payloads(spark, archive).collect()
    assert collections.Counter(bytes(r.payload) for r in stored) == collections.Counter({(h or "").encode() for *_, h in ROWS})


def test_records_are_exact(spark, archive):
    texts = {(i, u): (h or "").encode() for i, u, h in ROWS}
    for r in warc.read_records(spark, archive).collect():
        header, block = bytes(r.record).split(b"\r\n\r\n", 1)
        lines = header.decode().split("\r\n")
        assert lines[0] == "WARC/1.1" and header.decode() + "\r\n\r\n" == r.header
        fields = dict(x.split(": ", 1) for x in lines[1:])
        assert len(fields) == len(lines) - 1 and fields["WARC-Type"] == r.record_type
        body = b"" if r.record_type == "revisit" else bytes(r.payload)
        assert block == body + b"\r\n\r\n" and int(fields["Content-Length"]) == len(body)
        assert bytes(r.payload) in {p for (i, _), p in texts.items() if i == r.record_id}
        assert fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(bytes(r.payload)).hexdigest()


def test_damage_is_found(spark, archive, tmp_path):
    damaged = str(tmp_path / "d")
    payloads = spark.read.parquet(f"{archive}/payloads")
    payloads.withColumn("payload", F.concat("payload", F.lit(b"!"))).write.parquet(f"{damaged}/payloads")
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_payloads(spark, damaged).collect()


def test_no_pages(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archive(empty, str(tmp_path / "e"))
    assert warc.read_records(spark, str(tmp_path / "e")).count() == 0
