"""WARC archives: round trips, and the stream read by a parser of its own."""

import hashlib
import uuid
from collections import Counter

import pytest

from clickloom.llm import warc


def plain_records(stream):
    """(WARC fields, HTTP fields, payload) of each record of a WARC 1.1 stream."""
    at = 0
    while at < len(stream):
        end = stream.index(b"\r\n\r\n", at)
        version, *lines = stream[at:end].decode().split("\r\n")
        assert version == "WARC/1.1"
        fields = dict(x.split(": ", 1) for x in lines)
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "WARC-Target-URI"} <= fields.keys()
        block = stream[end + 4 : end + 4 + int(fields["Content-Length"])]
        at = end + 4 + len(block)
        assert stream[at : at + 4] == b"\r\n\r\n"
        at += 4
        head, payload = block.split(b"\r\n\r\n", 1)
        status, *lines = head.decode().split("\r\n")
        assert status == "HTTP/1.1 200 OK"
        yield fields, dict(x.split(": ", 1) for x in lines), payload


def test_warc_round_trip(spark):
    html = ["<p>" + "a" * 150, "<p>" + "a" * 150, "short", "short", None, "é" * 70_000, "é" * 70_000, "x\r\n\r\nWARC/1.1\r\n" * 9]
    rows = [(10 - i, f"http://h/{i}", h, "clash") for i, h in enumerate(html)] + [(None, None, html[0], "clash"), (9, "again", html[1], "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    chunks = warc.write_records(warc.classify(pages), chunk=1000)
    got = warc.read_records(warc.staged(chunks, "warc")).collect()
    first = {}
    for page, _, h, _ in rows:
        data = (h or "").encode()
        if page is not None and len(data) >= 100:
            first[data] = min(page, first.get(data, page))
    expected = Counter()
    for page, _, h, _ in rows:
        data = (h or "").encode()
        leader = first.get(data) if page is not None and len(data) >= 100 else None
        revisit = leader is not None and leader < page
        expected[page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", leader if revisit else None] += 1
    assert Counter(tuple(r) for r in got) == expected
    assert chunks.where("length(data) > 2000").count() == 0
    records = {}
    for r in chunks.orderBy("record_id", "chunk").collect():
        records.setdefault(r["record_id"], b"")
        records[r["record_id"]] += bytes(r["data"])
    stream = b"".join(records.values())
    found = list(plain_records(stream))
    ids = {f["WARC-Record-ID"] for f, _, _ in found}
    assert len(found) == len(ids) == len(rows) and all(uuid.UUID(i[10:-1]).version == 8 for i in ids)
    for fields, http, payload in found:
        assert fields["Content-Type"] == "application/http; msgtype=response"
        if fields["WARC-Type"] == "revisit":
            assert payload == b"" and fields["WARC-Refers-To"] in ids and int(http["Content-Length"]) >= 100
        else:
            assert len(payload) == int(http["Content-Length"]) and fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(payload).hexdigest()


def test_warc_of_nothing(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string, digest string")
    assert warc.archive_pages(empty).count() == 0


def test_warc_finds_damage(spark):
    pages = spark.createDataFrame([(1, "u", "z" * 5000)], "page_id long, url string, html string")
    chunks = warc.staged(warc.write_records(warc.classify(pages), chunk=1000), "warc")
    with pytest.raises(Exception, match="damaged or missing"):
        warc.read_records(chunks.where("chunk <> 2")).collect()


def test_payload_on_a_third_of_the_pages(spark):
    rows = [(i, f"u{i}", "h" * 200 if i % 3 == 0 else f"{i // 2 * 2:0200d}") for i in range(6000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r["page_id"]: r for r in warc.archive_pages(pages).collect()}
    first = {}
    for page, _, h in rows:
        first.setdefault(h, page)
    assert len(got) == len(rows)
    for page, _, h in rows:
        assert got[page]["refers_to"] == (None if first[h] == page else first[h])


def test_records_keep_their_ids(spark):
    pages = spark.createDataFrame([(i % 4, "u", "p" * 150) for i in range(8)], "page_id long, url string, html string")
    found = warc.classify(pages)
    ids = {r["record_id"] for r in found.collect()}
    again = found.repartition(7)  # a plan of other parts reads the same written ids
    assert {r["record_id"] for r in again.collect()} == ids and len(ids) == 8
    assert {r["refers_record"] for r in again.collect()} - {None} <= ids
