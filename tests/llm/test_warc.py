import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from zonalpanel.llm import warc

PAGE = "page_id long, url string, html string, payload string, sha1 string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], PAGE)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


ROWS = [
    (5, "http://a/ b\r\n", "<p>same</p>"),
    (3, "http://b", "<p>same</p>"),
    (9, None, "<p>same</p>"),
    (None, "http://n", "<p>same</p>"),
    (1, "http://c", None),
    (2, "http://d", ""),
    (7, "http://e", "é漢" * 5000 + "\r\n\r\nWARC/1.1\r\n0\r\n\r\n"),
    (8, "http://f", "é漢" * 5000 + "\r\n\r\nWARC/1.1\r\n0\r\n\r\n"),
    (11, "http://g", "long " * 40_000),
    (11, "http://g", "long " * 40_000),
    (None, None, None),
]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "archive")
    warc.write_archive(pages(spark, ROWS), path, segment_bytes=1000, chunk_bytes=333)
    return warc.read_archive(spark, path).cache()


def test_payloads_come_back(archive):
    rows = archive.where("record_type = 'response'").collect()
    assert {r.problem for r in archive.collect()} == {None}
    texts = {i: t or "" for i, _, t in ROWS if i is not None}
    assert {r.page_id: bytes(r.payload).decode() for r in rows} == {i: texts[i] for i in (1, 3, 7, 11)}
    assert sum(r.page_id == 11 for r in rows) == 2


def test_revisits_point_to_the_smallest_page(archive):
    found = sorted(
        ((r.page_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to, r.problem) for r in warc.resolved(archive).collect()),
        key=str,
    )
    expected = []
    for page, _, html in ROWS:
        first = min(i for i, _, h in ROWS if (h or "") == (html or "") and i is not None)
        size = len((html or "").encode())
        same = page == first
        expected.append((page, "response" if same else "revisit", size, digest(html), None if same else first, None))
    assert found == sorted(expected, key=str)


def test_small_payloads_are_all_responses(spark, tmp_path):
    warc.write_archive(pages(spark, ROWS), str(tmp_path / "a"), min_revisit_bytes=12)
    found = warc.resolved(warc.read_archive(spark, str(tmp_path / "a")).cache()).groupBy("record_type").count().collect()
    assert {r.record_type: r["count"] for r in found} == {"response": 10, "revisit": 1}


def test_missing_and_short_segments_are_told(spark):
    fields = "record_type string, page_id long, target_uri string, refers_to_id string, declared_digest string, origin_id string, segment_number int, total_length long, block binary"
    row = lambda origin, n, total, block: ("response", 1, None, None, None, origin, n, total, bytearray(block))
    rows = [row("ok", 2, 4, b"cd"), row("ok", 1, None, b"ab"), row("gap", 1, None, b"ab"), row("gap", 3, 6, b"ef"), row("len", 1, None, b"ab"), row("len", 2, 9, b"cd"), row("end", 1, None, b"a")]
    found = {r.record_id: (r.problem, r.block and bytes(r.block)) for r in warc.reassembled(spark.createDataFrame(rows, fields)).collect()}
    assert found == {
        "ok": (None, b"abcd"),
        "gap": ("segments are missing", None),
        "len": ("total length differs", None),
        "end": ("total length differs", None),
    }


def test_chunks():
    assert warc.unchunk(b"3;x=1\r\nabc\r\nA\r\n0123456789\r\n0\r\n\r\n") == b"abc0123456789"
    with pytest.raises(ValueError):
        warc.unchunk(b"5\r\nabc\r\n0\r\n\r\n")


def test_empty_table(spark, tmp_path):
    warc.write_archive(pages(spark, []), str(tmp_path / "e"))
    assert warc.read_archive(spark, str(tmp_path / "e")).where(F.lit(True)).count() == 0
