"""Web archives: writing pages as WARC records, and reading segmented records back.

Archives are written by Spark's own text writer (a record ends with the two line ends that
serve as line separator), so they can go to any store that Spark writes to. Long blocks are
cut into segments: a first record and continuation records that name it as their origin.
Reading groups the segments by origin, orders them by number, verifies the total length and
takes the HTTP chunk framing off. Only segmented records and thin rows are shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled
from .words import slices

SEGMENT_BYTES = 64 << 10
CHUNK_BYTES = 16 << 10
#: An archive file has up to ``FILE_ROWS`` rows of about ``ROW_BYTES`` each.
ROW_BYTES = 2 << 20
FILE_ROWS = 8
DATE = "2024-01-01T00:00:00Z"
RECORD_END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_RECORDS = (
    "record_id string, record_type string, page_id long, target_uri string, refers_to_id string, "
    "declared_digest string, origin_id string, segment_number int, total_length long, block binary"
)
_PAYLOADS = (
    "record_id string, record_type string, page_id long, target_uri string, refers_to_id string, "
    "payload binary, payload_bytes long, payload_digest string, problem string"
)


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + RECORD_END + block


def _http(payload: bytes, chunk: int) -> bytes:
    """An HTTP response with the payload in chunked transfer framing."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    parts = [head]
    for at in range(0, len(payload), chunk):
        piece = payload[at : at + chunk]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunk(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing; extensions and trailers are skipped."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        parts.append(body[at : at + size])
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is shorter than its size")
        at += size + 2


def _uri(text: str | None) -> str | None:
    """A header value can't hold line ends or other control characters."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text) if text is not None else None


def _write(batches: Iterator[pa.RecordBatch], segment: int, chunk: int, date: str) -> Iterator[pa.RecordBatch]:
    """Rows of joined records, about ``ROW_BYTES`` each."""
    waiting: list[bytes] = []
    size = 0
    for batch in batches:
        for rows in slices(batch, "html"):
            for row in rows.to_pylist():
                payload = (row["html"] or "").encode()
                digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                revisit = row["refers_to_id"] is not None
                block = b"" if revisit else _http(payload, chunk)
                cuts = range(segment, len(block), segment)
                headers = [
                    ("WARC-Type", "revisit" if revisit else "response"),
                    ("WARC-Record-ID", f"<{row['record_id']}>"),
                    ("WARC-Date", date),
                    ("WARC-Target-URI", _uri(row["url"])),
                    ("WARC-Payload-Digest", f"sha1:{digest}"),
                    ("WARC-Profile", PROFILE if revisit else None),
                    ("WARC-Refers-To", f"<{row['refers_to_id']}>" if revisit else None),
                    ("WARC-Segment-Number", 1 if cuts else None),
                    ("X-Page-ID", row["page_id"]),
                    ("Content-Type", "application/http; msgtype=response"),
                ]
                waiting.append(_record(headers, block[:segment]))
                for number, at in enumerate(cuts, 2):
                    headers = [
                        ("WARC-Type", "continuation"),
                        ("WARC-Record-ID", f"<{row['record_id']}-{number}>"),
                        ("WARC-Date", date),
                        ("WARC-Segment-Origin-ID", f"<{row['record_id']}>"),
                        ("WARC-Segment-Number", number),
                        ("WARC-Segment-Total-Length", len(block) if at + segment >= len(block) else None),
                    ]
                    waiting.append(_record(headers, block[at : at + segment]))
                size += len(block) + 500
                if size >= ROW_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([RECORD_END.join(waiting)], pa.binary())], names=["value"])
                    waiting, size = [], 0
    if waiting:
        yield pa.RecordBatch.from_arrays([pa.array([RECORD_END.join(waiting)], pa.binary())], names=["value"])


def write_archive(
    pages: DataFrame,
    path: str,
    min_revisit_bytes: int = 0,
    segment_bytes: int = SEGMENT_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
    date: str = DATE,
) -> None:
    """Write one record per page (its segments counted as one) under ``path``.

    Needs ``page_id``, ``url`` and ``html``; other columns are ignored. The payload is the html
    in UTF-8, null being empty. Of pages with equal payloads of ``min_revisit_bytes`` or more,
    those with the smallest page_id are responses and the others revisits of it; a null page_id
    counts as larger than any. Equal rows give equal records, record id included. Null urls
    are written as empty ones; payloads of any length are cut into segments of ``segment_bytes``;
    an empty table gives an archive without records.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.col("html"))
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = rows.withColumn("sha1", F.sha1(payload)).withColumn(
        "record_id",
        F.concat(F.lit("urn:md5:"), F.md5(F.to_json(F.struct("page_id", "url", "sha1")).cast("binary"))),
    )
    repeated = (
        rows.where(F.octet_length(payload) >= min_revisit_bytes)
        .groupBy("sha1")
        .agg(F.count("*").alias("n"), F.min(F.struct(F.col("page_id").isNull(), "page_id", "record_id")).alias("first"))
        .where("n > 1")
        .select("sha1", F.col("first.page_id").alias("first_page"), F.col("first.record_id").alias("first_record"))
    )
    # written, so that Spark can split the join where one payload has very many pages
    repeated = settled(repeated, "repeated-payloads")
    revisits = ~F.col("page_id").eqNullSafe(F.col("first_page")) & F.col("first_record").isNotNull()
    linked = rows.join(repeated, "sha1", "left").select(
        "page_id", "url", "html", "sha1", "record_id", F.when(revisits, F.col("first_record")).alias("refers_to_id")
    )
    records = linked.mapInArrow(
        partial(_write, segment=segment_bytes, chunk=chunk_bytes, date=date), "value binary"
    ).select(F.col("value").cast("string").alias("value"))
    records.write.option("lineSep", RECORD_END.decode()).option("maxRecordsPerFile", FILE_ROWS).text(path)


def _parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive file."""
    at = 0
    while at < len(data):
        end = data.index(RECORD_END, at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record begins at byte {at}")
        headers = {}
        for line in lines:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        start = end + len(RECORD_END)
        at = start + int(headers["content-length"])
        yield headers, data[start:at]
        at += len(RECORD_END)


def _bare(uri: str | None) -> str | None:
    return uri.strip("<>") if uri else None


def _number(text: str | None) -> int | None:
    return int(text) if text else None


def _read(batches: Iterator[pa.RecordBatch], segmented: bool) -> Iterator[pa.RecordBatch]:
    """The records that are (or are not) segments."""
    schema = pa.schema(
        [
            *[(c, pa.string()) for c in ("record_id", "record_type")],
            ("page_id", pa.int64()),
            *[(c, pa.string()) for c in ("target_uri", "refers_to_id", "declared_digest", "origin_id")],
            ("segment_number", pa.int32()),
            ("total_length", pa.int64()),
            ("block", pa.binary()),
        ]
    )
    for batch in batches:
        for content in batch.column("content"):
            found, size = [], 0
            for headers, block in _parsed(content.as_py()):
                if ("warc-segment-number" in headers) != segmented:
                    continue
                record_id = _bare(headers["warc-record-id"])
                found.append(
                    {
                        "record_id": record_id,
                        "record_type": headers["warc-type"],
                        "page_id": _number(headers.get("x-page-id")),
                        "target_uri": headers.get("warc-target-uri"),
                        "refers_to_id": _bare(headers.get("warc-refers-to")),
                        "declared_digest": headers.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                        "origin_id": _bare(headers.get("warc-segment-origin-id")) or record_id,
                        "segment_number": _number(headers.get("warc-segment-number")),
                        "total_length": _number(headers.get("warc-segment-total-length")),
                        "block": block,
                    }
                )
                size += len(block)
                if size >= ROW_BYTES:
                    yield pa.RecordBatch.from_pylist(found, schema)
                    found, size = [], 0
            if found:
                yield pa.RecordBatch.from_pylist(found, schema)


def _payload(block: bytes) -> bytes:
    head, _, body = block.partition(RECORD_END)
    chunked = re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head.replace(b"\r", b""))
    return unchunk(body) if chunked else body


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payloads of whole blocks, checked against the declared digest."""
    names = ("record_id", "record_type", "page_id", "target_uri", "refers_to_id")
    for batch in batches:
        for rows in slices(batch, "block"):
            payloads, digests, problems = [], [], []
            for row in rows.select(["record_type", "declared_digest", "block", "problem"]).to_pylist():
                payload, digest, problem = None, None, row["problem"]
                if problem is None and row["record_type"] != "revisit":
                    try:
                        payload = _payload(row["block"])
                        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        problem = None if row["declared_digest"] in (None, digest) else "digest differs"
                    except ValueError as error:
                        problem = str(error)
                elif row["record_type"] == "revisit":
                    digest = row["declared_digest"]
                payloads.append(payload)
                digests.append(digest)
                problems.append(problem)
            yield pa.RecordBatch.from_arrays(
                [
                    *[rows.column(n) for n in names],
                    pa.array(payloads, pa.binary()),
                    pa.array([None if p is None else len(p) for p in payloads], pa.int64()),
                    pa.array(digests, pa.string()),
                    pa.array(problems, pa.string()),
                ],
                names=[*names, "payload", "payload_bytes", "payload_digest", "problem"],
            )


def reassembled(segments: DataFrame) -> DataFrame:
    """Whole records from segments: grouped by origin, ordered by number, length verified.

    A record whose segment numbers do not run from 1 without gaps, or whose blocks do not add
    up to the declared total, has a null block and says so in ``problem``. Equal copies of a
    record give as many equal rows.
    """
    names = ("record_type", "page_id", "target_uri", "refers_to_id", "declared_digest")
    once = segments.groupBy("origin_id", "segment_number").agg(
        F.count("*").alias("copies"),
        F.max("total_length").alias("total_length"),
        F.first("block").alias("block"),
        *[F.first(n).alias(n) for n in names],
    )
    head = [F.max(F.when(F.col("segment_number") == 1, F.col(n))).alias(n) for n in names]
    whole = once.groupBy("origin_id").agg(
        F.min("copies").alias("copies"),
        F.max("total_length").alias("total_length"),
        F.sort_array(F.collect_list(F.struct("segment_number", "block"))).alias("parts"),
        *head,
    )
    numbers = F.col("parts.segment_number")
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x["block"]))
    problem = F.when(numbers != F.sequence(F.lit(1), F.size("parts")), F.lit("segments are missing")).when(
        ~length.eqNullSafe(F.col("total_length")), F.lit("total length differs")
    )
    block = F.aggregate("parts", F.lit(b""), lambda all_, x: F.concat(all_, x["block"]))
    return whole.select(
        F.col("origin_id").alias("record_id"),
        *names,
        problem.alias("problem"),
        F.when(problem.isNull(), block).alias("block"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record under ``path``, with its payload.

    Returns (record_id, record_type, page_id, target_uri, refers_to_id, payload, payload_bytes,
    payload_digest, problem). Revisits have no payload of their own: see ``resolved``. Memory of
    a task follows the size of an archive file and of the longest record. Empty payloads come
    back empty, equal records as equal rows, an archive without records as no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("content")
    names = ("record_id", "record_type", "page_id", "target_uri", "refers_to_id", "declared_digest", "problem", "block")
    single = files.mapInArrow(partial(_read, segmented=False), _RECORDS).withColumn("problem", F.lit(None).cast("string"))
    parts = files.mapInArrow(partial(_read, segmented=True), _RECORDS)
    return single.select(*names).unionByName(reassembled(parts).select(*names)).mapInArrow(_decode, _PAYLOADS)


def resolved(records: DataFrame) -> DataFrame:
    """Rows of ``read_archive`` without payloads, revisits with the size and page of what they repeat.

    Returns (page_id, record_type, payload_bytes, payload_digest, refers_to, problem). It uses
    ``records`` twice, so let them be thin or written.
    """
    origin = (
        records.where("record_type = 'response'")
        .groupBy("record_id")
        .agg(F.first("page_id").alias("_page"), F.first("payload_bytes").alias("_bytes"), F.first("payload_digest").alias("_digest"))
        .withColumnRenamed("record_id", "refers_to_id")
    )
    origin = settled(origin, "responses")
    joined = records.join(origin, "refers_to_id", "left")
    lost = (F.col("record_type") == "revisit") & ~F.col("payload_digest").eqNullSafe(F.col("_digest"))
    return joined.select(
        "page_id",
        "record_type",
        F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"),
        "payload_digest",
        F.col("_page").alias("refers_to"),
        F.when(lost, F.lit("what it repeats is missing or differs")).otherwise(F.col("problem")).alias("problem"),
    )
