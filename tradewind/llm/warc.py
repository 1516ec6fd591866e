"""WARC archives: written record by record by Spark, read back by a reader that salvages damaged files."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from hashlib import sha1

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm.shared import scratch, written

#: Payloads of at least this many bytes are stored once.
REVISIT_BYTES = 1000
#: Bytes of records after which a task begins a new archive file; a file is read by one task.
FILE_BYTES = 64_000_000
#: Parts that the rows of one payload are dealt into when they meet its first record.
PARTS = 16
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


# ---- writing ----


def records(pages: DataFrame) -> DataFrame:
    """page_id, payload digest and size, and the page that a repeated payload refers to.

    Payloads are equal if their digests are; of those, the largest page_id is the response. Only digests are
    shuffled. Maxima are aggregated where the rows lie before that; to meet its maximum, a payload's rows are dealt
    into PARTS by page_id and the maximum goes to each part, so a payload with a third of all rows is no single
    task's. Rows without a page_id, and rows that repeat the response's page_id, are responses.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    sized = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    large = sized.where(F.col("bytes") >= REVISIT_BYTES)
    first = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1")
    first = first.select("digest", "refers_to", F.explode(F.array(*(F.lit(k) for k in range(PARTS)))).alias("part"))
    dealt = large.where("page_id is not null").withColumn("part", F.pmod(F.xxhash64("page_id"), F.lit(PARTS)).cast("int"))
    return dealt.join(first, ["digest", "part"]).where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def archive(pages: DataFrame, path: str) -> None:
    """Writes a WARC/1.0 record for every row of pages (page_id, url, html) under path, as UTF-8 text files.

    A response's block is an HTTP response: status line, headers, and the html as payload. A revisit's block is the
    HTTP head alone, with the full payload's length and digest beside it. A record ends in two line ends: its own, and
    the line separator of Spark's text writer. Spark commits whole tasks, so a lost executor leaves no half file. A
    task begins a new file after FILE_BYTES, so a file holds at most that and one record more.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"))
    own = own.join(written(records(pages), "revisits"), ["page_id", "digest"], "left")
    again = F.col("refers_to").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    header = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    target = F.regexp_replace("url", r"[\x00-\x20\x7f]", "")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    heads = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.when(again, "revisit").otherwise("response"),
        header("WARC-Record-ID", urn(F.col("page_id"))), header("WARC-Date", F.lit(datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))), header("WARC-Target-URI", target),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), header("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(again, F.concat(header("WARC-Profile", F.lit(PROFILE)), header("WARC-Refers-To", urn(F.col("refers_to"))))).otherwise(""),
        header("Content-Type", F.lit("application/http; msgtype=response")), header("Content-Length", (F.octet_length(http) + F.when(again, 0).otherwise(F.col("bytes"))).cast("string")),
        F.lit("\r\n\r\n"), http, F.when(again, "").otherwise(F.col("html")), F.lit("\r\n"),
    )

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column("value")).to_numpy()) + before
            before = int(sizes[-1]) if len(sizes) else before
            yield batch.append_column("part", pa.array(sizes // FILE_BYTES, pa.int64()))

    own.select(heads.alias("value")).mapInArrow(dealt, "value string, part long").write.partitionBy("part").option("lineSep", "\r\n").text(path)


# ---- reading ----


@dataclass
class Found:
    """A record, or a quarantined gap (kind `gap`) with the reason in headers."""

    kind: str
    start: int
    end: int
    headers: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""


_version = re.compile(rb"WARC/[01]\.[0-9]+\r?\n")
_line = re.compile(rb"([A-Za-z0-9!#$%&'*+.^_`|~-]+):[ \t]*([^\r\n]*)\r?\n")
_blank = re.compile(rb"\r?\n")
_tail = re.compile(rb"\r?\n\r?\n")
_line_ends = re.compile(rb"[\r\n]*\Z")
GZIP = b"\x1f\x8b\x08"
#: A member that inflates to more can't be a value in Spark; it is reported as a gap.
MEMBER_BYTES = 2**31 - 1


def _one(data: bytes, at: int) -> Found | str:
    """The record at this place, or why there is none."""
    head = _version.match(data, at)
    if not head:
        return "no version line"
    headers, place = {}, head.end()
    while m := _line.match(data, place):
        headers[m[1].decode().lower()], place = m[2].decode("utf-8", "replace").strip(), m.end()
    blank = _blank.match(data, place)
    if not blank:
        return "bad header line"
    if not headers.get("content-length", "").isdigit():
        return "no content length"
    start, size = blank.end(), int(headers["content-length"])
    end = start + size
    if end > len(data):
        return "truncated"
    tail = _tail.match(data, end)
    if not tail and not _line_ends.match(data, end):
        return "content length disagrees with the next record"
    payload = data[start:end]
    if headers.get("content-type", "").startswith("application/http"):
        head = payload.find(b"\r\n\r\n")
        if head < 0:
            return "no end of the HTTP head"
        payload = payload[head + 4 :]
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:").lower()
    if headers.get("warc-type") != "revisit" and re.fullmatch("[0-9a-f]{40}", digest) and sha1(payload).hexdigest() != digest:
        return "payload digest disagrees"
    return Found(headers.get("warc-type", ""), at, tail.end() if tail else len(data), headers, payload)


def salvage(data: bytes) -> Iterator[Found]:
    """The records of uncompressed archive bytes, in order.

    After a failed check the reader goes to the next version line from which a record passes all checks; what lies
    between is yielded as a gap with its byte range and reason. Payloads may themselves hold version lines: only
    outside a sound record is one looked for.
    """
    at, bad, why = 0, None, ""
    while at < len(data):
        found = _one(data, at)
        if isinstance(found, Found):
            if bad is not None:
                yield Found("gap", bad, at, {"reason": why})
                bad = None
            yield found
            at = found.end
            continue
        if bad is None:
            bad, why = at, found
        following = _version.search(data, at + 1)
        at = following.start() if following else len(data)
    if bad is not None and data[bad:].strip(b"\r\n"):
        yield Found("gap", bad, len(data), {"reason": why})


def _inflated(data: bytes, at: int) -> tuple[bytes, int] | None:
    """(content, end) of the gzip member at this place, read in steps so that no rest of the file is copied; None if damaged."""
    view, d, out, size = memoryview(data), zlib.decompressobj(31), [], 0
    try:
        while not d.eof:
            if at >= len(data) or size > MEMBER_BYTES:
                return None
            part = d.decompress(view[at : at + 65536], MEMBER_BYTES + 1 - size)
            at += min(65536, len(data) - at) - len(d.unused_data) - len(d.unconsumed_tail)
            out.append(part)
            size += len(part)
    except zlib.error:
        return None
    return b"".join(out), at


def members(data: bytes) -> Iterator[tuple[int, int, bytes | None]]:
    """(start, end, content) of each gzip member; content None for a damaged range before the next sound member."""
    at, bad = 0, None
    while at < len(data):
        found = _inflated(data, at) if data.startswith(GZIP, at) else None
        if found is not None:
            if bad is not None:
                yield bad, at, None
                bad = None
            content, end = found
            yield at, end, content
            at = end
            continue
        bad = at if bad is None else bad
        at = data.find(GZIP, at + 1)
        at = len(data) if at < 0 else at
    if bad is not None:
        yield bad, len(data), None


def read_archive(data: bytes) -> Iterator[Found]:
    """Records and gaps of one file, plain or of gzip members; places are of the file, in gzip those of the member."""
    if not data.startswith(GZIP):
        yield from salvage(data)
        return
    for start, end, content in members(data):
        if content is None:
            yield Found("gap", start, end, {"reason": "damaged gzip member"})
            continue
        for found in salvage(content):
            yield Found(found.kind, start, end, found.headers, found.payload)


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, kind (response, revisit, other WARC types, or gap), start, end, record_id, refers_to, digest, length, reason, payload.

    Every file is read whole by one task; the writer bounds the files. length and digest are the full payload's:
    computed from a payload that is there, and a revisit's headers otherwise. An empty folder gives an empty result.
    """
    schema = "file string, kind string, start long, end long, record_id string, refers_to string, uri string, digest string, length long, reason string, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                out, size = [], 0
                for f in read_archive(content.as_buffer().to_pybytes()):
                    held = f.kind not in ("revisit", "gap")
                    digest = sha1(f.payload).hexdigest() if held else f.headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    length = len(f.payload) if held else int(x) if (x := f.headers.get("x-payload-length", "")).isdigit() else None
                    out.append((name, f.kind, f.start, f.end, f.headers.get("warc-record-id"), f.headers.get("warc-refers-to"), f.headers.get("warc-target-uri"), digest, length, f.headers.get("reason"), f.payload if held else None))
                    size += len(f.payload)
                    if size > 8_000_000:
                        yield _batch(out)
                        out, size = [], 0
                if out:
                    yield _batch(out)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    text, long = pa.string(), pa.int64()
    kinds = (text, text, long, long, text, text, text, text, long, text, pa.binary())
    names = ("file", "kind", "start", "end", "record_id", "refers_to", "uri", "digest", "length", "reason", "payload")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as read back from archives just written.

    A null html is an empty payload; repeated rows are repeated records; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    archive(pages, path)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, 'page:(-?[0-9]+)', 1) as long)")
    return read(spark, path).where("kind in ('response', 'revisit')").select(number("record_id").alias("page_id"), F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), number("refers_to").alias("refers_to"))
