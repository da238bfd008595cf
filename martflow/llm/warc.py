"""WARC archives with an index made while writing, and reads by byte range.

Writing: every page becomes one WARC/1.1 record, a gzip member of its own.  Of pages
with equal payloads those with the largest ``page_id`` are ``response`` records with
the payload; the others are ``revisit`` records that name it.  A task writes files of a
bounded size and returns one index row for each record: file, offset, length, URL,
digest.  The index is what counts: files of attempts that were lost are in no index.

Reading: records are chosen from the index alone.  Their byte ranges are sorted by file
and offset, ranges with small gaps are joined into reads of a bounded size, and every
payload is checked against its digest.

Cases: a null ``html`` is an empty payload; a null ``page_id`` counts as smaller than any
other and is written as no id; if all ids of a payload are null, or rows repeat the
largest id, each of those rows is a full response; a null URL is left out, and control
characters in it are percent-encoded; an empty table gives no record.  Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from martflow.llm.common import CONTROL, bare_base32, copies, folder, fresh_name, slices, staged, store, tasks

INDEX = (
    "page_id long, url string, payload_digest string, payload_bytes long, record_type string, "
    "file string, offset long, length long"
)
RECORDS = (
    "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, "
    "html string, file string, offset long, length long"
)
_CONTROL = re.compile(CONTROL)
_NO_ID = "urn:page:none"


def _uri(page_id) -> str:
    return f"<{_NO_ID}>" if page_id is None else f"<urn:page:{page_id}>"


def _page_id(uri: str | None) -> int | None:
    if uri is None or uri == f"<{_NO_ID}>":
        return None
    return int(uri.rsplit(":", 1)[1].rstrip(">"))


def record(page_id, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record, as bytes before compression.  With ``refers_to`` a revisit: headers
    of the full payload, but without it."""
    digest = bare_base32(hashlib.sha1(payload).digest())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_uri(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {_uri(refers_to)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one record and its payload (None for a revisit).  Raises if the
    payload does not have the digest of its header."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or bare_base32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return {
        "page_id": _page_id(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "record_type": kind,
        "refers_to": _page_id(fields.get("WARC-Refers-To")),
        "payload_digest": digest,
        "payload_bytes": size,
        "payload": payload if kind == "response" else None,
    }


_INDEX = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("record_type", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
)


def write_archives(pages: DataFrame, file_bytes: int = 64 << 20, level: int = 3) -> DataFrame:
    """Write all pages; returns the index.  Pages are not shuffled: only the digests of
    payloads that occur twice or more are joined to them."""
    target = folder(pages.sparkSession, "warc")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    key = F.unhex(F.sha1(F.col("html").cast("binary")))
    same = copies(rows, key, "page_id", largest=True, label="payloads")
    rows = rows.join(same, key == F.col("_key"), "left").select(
        "page_id",
        "url",
        "html",
        F.when(F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("refers_to"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = store(target)
        fs.create_dir(path, recursive=True)
        part, out, name, at = TaskContext.get().partitionId(), None, "", 0
        try:
            for batch in slices(batches, "html"):
                found = {k: [] for k in _INDEX.names}
                for page_id, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                    payload = html.encode()
                    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                    data = pack.compress(record(page_id, url, payload, refers)) + pack.flush()
                    if out is not None and at + len(data) > file_bytes:
                        out.close()
                        out = None
                    if out is None:
                        name, at = f"{path}/{fresh_name(f'pages-{part:05d}', '.warc.gz')}", 0
                        out = fs.open_output_stream(name, compression=None)
                    out.write(data)
                    digest = bare_base32(hashlib.sha1(payload).digest())
                    kind = "response" if refers is None else "revisit"
                    for k, v in zip(found, (page_id, url, digest, len(payload), kind, name, at, len(data)), strict=True):
                        found[k].append(v)
                    at += len(data)
                yield pa.RecordBatch.from_pydict(found, schema=_INDEX)
        finally:
            if out is not None:
                out.close()

    return staged(rows.mapInArrow(write, INDEX), "index")


_RECORDS = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("html", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
)


def read_records(index: DataFrame, where: str, read_bytes: int = 8 << 20, gap_bytes: int = 64 << 10, text: bool = True) -> DataFrame:
    """The records of the index rows given (all, or a selection), read back by byte
    range.  ``where``: the folder of the archives, which names the file system;
    ``text``: whether to return the payloads as ``html``.

    A read covers neighbouring records of a file: a new one begins after a gap of more
    than ``gap_bytes`` or when ``read_bytes`` are full.  A file's records are bounded by
    its size, so the ordering by file is bounded as well."""
    order = Window.partitionBy("file").orderBy("offset")
    ends = F.col("offset") + F.col("length")
    spans = (
        index.select("file", "offset", "length")
        .withColumn("_gap", F.col("offset") - F.coalesce(F.lag(ends).over(order), F.col("offset")))
        .withColumn("_run", F.sum((F.col("_gap") > gap_bytes).cast("long")).over(order))
        .withColumn("_read", F.floor(F.col("offset") / read_bytes))
        .select("file", "offset", "length", "_run", "_read")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = store(where)

        def parsed(spans: list[tuple[str, int, int]]) -> pa.RecordBatch:
            name, first, last = spans[0][0], spans[0][1], spans[-1][1] + spans[-1][2]
            with fs.open_input_file(name) as f:
                f.seek(first)
                data = f.read(last - first)
            rows = []
            for _, at, n in spans:
                row = parse(zlib.decompress(data[at - first : at - first + n], 31))
                payload = row.pop("payload")
                row |= {"html": payload.decode() if text and payload is not None else None, "file": name, "offset": at, "length": n}
                rows.append(row)
            return pa.RecordBatch.from_pylist(rows, schema=_RECORDS)

        held, group = [], None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length", "_run", "_read")), strict=True):
                if held and (row[0], row[3], row[4]) != group:
                    yield parsed(held)
                    held = []
                group = (row[0], row[3], row[4])
                held.append(row[:3])
        if held:
            yield parsed(held)

    return (
        spans.repartition(tasks(index.sparkSession), "file", "_run", "_read").sortWithinPartitions("file", "_run", "_read", "offset").mapInArrow(read, RECORDS)
    )
