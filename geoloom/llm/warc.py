"""WARC archives: records as gzip members, revisits for repeated payloads, and a splittable reader.

Writer tasks stream members into files of the shared folder. For reading, files are cut into byte ranges; a task scans
its range for the gzip magic, validates each candidate by decoding the member's beginning as a WARC header, and owns
the records that start inside its range, reading past the end to finish the last one.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, shared_dir, small_batches

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 16 << 20
FILE_ROWS = 20_000
_HEAD = re.compile(rb"WARC/1\.[01]\r\n")

RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _from_urn(urn: str) -> int | None:
    tail = urn.strip("<>").rpartition(":")[2]
    return None if tail == "none" else int(tail)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, record_type: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member. A revisit has no payload, but its full digest and size."""
    body = b"" if record_type == "revisit" else payload
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    lines = [f"WARC-Type: {record_type}", f"WARC-Record-ID: {_urn(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"X-Payload-Length: {len(payload)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=_URL_SAFE)}")
    if record_type == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}"]
    raw = ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + http + body + b"\r\n\r\n"
    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


_URL_SAFE = "".join(chr(c) for c in range(33, 127) if chr(c) != "%")


def parse_record(raw: bytes) -> dict:
    """The fields of a decoded record; a response's size and digest are computed from its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    block = rest[: int(fields["Content-Length"])]
    if len(block) < int(fields["Content-Length"]):
        raise ValueError(f"record {fields.get('WARC-Record-ID')} is cut short")
    kind, declared = fields["WARC-Type"], fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    payload = block.partition(b"\r\n\r\n")[2]
    if kind == "revisit":
        size, digest = int(fields["X-Payload-Length"]), declared
    else:
        size, digest = len(payload), sha1_base32(payload)
        if declared and declared != digest:
            raise ValueError(f"record {fields.get('WARC-Record-ID')}: its payload doesn't match its digest")
    uri = fields.get("WARC-Target-URI")
    return {
        "page_id": _from_urn(fields["WARC-Record-ID"]), "url": None if uri is None else unquote(uri), "payload": payload, "payload_bytes": size, "payload_digest": digest,
        "record_type": kind, "refers_to": _from_urn(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
    }


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _inflate(f, start: int, most: int | None = None) -> tuple[bytes, int] | None:
    """The member at `start` (its first `most` bytes, if given) and its end; None if it isn't a whole gzip member."""
    unpack, out, at, size = zlib.decompressobj(31), [], start, 0
    f.seek(start)
    try:
        while not unpack.eof:
            chunk = f.read(512 if most else 1 << 18)
            if not chunk:
                return None
            out.append(unpack.decompress(chunk))
            at += len(chunk)
            size += len(out[-1])
            if most and size >= most:
                return b"".join(out), at
    except zlib.error:
        return None
    return b"".join(out), at - len(unpack.unused_data)


def scan_range(f, start: int, end: int):
    """(offset, raw record) of the records that start in [start, end) of an open file."""
    at = start
    while at < end:
        f.seek(at)
        window = f.read(min(1 << 20, end - at) + len(MAGIC) - 1)
        hit = window.find(MAGIC)
        if hit < 0:
            at += max(1, len(window) - len(MAGIC) + 1)
            continue
        at += hit
        if at >= end:
            return
        head = _inflate(f, at, 10)
        if head is None or not _HEAD.match(head[0]):
            at += 1  # the magic inside of compressed data
            continue
        whole = _inflate(f, at)
        if whole is None:
            raise ValueError(f"the gzip member at {at} is cut short or damaged")
        yield at, whole[0]
        at = whole[1]


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, record_type and refers_to: of equal payloads the smallest page_id is the response.

    A null html is an empty payload. Of repeated rows with one page_id all are responses. Null page_ids come last.
    Payloads are compared by SHA-1 in rows of an id and a digest; the pages themselves are joined by id and digest, so
    a payload that many pages have doesn't meet in one task.
    """
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    keys = own.select(F.unhex(F.sha1(F.col("html").cast("binary"))).alias("sha"), "page_id").distinct()
    first = keys.groupBy("sha").agg(F.min("page_id").alias("first"))
    later = keys.join(first.hint("merge"), "sha").where(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "sha", "first")
    own = own.withColumn("_sha", F.unhex(F.sha1(F.col("html").cast("binary")))).alias("o")
    joined = own.join(later.alias("l").hint("merge"), (F.col("o._sha") == F.col("l.sha")) & F.col("o.page_id").eqNullSafe(F.col("l.page_id")), "left")
    revisit = F.col("l.first").isNotNull()
    return joined.select("o.page_id", "o.url", "o.html", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.col("l.first").alias("refers_to"))


def write_archives(spark: SparkSession, records: DataFrame, folder: str, file_rows: int = FILE_ROWS) -> DataFrame:
    """Write records (see with_revisits) as <folder>/part-*.warc.gz; file, records and bytes of each file.

    Each task writes under a name of its attempt and renames at its end, so a retried task leaves one whole file; the
    returned table, written once, names the files that count.
    """
    small_batches(spark)
    _filesystem(folder)  # an unknown scheme is an error before any work

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        system, base = _filesystem(folder)
        system.create_dir(base, recursive=True)
        number, out, name, rows, size = 0, None, "", 0, 0

        def close():
            out.close()
            system.move(f"{base}/{name}.part", f"{base}/{name}")
            return name, rows, size

        import pyarrow as pa

        def told(done):
            return pa.RecordBatch.from_pylist([dict(zip(("file", "records", "bytes"), (f"{folder}/{done[0]}", *done[1:])))], schema=pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            payloads = batch.column("html").cast(pa.large_binary()).to_pylist()
            for page_id, url, payload, kind, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url")), payloads, *(batch.column(c).to_pylist() for c in ("record_type", "refers_to"))):
                if out is None:
                    name, rows, size = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{base}/{name}.part", compression=None)
                    number += 1
                member = record_bytes(page_id, url, payload, kind, refers)
                out.write(member)
                rows, size = rows + 1, size + len(member)
                if rows >= file_rows:
                    yield told(close())
                    out = None
        if out is not None:
            yield told(close())

    return materialize(spark, records.select("page_id", "url", "html", "record_type", "refers_to").mapInArrow(run, "file string, records long, bytes long"))


def read_archives(spark: SparkSession, files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All records of `files` (file, bytes), one task for each byte range: RECORD columns."""
    ranges = files.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"), "bytes")
    ranges = ranges.where("bytes > 0").select("file", "start", F.least(F.col("start") + range_bytes, F.col("bytes")).alias("end"))
    n = max(1, ranges.count())
    names = [c.split()[0] for c in RECORD.split(", ")]

    def run(batches):
        import pyarrow as pa

        types = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in RECORD.split(", ")])
        for batch in batches:
            for file, start, end in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "end"))):
                system, path = _filesystem(file)
                rows = []
                with system.open_input_file(path) as f:
                    for offset, raw in scan_range(f, start, end):
                        rows.append({k: v for k, v in parse_record(raw).items() if k != "payload"} | {"file": file, "offset": offset})
                        if len(rows) >= 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema=types)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=types)

    return ranges.repartition(n, "file", "start").mapInArrow(run, RECORD).select(*names)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = with_revisits(read(spark, sf_dir, "pages"))
    files = write_archives(spark, records, shared_dir(spark))
    return read_archives(spark, files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
h AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS s, first FROM p JOIN f USING (html))
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(s, 5 * (i // 4) + 1, 5))::INT >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM h
"""
