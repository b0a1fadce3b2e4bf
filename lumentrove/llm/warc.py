"""WARC archives with an index written first and coalesced range reads.

Writing: every task appends gzip members, one per record, to an archive of its
own in the shared folder and returns one index row per record (archive, offset,
length, URL, digest).  The index is a table that Spark commits; an attempt that
is retried or speculated writes another archive, and only the archives that
committed index rows name are ever read.  Archives roll over at
``roll_bytes``.

Reading: index rows are range-partitioned and sorted by (archive, offset), into
as many tasks as the bytes of the selected records call for; neighbouring byte ranges are joined into one read while the gap and the size
stay within bounds, so selected records cost few sequential reads and a task
holds one such range at most.

Payloads equal to an earlier page's (same SHA-256, at least ``min_revisit``
bytes) become revisit records, which carry headers only.

Defined cases: null html is an empty payload; a null or control-character URL
is written empty or percent-encoded; a null page id is written as an empty id
and read back as null; rows that repeat the smallest page id of a group are all
responses.  Extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, sizing

MIN_REVISIT = 100
ROLL_BYTES = 256 << 20
GAP_BYTES = 64 << 10
RANGE_BYTES = 8 << 20
INDEX_SCHEMA = "archive string, offset long, length long, url string, digest string, page_id long, record_type string"
RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
CRAWL_DATE = "1970-01-01T00:00:00Z"


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to names the response of a revisit."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    firsts = (
        rows.filter(F.octet_length("payload") >= min_revisit)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1 and first_id is not null")
        .select("digest", "first_id")
    )
    later = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(firsts, "digest", "left").select(
        "page_id", "url", F.when(~later | F.col("first_id").isNull(), F.col("payload")).alias("payload"), F.octet_length("payload").cast("long").alias("payload_bytes"), "digest", F.when(later, F.col("first_id")).alias("refers_to")
    )


def _clean(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def encode_record(page_id: int | None, url: str | None, payload: bytes | None, payload_bytes: int, digest: str, refers_to: int | None) -> bytes:
    """One uncompressed WARC 1.1 record; a revisit's block has HTTP headers only."""
    name = "" if page_id is None else page_id
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Target-URI: {_clean(url)}", f"WARC-Date: {CRAWL_DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is None:
        block += payload or b""
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(raw: bytes) -> dict:
    """The fields of one record; payload digest and length are taken from the payload itself where it is there."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda urn: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")) else None
    revisit = fields["WARC-Type"] == "revisit"
    declared = int(re.search(rb"Content-Length: (\d+)", http)[1])
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "payload_bytes": declared if revisit else len(payload),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest(),
        "record_type": fields["WARC-Type"],
        "refers_to": number(fields.get("WARC-Refers-To")),
        "payload": None if revisit else payload,
    }


def write_archives(records: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, level: int = 3) -> DataFrame:
    """Writes ``with_revisits`` rows below ``folder``; the committed index is returned."""
    schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, name, at = None, None, 0
        try:
            for batch in batches:
                index = []
                for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "payload_bytes", "digest", "refers_to")), strict=True):
                    page_id, url, payload, size, digest, refers_to = (x.as_py() for x in row)
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = packer.compress(encode_record(page_id, url, payload, size, digest, refers_to)) + packer.flush()
                    if out is None or at + len(member) > roll_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(member)
                    index.append((name, at, len(member), url, digest, page_id, "response" if refers_to is None else "revisit"))
                    at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), schema.types, strict=True)] if index else [pa.array([], t) for t in schema.types], schema=schema)
        finally:
            if out is not None:
                out.close()

    columns = ("page_id", "url", "payload", "payload_bytes", "digest", "refers_to")
    return scratch.materialise(records.select(*columns).mapInArrow(run, INDEX_SCHEMA), "warc-index")


def read_records(index: DataFrame, folder: str, gap_bytes: int = GAP_BYTES, range_bytes: int = RANGE_BYTES, with_payload: bool = True) -> DataFrame:
    """The records that the rows of ``index`` select, in any order."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        source, opened = None, None

        def fetch(run_of: list[tuple[str, int, int]]) -> pa.RecordBatch:
            nonlocal source, opened
            name, start = run_of[0][0], run_of[0][1]
            if opened != name:
                if source is not None:
                    source.close()
                source, opened = store.open_input_file(f"{base}/{name}"), name
            data = source.read_at(run_of[-1][1] + run_of[-1][2] - start, start)
            rows = [decode_record(zlib.decompress(memoryview(data)[o - start : o - start + n], 31)) for _, o, n in run_of]
            return pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in rows], kinds[c]) for c in names})

        near: list[tuple[str, int, int]] = []
        for batch in batches:
            for place in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if near:
                    name, offset, length = near[-1]
                    if place[0] != name or place[1] - offset - length > gap_bytes or place[1] + place[2] - near[0][1] > range_bytes:
                        yield fetch(near)
                        near = []
                near.append(place)
        if near:
            yield fetch(near)
        if source is not None:
            source.close()

    schema = ", ".join(x for x in RECORD_SCHEMA.split(", ") if x.split()[0] in names)
    places = index.select("archive", "offset", "length")
    many = sizing.tasks(index.sparkSession, places.agg(F.sum("length")).first()[0])
    return places.repartitionByRange(many, "archive", "offset").sortWithinPartitions("archive", "offset").mapInArrow(run, schema)
