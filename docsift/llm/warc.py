"""WARC archives: segmented records written and reassembled, with revisits for equal payloads."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.shared import materialize, new_path, open_fs

#: A record's block beyond so many bytes goes on in continuation records.
SEGMENT_BYTES = 8192
#: HTTP chunk size of the transfer framing.
CHUNK_BYTES = 4096
#: An archive file is closed beyond so many bytes.
FILE_BYTES = 256 << 20
DATE = "2020-01-01T00:00:00Z"
CRLF = b"\r\n"
READ_SCHEMA = "origin string, number int, total long, headers map<string,string>, block binary"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        parts += [b"%x\r\n" % len(part), part, CRLF]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are skipped. ValueError if cut short."""
    parts, at = [], 0
    while True:
        eol = body.find(b"\n", at)
        if eol < 0:
            raise ValueError("chunk size missing")
        size = int(body[at:eol].split(b";")[0].strip(), 16)
        at = eol + 1
        if not size:
            return b"".join(parts)
        if at + size > len(body):
            raise ValueError("chunk cut short")
        parts.append(body[at : at + size])
        at += size
        at += 2 if body[at : at + 2] == CRLF else 1 if body[at : at + 1] == b"\n" else 0


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def one_line(text: str | None) -> str:
    return " ".join((text or "").split())


@dataclass
class Page:
    page_id: int | None
    url: str | None
    payload: bytes
    refers_to: int | None  # the response's page, if this record revisits it


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + CRLF + CRLF + block + CRLF + CRLF


def records_of(page: Page, segment: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The page's WARC records: a revisit with HTTP headers only, or a response with its continuations."""
    me = f"<urn:uuid:{uuid.uuid4()}>"
    mine = lambda p: "urn:page:" + ("" if p is None else str(p))
    http = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8"]
    if where := one_line(page.url):
        http.append(b"Content-Location: " + where.encode())
    common = [("WARC-Record-ID", me), ("WARC-Date", DATE), ("WARC-Target-URI", mine(page.page_id)), ("WARC-Payload-Digest", "sha1:" + digest(page.payload)), ("Content-Type", "application/http; msgtype=response")]
    if page.refers_to is not None:
        head = CRLF.join([*http, b"Content-Length: %d" % len(page.payload)]) + CRLF + CRLF
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield record("revisit", [*common, ("WARC-Profile", profile), ("WARC-Refers-To-Target-URI", mine(page.refers_to)), ("WARC-Refers-To-Date", DATE)], head)
        return
    block = CRLF.join([*http, b"Transfer-Encoding: chunked"]) + CRLF + CRLF + chunked(page.payload)
    if len(block) <= segment:
        yield record("response", common, block)
        return
    yield record("response", [*common, ("WARC-Segment-Number", "1")], block[:segment])
    for n, at in enumerate(range(segment, len(block), segment), 2):
        fields = [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("WARC-Target-URI", mine(page.page_id)), ("WARC-Segment-Number", str(n)), ("WARC-Segment-Origin-ID", me)]
        if at + segment >= len(block):
            fields.append(("WARC-Segment-Total-Length", str(len(block))))
        yield record("continuation", fields, block[at : at + segment])


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of an open, decompressed archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("record cut short")
        yield headers, block


def with_roles(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, refers_to: of equal payloads the largest page_id is the response.

    Only payloads that occur more than once are joined, through written tables on both
    sides, so that a payload held by a third of all pages is split over tasks.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    groups = keyed.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("kept"))
    groups = materialize(groups.where("n > 1").select("sha", "kept"), "warc-groups")
    refers = F.when(F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept"))
    return keyed.join(groups, "sha", "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def write_archives(pages: DataFrame) -> DataFrame:
    """Write a WARC record per page; returns the manifest (a written table): path, records, bytes.

    Input: page_id, url, payload, refers_to. Files are gzipped record by record and named by
    attempt; only files in the manifest count, so a retried task leaves no trace.
    """
    root = new_path(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_fs(root)
        fs.create_dir(folder, recursive=True)
        out, name, count, size = None, "", 0, 0
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "refers_to")]
            for values in zip(*columns, strict=True):
                page = Page(*(v.as_py() for v in values))
                if out is None:
                    name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    out, count, size = fs.open_output_stream(f"{folder}/{name}", compression=None), 0, 0
                for data in records_of(page):
                    squeezer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    member = squeezer.compress(data) + squeezer.flush()
                    out.write(member)
                    count, size = count + 1, size + len(member)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
                    yield pa.record_batch({"path": [f"{root}/{name}"], "records": [count], "bytes": [size]})
        if out is not None:
            out.close()
            yield pa.record_batch({"path": [f"{root}/{name}"], "records": [count], "bytes": [size]})

    return materialize(pages.mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """READ_SCHEMA rows of all archives: one per record, each file read as a stream by one task."""
    files = manifest.select("path").repartition(max(1, manifest.count()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, name = open_fs(path)
                with fs.open_input_stream(name, compression=None) as raw, gzip.open(io.BufferedReader(raw, 1 << 20)) as stream:
                    for headers, block in read_records(stream):
                        number = int(headers.get("warc-segment-number", 0))
                        origin = headers.get("warc-segment-origin-id", headers["warc-record-id"])
                        total = headers.get("warc-segment-total-length")
                        rows.append((origin, number, total and int(total), list(headers.items()), block))
                        held += len(block)
                        if held > 4 << 20 or len(rows) == 2000:
                            yield _read_batch(rows)
                            rows, held = [], 0
        if rows:
            yield _read_batch(rows)

    return files.mapInArrow(read, READ_SCHEMA)


def _read_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
    names = ["origin", "number", "total", "headers", "block"]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def reassemble(records: DataFrame) -> DataFrame:
    """headers, blocks in order and completeness of each logical record.

    Records in one piece pass as they are. Segments meet by origin identifier, are put in
    order of their numbers and joined; complete means that numbers run from 1 without a gap
    or a repeat and that the length is the one the last segment states. A record's
    segments must fit one task, as the record itself must.
    """
    whole = records.where("number = 0").select("headers", F.array("block").alias("blocks"), F.lit(True).alias("complete"))
    parts = records.where("number > 0").groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"),
        F.max("total").alias("total"),
        F.max(F.when(F.col("number") == 1, F.struct(F.lit(1).alias("one"), F.map_entries("headers").alias("h")))).alias("first"),
    )
    ordered = F.transform("parts", lambda p: p["number"]) == F.sequence(F.lit(1), F.size("parts"))
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.octet_length(p["block"]))
    joined = parts.select(
        F.map_from_entries("first.h").alias("headers"),
        F.transform("parts", lambda p: p["block"]).alias("blocks"),
        F.coalesce(ordered & (length == F.col("total")) & F.col("first").isNotNull(), F.lit(False)).alias("complete"),
    )
    return whole.unionByName(joined)


def payloads(records: DataFrame) -> DataFrame:
    """page_id, record_type, refers_to, payload (null for revisits), payload_bytes, payload_digest, intact.

    The chunked framing of each response is decoded; bytes and digest are computed from the
    decoded payload. A revisit has those of the payload that its headers name. intact: the
    record is complete, its framing ends, and its digest is the stated one.
    """

    def number(urn: str) -> int | None:
        tail = urn.rpartition(":")[2]
        return int(tail) if tail else None

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest", "intact"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = []
                some = batch.slice(at, 500)
                for headers, blocks, complete in zip(some.column("headers").to_pylist(), some.column("blocks").to_pylist(), some.column("complete").to_pylist(), strict=True):
                    fields = dict(headers or [])
                    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    head, _, body = b"".join(blocks).partition(CRLF + CRLF)
                    lines = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(b":") for x in head.split(CRLF)[1:]))
                    page = number(fields.get("warc-target-uri", ""))
                    if fields.get("warc-type") == "revisit":
                        rows.append((page, "revisit", number(fields["warc-refers-to-target-uri"]), None, int(lines[b"content-length"]), stated, complete))
                        continue
                    try:
                        payload = dechunked(body) if lines.get(b"transfer-encoding", b"").lower() == b"chunked" else body
                    except ValueError:
                        payload, complete = body, False
                    found = digest(payload)
                    rows.append((page, "response", None, payload, len(payload), found, complete and found == stated))
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return records.mapInArrow(
        decode, "page_id long, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, intact boolean"
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive every page and read the archives back: one ``payloads`` row per page.

    Null html is an empty payload; empty payloads are equal payloads like others. Rows that
    repeat the largest page_id of their payload are all responses; rows with a null
    page_id revisit a page of the same payload that has one, else they are responses. An
    empty table gives no rows; other columns aren't read.
    """
    records = materialize(read_archives(write_archives(with_roles(pages))), "warc-records")  # read once, used twice
    return payloads(reassemble(records))
