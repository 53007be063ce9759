"""WARC archives: pages to records with segments and chunked framing, and back.

Writing.  A page becomes a `response` record whose HTTP body has chunked transfer framing, or, where an earlier page
(by id) has the same payload of at least `least` bytes, a `revisit` record of the identical-payload-digest profile.  A record whose block is
longer than `segment` bytes is cut: the first part keeps the record's head, the others are `continuation` records that
name its id and their number, the last one also the total length.  Spark's text writer puts the records into gzip files, with the
blank line that ends a record as its line separator, so archives land by its commit protocol in any store that Spark writes.

Reading.  Archives, with one gzip member or one a record or plain, are read as a stream of records by their lengths.  Parts are grouped by
origin id, which may be spread over files, ordered by number and joined; numbers must run from 1 without a gap and the lengths
add up to the total.  Then the transfer framing is taken off and the payload checked against its digest.

Payloads move once when written, to meet pages of the same digest; only parts of cut records meet again when read, a record at a time.
A hot payload is one row on the counted side of its join, and Spark splits the other.

Defined results: a null html is an empty payload; a null url is left out; a null page_id never is the smallest, and a page with one
revisits the smallest there is; rows that repeat the smallest id and its payload are responses too, as nothing tells them apart; an archive that is
cut off gives the records before the cut and one of status `cut`; a record that lacks parts, or does not agree with its total, framing
or digest, has status `segments`, `length`, `framing` or `digest` and no payload; a repeated equal part counts once; an empty table
gives no archive and no rows.  Only the named columns are read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, stash
from .shingles import row_slices

SEGMENT = 16 << 10
CHUNK = 4 << 10
LEAST = 100
RECORDS_A_FILE = 50_000
DATE = "2024-01-01T00:00:00Z"
#: Fixed values of the format.
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(part), part) for part in (payload[k : k + size] for k in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are passed over."""
    at, parts = 0, []
    while True:
        end = body.find(b"\r\n", at)
        head = body[at:end].split(b";")[0].strip()
        if end < 0 or not re.fullmatch(rb"[0-9A-Fa-f]+", head):
            raise ValueError("no chunk size")
        size = int(head, 16)
        if not size:
            return b"".join(parts)
        at = end + 2 + size
        if body[at : at + 2] != b"\r\n":
            raise ValueError("chunk is cut")
        parts.append(body[end + 2 : at])
        at += 2


def _head(fields: list[tuple[str, object]]) -> bytes:
    lines = [f"{name}: {value}\r\n" for name, value in fields if value is not None]
    return ("WARC/1.1\r\n" + "".join(lines) + "\r\n").encode("utf-8", "surrogateescape")


def _plain(url: str | None) -> str | None:
    """The address without characters that would end a header line."""
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def records_of(page_id: int | None, url: str | None, payload: bytes, digest: str, first_url: str | None, revisit: bool, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of a page, without the blank line at their ends."""
    name = f"<urn:uuid:{uuid.uuid4()}>"
    block = HTTP + b"\r\n" if revisit else HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[k : k + segment] for k in range(0, len(block), segment)]
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Target-URI", _plain(url)), ("X-Page-ID", page_id), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", _plain(first_url))]
    fields += [("Content-Type", "application/http;msgtype=response"), ("WARC-Segment-Number", 1 if len(parts) > 1 else None)]
    yield _head([*fields, ("Content-Length", len(parts[0]))]) + parts[0]
    for k, part in enumerate(parts[1:], 2):
        total = len(block) if k == len(parts) else None
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", k)]
        yield _head([*own, ("WARC-Segment-Total-Length", total), ("Content-Length", len(part))]) + part


def _write(batches: Iterator[pa.RecordBatch], segment: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in row_slices(batch["payload"]):
            rows = zip(*(batch[c].slice(a, b - a).to_pylist() for c in ("page_id", "url", "payload", "digest", "first_url", "revisit")), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([record for row in rows for record in records_of(*row, segment)], pa.binary())], ["value"])


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT, least: int = LEAST, records_a_file: int = RECORDS_A_FILE) -> None:
    """Archives of all pages under `path`."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("_long", F.octet_length("payload") >= least)
    first = rows.where("_long").groupBy("digest").agg(F.count("*").alias("_n"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("_first"))
    joined = rows.join(first.where("_n > 1 and _first is not null").select("digest", "_first").hint("shuffle_hash"), "digest", "left")
    later = F.col("_long") & F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first.page_id"))
    made = joined.select("page_id", "url", "payload", "digest", F.col("_first.url").alias("first_url"), F.coalesce(later, F.lit(False)).alias("revisit"))
    text = made.mapInArrow(lambda it: _write(it, segment), "value binary").select(F.col("value").cast("string").alias("value"))
    text.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_a_file).text(path)


def stream_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(fields by lower-case name, block) of the records of an archive; where it breaks off or is none, a last one without a block."""
    plain = io.BytesIO(data)
    source = io.BufferedReader(gzip.GzipFile(fileobj=plain), 1 << 20) if data[:2] == b"\x1f\x8b" else plain
    try:
        while line := source.readline():
            if not line.strip():
                continue
            fields: dict[str, str] = {}
            name = ""
            if not line.startswith(b"WARC/"):
                raise ValueError("not a record")
            while (line := source.readline()).strip():
                text = line.decode("utf-8", "surrogateescape").rstrip("\r\n")
                if text[:1] in " \t" and name:
                    fields[name] += " " + text.strip()
                else:
                    name, _, value = text.partition(":")
                    name = name.strip().lower()
                    fields[name] = value.strip()
            size = int(fields["content-length"])
            block = source.read(size)
            if len(block) < size or not line:
                raise EOFError
            yield fields, block
    except (EOFError, OSError, ValueError, KeyError, zlib.error):
        yield {}, None


PART = pa.schema([
    ("file", pa.string()), ("place", pa.int64()), ("kind", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("digest", pa.string()),
    ("refers_uri", pa.string()), ("origin", pa.string()), ("number", pa.int64()), ("total", pa.int64()), ("block", pa.binary()),
])
PART_SQL = "file string, place bigint, kind string, record_id string, target_uri string, page_id bigint, digest string, refers_uri string, origin string, number bigint, total bigint, block binary"


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?[0-9]{1,18}", text) else None


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, data in zip(batch["path"].to_pylist(), batch["content"], strict=True):
            rows, held = [], 0
            for place, (f, block) in enumerate(stream_records(data.as_py())):
                kind = "cut" if block is None else f.get("warc-type")
                digest = f.get("warc-payload-digest", "").removeprefix("sha256:") or None
                number, name = _number(f.get("warc-segment-number")), f.get("warc-record-id")
                origin = f.get("warc-segment-origin-id") or (name if number is not None else None)
                rows.append((file, place, kind, name, f.get("warc-target-uri"), _number(f.get("x-page-id")), digest, f.get("warc-refers-to-target-uri"), origin, number, _number(f.get("warc-segment-total-length")), block))
                held += len(block or b"")
                if held > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PART.types, strict=True)], schema=PART)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PART.types, strict=True)], schema=PART)


def payload_of(kind: str, blocks: list[tuple[int | None, int | None, bytes]], digest: str | None) -> tuple[bytes | None, str]:
    """Payload and status of a record from its parts (number, total, block)."""
    if kind not in ("response", "resource", "revisit"):
        return None, "segments" if kind == "continuation" else kind
    parts = sorted(set(blocks), key=lambda p: p[0] or 0)
    if len(blocks) > 1 or parts[0][0] is not None:
        if [p[0] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1][1] is None:
            return None, "segments"
        if sum(len(p[2]) for p in parts) != parts[-1][1]:
            return None, "length"
    if kind == "revisit":
        return None, "ok"
    body = b"".join(p[2] for p in parts)
    if kind == "response":
        head, _, body = body.partition(b"\r\n\r\n")
        if re.search(rb"(?im)^transfer-encoding:[ \t]*chunked[ \t]*\r?$", head):
            try:
                body = dechunked(body)
            except ValueError:
                return None, "framing"
    if digest is not None and hashlib.sha256(body).hexdigest() != digest:
        return None, "digest"
    return body, "ok"


RECORD = "kind string, record_id string, target_uri string, page_id bigint, digest string, refers_uri string, payload binary, status string"


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keep = ["kind", "record_id", "target_uri", "page_id", "digest", "refers_uri"]
    for batch in batches:
        kinds, digests, rows, start, held = batch["kind"].to_pylist(), batch["digest"].to_pylist(), [], 0, 0
        for k, kind in enumerate(kinds):  # parts a record at a time: they may be large
            rows.append(payload_of(kind or "", [(p["number"], p["total"], p["block"]) for p in batch["parts"][k].as_py()], digests[k]))
            held += len(rows[-1][0] or b"")
            if held > 1 << 22 or k + 1 == len(kinds):
                own = [batch[c].slice(start, len(rows)) for c in keep]
                yield pa.RecordBatch.from_arrays([*own, pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows])], [*keep, "payload", "status"])
                rows, start, held = [], k + 1, 0


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(kind, record_id, target_uri, page_id, digest, refers_uri, payload, status) of every record of the archives under `path`."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    parts = stash(files.mapInArrow(_parts, PART_SQL), "warc-records")
    part = F.struct("number", "total", "block")
    facts = ["kind", "record_id", "target_uri", "page_id", "digest", "refers_uri"]
    whole = parts.where("origin is null").select(*facts, F.array(part).alias("parts"))
    head = F.when(F.col("kind") != "continuation", F.struct(*facts))
    cut = parts.where("origin is not null").groupBy("origin").agg(F.first(head, ignorenulls=True).alias("_head"), F.collect_list(part).alias("parts"))
    lone = F.struct(F.lit("continuation").alias("kind"), F.col("origin").alias("record_id"), *[F.lit(None).cast(t).alias(n) for n, t in (("target_uri", "string"), ("page_id", "long"), ("digest", "string"), ("refers_uri", "string"))])
    joined = cut.select(F.coalesce("_head", lone).alias("_head"), "parts").select("_head.*", "parts")
    return whole.unionByName(joined).mapInArrow(_decode, RECORD)


def resolve(records: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of pages read back; revisits are resolved to the response of their digest.

    A payload's digest is the record's, which reading has checked.  A record of a status other than `ok`, and a revisit whose response is not there, has no bytes.
    """
    pages = records.where("kind in ('response', 'revisit')")
    facts = pages.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.coalesce(F.col("digest"), F.sha2("payload", 256)).alias("payload_digest"), F.col("kind").alias("record_type"), "status")
    facts = stash(facts, "warc-pages")
    responses, revisits = facts.where("record_type = 'response'"), facts.where("record_type = 'revisit'")
    origin = responses.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.max("payload_bytes").alias("payload_bytes"))
    later = revisits.drop("payload_bytes").join(origin, "payload_digest", "left")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "status"]
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(*names).unionByName(later.select(*names))


def round_trip(pages: DataFrame) -> DataFrame:
    """Every page written to fresh archives in the shared folder and read back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    return resolve(read_archives(spark, path))
