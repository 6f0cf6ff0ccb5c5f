"""WARC archives: written by Spark's text writer, read by boundary-chain verification.

Reading: a task looks at one archive and takes every line that starts with the
magic as a candidate record, parses its header and computes where the record
after it would start. A payload can hold the magic too, so candidates are only
believed if a chain of such successors leads to them from the start of the file.
Candidates are dealt into blocks of BLOCK bytes; in a block, the chain from a
candidate is followed to the first offset past the block, and pointer jumping
over those block exits finds where the true chain enters each block.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalyx.llm.arrow import ship
from zonalyx.llm.store import keep, new_path

MAGIC = b"WARC/1.1\r\n"
BLOCK = 4 << 20
#: Payloads of one archive differ in size by this factor at most, beyond the mean.
SIZE_STEP = 16
#: Bytes that the writer aims at in one archive; an archive is read by one task.
ARCHIVE_BYTES = 32 << 20
#: Revisits that may be broadcast to the writing tasks; beyond, the pages are shuffled once.
BROADCAST_ROWS = 500_000
DATE = "2024-01-01T00:00:00Z"

_B32_HEX, _B32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits are four base32 digits."""
    digits = F.sha1(data)
    parts = [F.lpad(F.upper(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32)), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _B32_HEX, _B32)


def plan_records(pages: DataFrame, id_col: str = "page_id", body_col: str = "html", url_col: str = "url", min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest, payload_bytes, record_type, refers_to.

    Of records with equal payloads (by SHA-1, SHA-256 and length) of at least min_bytes,
    the smallest id is the response and the others revisit it; rows that share that smallest id are all
    responses. Null payload counts as empty, a null id is never the smallest.
    """
    base = pages.select(
        F.col(f"`{id_col}`").alias("page_id"),
        F.col(f"`{url_col}`").alias("url"),
        F.coalesce(F.col(f"`{body_col}`"), F.lit("")).alias("payload"),
    )
    base = base.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    base = base.withColumn("sha256", F.sha2("payload", 256))
    keys = keep(base.select("page_id", "digest", "sha256", "payload_bytes"), "warc-keys")
    groups = keys.where(F.col("payload_bytes") >= min_bytes).groupBy("digest", "sha256", "payload_bytes").agg(
        F.min("page_id").alias("first"),
        F.count(F.lit(1)).alias("n"),
    )
    groups = keep(groups.where("n > 1").select("digest", "sha256", "payload_bytes", "first", "n"), "warc-groups")
    # digests of repeated payloads; few enough to broadcast, or the pages are shuffled by digest
    small = groups.count() <= BROADCAST_ROWS
    joined = base.join(F.broadcast(groups) if small else groups, ["digest", "sha256", "payload_bytes"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id", "url", "payload", "digest", "payload_bytes",
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def _record(kind: Column) -> Column:
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    url = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    field = lambda key, value: F.coalesce(F.concat(F.lit(f"{key}: "), value, F.lit("\r\n")), F.lit(""))
    block_bytes = F.lit(len(http)) + F.when(kind == "response", F.col("payload_bytes")).otherwise(0)
    return F.concat(
        F.lit(MAGIC.decode()),
        field("WARC-Type", kind),
        field("WARC-Record-ID", F.coalesce(name(F.col("page_id")), F.lit("<urn:page:null>"))),
        field("WARC-Date", F.lit(DATE)),
        field("WARC-Target-URI", url),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        field("WARC-Refers-To", name(F.col("refers_to"))),
        F.when(kind == "revisit", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(F.lit("")),
        field("X-Payload-Length", F.col("payload_bytes").cast("string")),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", block_bytes.cast("string")),
        F.lit("\r\n" + http),
        F.when(kind == "response", F.col("payload")).otherwise(F.lit("")),
        # the writer ends each row with a line feed
        F.lit("\r\n\r"),
    )


def write_warc(records: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, mean_bytes: float | None = None, max_bytes: int | None = None) -> str:
    """Archives under path, from what plan_records gives; no row is moved between tasks.

    With mean_bytes and max_bytes, payloads' sizes, an archive has SIZE_STEP times
    archive_bytes at most, or a single record: payloads of up to SIZE_STEP times the
    mean are written first, then those of up to SIZE_STEP times more, and so on, each
    with as many records a file as their size allows.
    """
    text = records.select(_record(F.col("record_type")).alias("value"), "payload_bytes")
    low, high = -1, int(SIZE_STEP * max(mean_bytes, 500)) if mean_bytes else None
    while True:
        part = text.where(F.col("payload_bytes") > low) if low >= 0 else text
        last = high is None or max_bytes is None or high >= max_bytes
        part = part if last else part.where(F.col("payload_bytes") <= high)
        writer = part.select("value").write.mode("append").option("lineSep", "\n")
        if mean_bytes:
            usual = mean_bytes if low < 0 else low
            writer = writer.option("maxRecordsPerFile", max(1, int(archive_bytes / (usual + 500))))
        writer.text(path)
        if last:
            return path
        low, high = high, high * SIZE_STEP


def candidates(content: bytes, block: int = BLOCK) -> list[tuple[int, int, dict, int, int]]:
    """(offset, successor, header, block start, block length) of every line that starts with the magic and has a header."""
    out, at = [], content.find(MAGIC)
    while at >= 0:
        if at == 0 or content[at - 1 : at] == b"\n":
            end = content.find(b"\r\n\r\n", at)
            if end >= 0:
                header = {}
                for line in content[at + len(MAGIC) : end].split(b"\r\n"):
                    key, _, value = line.partition(b":")
                    header[key.strip().lower()] = value.strip()
                length = header.get(b"content-length", b"")
                if length.isdigit() and end + 8 + int(length) <= len(content):
                    out.append((at, end + 8 + int(length), header, end + 4, int(length)))
        at = content.find(MAGIC, at + 1)
    return out


_FIELDS = [
    ("page_id", pa.string()),
    ("record_type", pa.string()),
    ("refers_to", pa.string()),
    ("declared", pa.string()),
    ("digest", pa.string()),
    ("payload_bytes", pa.int64()),
]
_RECORD = "struct<page_id:string,record_type:string,refers_to:string,declared:string,digest:string,payload_bytes:long>"
_SCAN = f"file string, block long, length long, entries array<long>, exits array<long>, offsets array<long>, successors array<long>, records array<{_RECORD}>"


def _parsed(content: bytes, header: dict, start: int, length: int) -> dict:
    name = lambda key: header[key].decode("utf-8", "replace").removeprefix("<urn:page:").removesuffix(">") if key in header else None
    body = content[start : start + length]
    payload = body[body.find(b"\r\n\r\n") + 4 :]
    kind = header.get(b"warc-type", b"").decode("utf-8", "replace")
    declared = header.get(b"warc-payload-digest", b"").decode("utf-8", "replace").removeprefix("sha1:")
    if kind == "revisit":
        size = header.get(b"x-payload-length", b"")
        digest, size = declared, int(size) if size.isdigit() else None
    else:
        digest, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
    return {
        "page_id": name(b"warc-record-id"),
        "record_type": kind,
        "refers_to": name(b"warc-refers-to"),
        "declared": declared,
        "digest": digest,
        "payload_bytes": size,
    }


def _scan(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py()
                blocks: dict[int, list] = {}
                for c in candidates(data):
                    blocks.setdefault(c[0] // block, []).append(c)
                rows = []
                for k, found in blocks.items():
                    exit_of: dict[int, int] = {}
                    for at, successor, *_ in reversed(found):
                        exit_of[at] = exit_of.get(successor, successor) if successor < (k + 1) * block else successor
                    offsets = [c[0] for c in found]
                    rows.append(
                        {
                            "file": file,
                            "block": k,
                            "length": len(data),
                            "entries": offsets,
                            "exits": [exit_of[o] for o in offsets],
                            "offsets": offsets,
                            "successors": [c[1] for c in found],
                            "records": [_parsed(data, c[2], c[3], c[4]) for c in found],
                        }
                    )
                del data
                schema = pa.schema(
                    [
                        ("file", pa.string()),
                        ("block", pa.int64()),
                        ("length", pa.int64()),
                        ("entries", pa.list_(pa.int64())),
                        ("exits", pa.list_(pa.int64())),
                        ("offsets", pa.list_(pa.int64())),
                        ("successors", pa.list_(pa.int64())),
                        ("records", pa.list_(pa.struct(_FIELDS))),
                    ]
                )
                yield from pa.Table.from_pylist(rows, schema).to_batches()

    return run


def _reached(scanned: DataFrame, block: int) -> DataFrame:
    """file, offset: where the chain from the start of each file enters its blocks."""
    jumps = scanned.select("file", F.explode(F.arrays_zip("entries", "exits")).alias("j")).select(
        "file",
        F.col("j.entries").alias("at"),
        F.col("j.exits").alias("to"),
    )
    # only a file's start and the exits of other blocks can be entries
    goals = jumps.select("file", F.col("to").alias("at")).union(scanned.select("file", F.lit(0).cast("long").alias("at"))).distinct()
    jumps = keep(jumps.join(goals, ["file", "at"], "left_semi"), "warc-jumps")
    reached = keep(jumps.where("at = 0").select("file", "at"), "warc-reached")
    longest = scanned.agg(F.max("length")).first()[0] or 0
    step, blocks = jumps, math.ceil(longest / block)
    for k in range(math.ceil(math.log2(blocks)) if blocks > 1 else 0):
        more = reached.join(step, ["file", "at"]).select("file", F.col("to").alias("at"))
        reached = keep(reached.union(more).distinct(), "warc-reached")
        if 2 ** (k + 1) < blocks:
            nxt = step.select("file", F.col("at").alias("to"), F.col("to").alias("end"))
            step = keep(step.join(nxt, ["file", "to"]).select("file", "at", F.col("end").alias("to")), "warc-jumps")
    return reached


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            of = {o: k for k, o in enumerate(row["offsets"])}
            at = row["at"]
            while at in of:
                k = of[at]
                out.append({"file": row["file"], "offset": at, **row["records"][k]})
                at = row["successors"][k]
        schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), *_FIELDS])
        yield from pa.Table.from_pylist(out, schema).to_batches()


def read_warc(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """One row per reachable record: file, offset, page_id, record_type, refers_to, declared, digest, payload_bytes.

    digest and payload_bytes are computed from a response's payload; a revisit's
    are those it declares. The chain of a damaged file ends at the damage. Files
    without a record at their start give no rows.
    """
    files = ship(spark).read.format("binaryFile").load(path).select("path", "content")
    scanned = keep(files.mapInArrow(_scan(block), _SCAN), "warc-scan")
    entry = _reached(scanned, block).withColumn("block", F.floor(F.col("at") / block))
    rows = scanned.select("file", "block", "offsets", "successors", "records").join(entry, ["file", "block"])
    return rows.mapInArrow(
        _walk,
        f"file string, offset long, page_id string, record_type string, refers_to string, declared string, digest string, payload_bytes long",
    )


def round_trip(pages: DataFrame, id_col: str = "page_id", body_col: str = "html", url_col: str = "url", min_bytes: int = 0) -> DataFrame:
    """Write every page as a record, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    records = plan_records(pages, id_col, body_col, url_col, min_bytes)
    body = F.octet_length(F.coalesce(F.col(f"`{body_col}`"), F.lit("")))
    mean, most = pages.agg(F.avg(body), F.max(body)).first()
    path = write_warc(records, new_path(spark, "warc"), mean_bytes=mean or 0.0, max_bytes=most)
    kind = pages.schema[id_col].dataType
    got = read_warc(spark, path)
    page = F.when(F.col("page_id") != "null", F.col("page_id")).cast(kind)
    return got.select(
        page.alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
