"""WARC archives: a writer, and a reader that splits compressed files by byte ranges.

Writer: every record is a gzip member of its own; tasks send runs of members through Spark's file
writer (any Hadoop store, normal commit). The writer's record end is an empty gzip member, so that
each file is a plain sequence of members.

Reader: Spark cuts files into byte ranges and gives each task the pieces between gzip magics that
start inside its range, even across its end. A task takes a piece for a member only if its gzip
header, its deflate data and the WARC version line decode; anything else continues the member
before it. Pieces before the first member of a range, and a member not ended with it, are rare
(a magic by chance inside compressed data); they are put together file by file afterwards.

Defined results: a null payload is empty; control characters in an address are percent-encoded; a
null id is the text "null" and comes last; of repeated smallest ids all are responses; an empty
table gives an archive without records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the formats.
MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = MAGIC + b"\x00\x00\x00\x00\x00\x00\x03\x03\x00" + b"\x00" * 8
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"

CHUNK_BYTES = 4 << 20
RECORDS = "record_id string, record_type string, uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, intact boolean"


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def choose_types(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to: null for responses, the smallest id of equal payloads for revisits."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("sha1"))
    rows = rows.withColumn("n_bytes", F.length("payload"))
    # Only ids and digests are aggregated (partially first) and joined; Spark may split a hot digest.
    first = (
        rows.where(F.col("n_bytes") >= min_bytes).groupBy("sha1", "n_bytes")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    )
    later = F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id"))
    return rows.join(first, ["sha1", "n_bytes"], "left").select(
        "page_id", "url", F.when(later, F.col("first_id")).alias("refers_to"), "payload"
    )


def _safe(uri: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri or "")


def member(page_id: int | None, uri: str | None, refers_to: int | None, payload: bytes) -> bytes:
    """One record as one gzip member; a revisit has no block, but tells digest and length of the payload."""
    name = "null" if page_id is None else page_id
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {_safe(uri)}", f"WARC-Payload-Digest: sha1:{base32_digest(payload)}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
        payload = b""
    head += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    squeeze = zlib.compressobj(5, zlib.DEFLATED, 31)
    whole = "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"
    return squeeze.compress(whole) + squeeze.flush()


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["chunk"])

    for batch in batches:
        for i in range(batch.num_rows):
            row = [batch.column(c)[i].as_py() for c in range(4)]
            held.append(member(*row))
            size += len(held[-1])
            if size >= CHUNK_BYTES:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> None:
    chunks = choose_types(pages, min_bytes).mapInArrow(_members, "chunk binary")
    chunks.select(F.col("chunk").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option(
        "lineSep", EMPTY_MEMBER.decode("latin-1")
    ).text(folder)


def parse(whole: bytes) -> tuple | None:
    """The fields of one decompressed record, or None if it is no WARC record."""
    head, mark, block = whole.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    payload = block[: int(fields.get("content-length") or 0)]
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = fields.get("warc-type", "")
    if kind == "revisit":
        length, intact = int(fields.get("warc-payload-length") or 0), True
    else:
        length, intact = len(payload), base32_digest(payload) == digest
    strip = lambda k: fields[k].strip("<>") if k in fields else None
    return (strip("warc-record-id"), kind, fields.get("warc-target-uri"), strip("warc-refers-to"), digest, length, payload, intact)


def begins_member(data: bytes) -> bool:
    """Whether the bytes are a gzip member's start whose content begins as a WARC record (or is empty)."""
    if len(data) < 10 or data[:3] != MAGIC or data[3] & 0xE0:
        return False
    inflate = zlib.decompressobj(31)
    try:
        start = inflate.decompress(data, 5)
    except zlib.error:
        return False
    return start == b"WARC/" if start else inflate.eof


class _Open:
    """A member whose end has not been seen."""

    def __init__(self, data: bytes):
        self.data, self.inflate, self.parts = [data], zlib.decompressobj(31), []
        self.feed(data)

    def feed(self, data: bytes) -> None:
        self.parts.append(self.inflate.decompress(data))

    def add(self, data: bytes) -> bool:
        """Whether the data continue the member; a member that they break is left as it was."""
        keep = self.inflate.copy()
        try:
            self.feed(data)
        except zlib.error:
            self.inflate = keep
            return False
        self.data.append(data)
        return True

    @property
    def ended(self) -> bool:
        return self.inflate.eof


_SCAN = RECORDS + ", path string, block long, piece long, bytes binary"
_COLUMNS = [x.split()[0] for x in _SCAN.split(", ")]
_RECORD_COLUMNS = _COLUMNS[:8]
_ARROW = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
_ARROW_TYPES = [_ARROW[x.split()[1]] for x in _SCAN.split(", ")]
_NO_RECORD = (None,) * 8


def _rows(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), _ARROW_TYPES)], _COLUMNS)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, block, raw piece) in file order -> records, and the pieces at the ends of ranges that make none here.

    Loose pieces are numbered: 0 and above at the start of a range, the open member at its end last.
    """
    where, member_open, lead, out, size = None, None, 0, [], 0

    def close():
        nonlocal member_open
        if member_open is not None:
            out.append((*_NO_RECORD, *where, 2**31 - 1, b"".join(member_open.data)))
            member_open = None

    for batch in batches:
        for i in range(batch.num_rows):
            at = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
            if at != where:
                close()
                where, lead, fresh = at, 0, True
            piece = batch.column(2)[i].as_py()
            if fresh and not piece and at[1] == 0:
                fresh = False
                continue  # what stands before the first magic of a file
            fresh = False
            data = MAGIC + piece
            if member_open is not None and member_open.add(data):
                pass
            elif begins_member(data):
                close()
                member_open = _Open(data)
            else:
                out.append((*_NO_RECORD, *where, lead, data))
                lead += 1
                continue
            if member_open.ended:
                whole = b"".join(member_open.parts)
                if whole and (record := parse(whole)) is not None:
                    out.append((*record, None, None, None, None))
                    size += len(whole)
                member_open = None
            if size > 8 << 20 or len(out) > 5000:
                yield _rows(out)
                out, size = [], 0
    close()
    if out:
        yield _rows(out)


def _stitch(key, frame):
    """Members cut by the end of a range, from the loose pieces of one file in order."""
    import pandas as pd

    found, member_open = [], None
    for data in frame.sort_values(["block", "piece"])["bytes"]:
        data = bytes(data)
        if member_open is None or not member_open.add(data):
            member_open = _Open(data) if begins_member(data) else None
        if member_open is not None and member_open.ended:
            if (record := parse(b"".join(member_open.parts))) is not None:
                found.append(record)
            member_open = None
    return pd.DataFrame(found, columns=_RECORD_COLUMNS)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all archives below the folder."""
    pieces = spark.read.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).text(folder).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("raw"),
    )
    scanned = pieces.mapInArrow(_scan, _SCAN)
    stitched = scanned.where("bytes is not null").groupBy("path").applyInPandas(_stitch, RECORDS)
    return scanned.where("record_id is not null").select(*_RECORD_COLUMNS).unionByName(stitched)


def page_number(urn: Column) -> Column:
    return F.regexp_extract(urn, "^urn:page:(-?[0-9]+)$", 1).try_cast("long")
