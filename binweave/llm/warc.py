"""WARC archives: a writer with revisit records, and a splittable reader.

Writing: records are gzip members, one per record, appended to files of bounded
size by each task; only files named in the tasks' results count, so files of failed
attempts are never read. Of records with equal payloads (of at least `least` bytes)
that of the smallest page_id is the response; the others are revisits without payload.

Reading: each task scans a byte range for the gzip magic, accepts a candidate if
its header decodes and its data begin with a WARC version line, and owns the records
that start inside its range; a member that reaches beyond the range is read to its end.
A member that doesn't decode, or fails its checksum, is passed over.

Defined results: null payloads are empty; an empty table writes no records and
reads none; repeated pages with one id and payload
are all responses if that id is the smallest; null urls are left out of the record; null ids come last.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, narrow_batches, shared_dir, whole

VERSION = b"WARC/1.1\r\n"
MAGIC = b"\x1f\x8b\x08"
ID = "<urn:page:{}>"
#: Copies of a repeated payload's key, so that no task gets all its pages.
SALTS = 16
RECORD = "record_id string, target_uri string, record_type string, payload_digest string, refers_to string, payload_bytes long, payload binary"
_CHUNK = 1 << 20


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(fields: list[tuple[str, str | None]]) -> bytes:
    return b"".join(f"{k}: {' '.join(v.split())}\r\n".encode() for k, v in fields if v is not None)


def record(page_id: str | None, url: str | None, payload: bytes, first: str | None, original: bool, date: str) -> bytes:
    """One record as a gzip member; a revisit keeps the HTTP header and names the response."""
    http = b"HTTP/1.1 200 OK\r\n" + _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]) + b"\r\n"
    block = http + payload if original else http
    fields = [
        ("WARC-Type", "response" if original else "revisit"), ("WARC-Record-ID", ID.format(page_id)), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", "sha1:" + digest(payload)),
        ("WARC-Profile", None if original else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", None if original else ID.format(first)),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(VERSION + _header(fields) + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def mark_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages(page_id, url, payload) with first, the page_id of the response, and original (bool)."""
    keyed = pages.withColumn("key", F.sha2("payload", 256)).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    big = F.length("payload") >= least
    again = keyed.filter(big).groupBy("key").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).filter("n > 1").select("key", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    joined = keyed.join(again, ["key", "salt"], "left")
    first = F.coalesce("first", "page_id")
    out = joined.select("page_id", "url", "payload", first.alias("first"), F.coalesce(F.col("first").isNull() | (F.col("page_id") == F.col("first")), F.lit(False)).alias("original"))
    return out


def write_warc(pages: DataFrame, folder: str, least: int = 0, roll: int = 1 << 28, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """pages(page_id, url, payload binary) -> written files (path, bytes, records); one action, its result is kept in the shared folder."""
    narrow_batches(pages.sparkSession)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _fs(folder)
        store.create_dir(root, recursive=True)
        task, out, size, n, path = TaskContext.get(), None, 0, 0, ""

        def done() -> pd.DataFrame:
            out.close()
            return pd.DataFrame([(path, size, n)], columns=["path", "bytes", "records"])

        for b in batches:
            for page_id, url, payload, first, original in zip(b["page_id"], b["url"], b["payload"], b["first"], b["original"], strict=True):
                if out is None:
                    path = f"{root}/part-{task.partitionId():06d}-{task.attemptNumber()}-{uuid.uuid4().hex}.warc.gz"
                    out, size, n = store.open_output_stream(path, compression=None), 0, 0
                data = record(page_id, url, bytes(payload), first, bool(original), date)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= roll:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    # ids travel as strings, as pandas would round long ids where some are null
    marked = mark_revisits(pages, least).withColumns({c: F.col(c).cast("string") for c in ("page_id", "first")})
    return durable(marked.mapInPandas(write, "path string, bytes long, records long"), "warc-files")


def _starts(data: bytes, at: int) -> bool:
    """True if a gzip member with a WARC record begins at data[at]."""
    if data[at : at + 3] != MAGIC or (len(data) > at + 3 and data[at + 3] & 0xE0):
        return False
    try:
        return zlib.decompressobj(31).decompress(data[at : at + 4096], 16).startswith(b"WARC/1.")
    except zlib.error:
        return False


def members(store, path: str, start: int, end: int) -> Iterator[bytes]:
    """The decoded members that begin in [start, end)."""
    with store.open_input_file(path) as f:
        size = f.size()
        held, base = b"", start  # held: the bytes from base on

        def more() -> bool:
            nonlocal held
            if base + len(held) >= size:
                return False
            f.seek(base + len(held))
            held += f.read(_CHUNK)
            return True

        at = start
        while at < end:
            held, base = held[at - base :], at
            while len(held) < 4096 and more():
                pass
            if not _starts(held, 0):
                i = held.find(MAGIC[:1], 1)
                while i < 0 and base + len(held) < min(end, size) and more():
                    i = held.find(MAGIC[:1], 1)
                if i < 0:
                    return
                at = base + i
                continue
            unpack, parts, used, ok = zlib.decompressobj(31), [], 0, True
            while not unpack.eof:
                if used >= len(held) and not more():
                    ok = False
                    break
                try:
                    parts.append(unpack.decompress(held[used:]))
                except zlib.error:
                    ok = False
                    break
                used = len(held) - len(unpack.unused_data)
            at = base + (used if ok else 1)
            if ok:
                yield b"".join(parts)


def parse(data: bytes) -> tuple | None:
    """A decoded record as the fields of RECORD; None if its lengths don't fit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
    block = rest[: int(fields.get("Content-Length", "-1"))] if fields.get("Content-Length", "").isdigit() else None
    if block is None or len(rest) != len(block) + 4:
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    said = next((int(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    kind = fields.get("WARC-Type", "")
    if kind == "response":
        if said != len(payload):
            return None
        return fields.get("WARC-Record-ID"), fields.get("WARC-Target-URI"), kind, digest(payload), None, len(payload), payload
    return fields.get("WARC-Record-ID"), fields.get("WARC-Target-URI"), kind, fields.get("WARC-Payload-Digest", "").removeprefix("sha1:"), fields.get("WARC-Refers-To"), said, None


def read_warc(files: DataFrame, folder: str, split: int = 8 << 20, payloads: bool = True) -> DataFrame:
    """files(path, bytes) -> the records, as RECORD; without payloads the payload column is null, though read and digested."""
    total = files.agg(F.sum(F.ceil(F.col("bytes") / split))).first()[0] or 0
    splits = files.filter("bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in RECORD.split(", ")]
        store, _ = _fs(folder)
        for b in batches:
            for path, start in zip(b["path"], b["start"], strict=True):
                rows, held = [], 0
                for data in members(store, path, int(start), int(start) + split):
                    if row := parse(data):
                        rows.append(row if payloads else (*row[:-1], None))
                        held += len(data) if payloads else 200
                        if held > 16 << 20:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return splits.repartition(max(1, int(total)), "path", "start").mapInPandas(read, RECORD)


def archive_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write every page to archives in the shared folder and read the records back: one row per page."""
    folder = f"{shared_dir(spark)}/binweave/warc-{uuid.uuid4().hex}"
    files = write_warc(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", whole("html").cast("binary").alias("payload")), folder)
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1)
    as_id = lambda c: F.when(number(c) != "", number(c).cast("long"))
    return read_warc(files, folder, payloads=False).select(as_id(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", as_id(F.col("refers_to")).alias("refers_to"))
