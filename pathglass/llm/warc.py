"""WARC archives: a writer with one gzip member per record, and a sequential reader (operator 9).

Archives are byte strings in rows of a Parquet folder, so that Spark's commit
protocol and stores apply; :func:`export_archives` puts them out as ``.warc.gz``
files. The reader inflates an archive member by member from small slices, takes
each record's block by its Content-Length, and checks the digests that it finds.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from datetime import datetime, timezone
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathglass.llm.common import join_spread, materialise, new_path

#: An archive is closed when its compressed size reaches this.
ARCHIVE_BYTES = 8 << 20
#: Compressed bytes given to zlib at a time.
SLICE = 1 << 16

#: Fixed value: the profile of a revisit record with an identical payload (WARC 1.1).
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


class Record(NamedTuple):
    kind: str
    headers: dict[str, str]
    payload: bytes  # what stands behind the HTTP head; empty in a revisit


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def now() -> str:
    """The time as WARC-Date writes it."""
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def record_bytes(kind: str, page_id, url: str | None, payload: bytes, refers_to=None, level: int = 4, name: str = "", date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record as one gzip member; ``name`` (its place) makes its record id, so ids are unique."""
    block = _HTTP + (payload if kind == "response" else b"")
    lines = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name} {page_id} {date}')}>",
        "WARC-Date": date,
        "WARC-Target-URI": (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}",
        "WARC-Block-Digest": f"sha1:{base32_sha1(block)}",
        "X-Payload-Length": str(len(payload)),
        "Content-Length": str(len(block)),
    }
    if page_id is not None:
        lines["X-Page-ID"] = str(page_id)
    if kind == "revisit":
        lines |= {"WARC-Profile": REVISIT_PROFILE, "X-Refers-To-Page": str(refers_to)}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()) + "\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def _members(archive: bytes):
    """The inflated bytes of each gzip member, in order."""
    at, rest = 0, b""
    while at < len(archive) or rest:
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if not rest:
                rest = archive[at : at + SLICE]
                at += SLICE
                if not rest:
                    raise ValueError("archive ends inside a gzip member")
            out.append(z.decompress(rest))
            rest = z.unused_data
        yield b"".join(out)


def read_archive(archive: bytes):
    """Yield each :class:`Record`; raises ValueError on broken framing or a wrong digest."""
    for data in _members(archive):
        head, found, body = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not found or not lines[0].startswith("WARC/"):
            raise ValueError("no WARC header")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        block = body[:size]
        if len(block) != size or body[size:] != b"\r\n\r\n":
            raise ValueError("the block does not have the stated length")
        payload = block.partition(b"\r\n\r\n")[2]
        if headers["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
            raise ValueError("wrong block digest")
        if headers["WARC-Type"] == "response" and headers["WARC-Payload-Digest"] != f"sha1:{base32_sha1(payload)}":
            raise ValueError("wrong payload digest")
        yield Record(headers["WARC-Type"], headers, payload)


def plan_records(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, html, refers_to): of pages with equal payloads, the largest id is
    the response that the others revisit; payloads under ``min_bytes`` are all responses.

    A null payload is empty. A page without id never serves as the response of
    others. Rows that repeat the response's id with its payload are responses too.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("__sha", F.sha1(F.col("html").cast("binary")))
    # Digests alone are grouped; pages meet only the digests that occur more than once,
    # and without a shuffle unless there are very many of them.
    digests = rows.filter(F.octet_length("html") >= min_bytes).groupBy("__sha").agg(F.max("page_id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    digests = materialise(digests.filter("__n > 1"), "digests")
    joined = join_spread(rows, digests, "__sha", "__n", digests.agg(F.sum("__n")).first()[0] or 0, "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("__first")), F.col("__first"))
    return joined.select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(records: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, date: str | None = None) -> None:
    """Write the rows of :func:`plan_records` as archives; every row becomes a record of ``date``, now if not given."""
    date = date or now()

    def run(batches):
        part, n, members, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{n:06d}.warc.gz"]), pa.array([len(members)], pa.int64()), pa.array([b"".join(members)], pa.binary())], ["name", "n_records", "archive"])

        for b in batches:
            for page, url, html, refers in zip(*(b.column(c) for c in ("page_id", "url", "html", "refers_to")), strict=True):
                refers = refers.as_py()
                kind = "response" if refers is None else "revisit"
                members.append(record_bytes(kind, page.as_py(), url.as_py(), html.as_py().encode(), refers, name=f"{path}/{part}/{n}/{len(members)}", date=date))
                size += len(members[-1])
                if size >= archive_bytes:
                    yield flush()
                    n, members, size = n + 1, [], 0
        if members:
            yield flush()

    records.mapInArrow(run, "name string, n_records long, archive binary").write.parquet(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    ``payload`` is null in a revisit and left out without ``payloads``; size and
    digest are those of the full payload in both kinds.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    number = lambda value: None if value is None else int(value)

    def run(batches):
        for b in batches:
            for archive in b.column("archive"):
                rows: list = []
                for kind, h, payload in read_archive(archive.as_py()):
                    size = len(payload) if kind == "response" else int(h["X-Payload-Length"])
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    rows.append((number(h.get("X-Page-ID")), h["WARC-Target-URI"], size, digest, kind, number(h.get("X-Refers-To-Page")), payload if kind == "response" else None))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in enumerate(kinds)], names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    archives = spark.read.schema("name string, n_records long, archive binary").parquet(path).select("archive")
    return archives.mapInArrow(run, schema + ", payload binary" * payloads)


def export_archives(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Put the archives at ``path`` out as ``.warc.gz`` files below ``folder``: (name, n_records, size) of each.

    ``folder`` is a URI that pyarrow's file systems and all executors reach. Tasks
    write under names of their own and rename when a file is whole, so a repeated
    task leaves the same files.
    """

    def run(batches):
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for b in batches:
            for name, archive in zip(b.column("name").to_pylist(), b.column("archive"), strict=True):
                part = posixpath.join(root, f".{name}.{uuid.uuid4().hex}")
                with fs.open_output_stream(part) as out:
                    out.write(archive.as_buffer())
                fs.move(part, posixpath.join(root, name))
            yield pa.RecordBatch.from_arrays([b.column("name"), b.column("n_records"), pa.array([len(x.as_buffer()) for x in b.column("archive")], pa.int64())], ["name", "n_records", "size"])

    archives = spark.read.schema("name string, n_records long, archive binary").parquet(path)
    return materialise(archives.mapInArrow(run, "name string, n_records long, size long"), "exported")


def warc_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages as archives into the shared folder and read them back; no payloads in the result."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(plan_records(pages, min_bytes), path)
    return read_archives(spark, path, payloads=False).drop("url")
