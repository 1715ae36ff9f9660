"""WARC archives: one gzip member a record, written and read back sequentially.

Writing: payloads are digested in the scan, equal ones are found by digest, and
each task writes archives of bounded size; of equal payloads the one
with the smallest id is a response and the others are revisits that refer to it.
Reading: a member at a time, decompressed as it comes, framed by
Content-Length, with block and payload digests verified.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, in_batches

VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Revisits that are broadcast at most: 80 bytes each, 40 MB in all.
BROADCAST_ROWS = 500_000


class WarcError(ValueError):
    """An archive that is not framed as it should be, or whose digests do not agree."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def open_file(uri: str, mode: str) -> BinaryIO:
    """A stream on a path that all executors share: a mounted folder, or a store that pyarrow reaches."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        if "w" in mode:
            os.makedirs(os.path.dirname(parsed.path), exist_ok=True)
        return open(parsed.path, mode)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_output_stream(path) if "w" in mode else store.open_input_stream(path)


def commit_file(uri: str, name: str, final: str) -> None:
    """Give a finished file its name, in one step."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        os.replace(f"{parsed.path}/{name}", f"{parsed.path}/{final}")
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.move(f"{path}/{name}", f"{path}/{final}")


@dataclass
class Record:
    """Header fields, in order, and the block."""

    fields: list[tuple[str, str]]
    block: bytes

    def get(self, name: str) -> str | None:
        return next((v for k, v in self.fields if k.lower() == name.lower()), None)

    @property
    def payload(self) -> bytes:
        """The block without its HTTP head, where it is an HTTP message."""
        if (self.get("Content-Type") or "").startswith("application/http"):
            head, cut, body = self.block.partition(b"\r\n\r\n")
            return body if cut else b""
        return self.block


def member(record: Record, level: int = 6) -> bytes:
    """A record as one gzip member; the head of the member names no time, so reruns agree."""
    out = io.BytesIO()
    out.write(VERSION + b"\r\n")
    for k, v in record.fields:
        out.write(f"{k}: {v}\r\n".encode())
    out.write(f"Content-Length: {len(record.block)}\r\n\r\n".encode() + record.block + b"\r\n\r\n")
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(out.getvalue()) + z.flush()


def records(stream: BinaryIO, chunk: int = 1 << 16) -> Iterator[Record]:
    """Records of an archive, one gzip member at a time; memory holds one record and one chunk."""
    data = b""
    while True:
        data = data or stream.read(chunk)
        if not data:
            return
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if not data and not (data := stream.read(chunk)):
                raise WarcError("the archive ends within a member")
            try:
                parts.append(z.decompress(data))
            except zlib.error as e:
                raise WarcError(f"not a gzip member: {e}") from None
            data = z.unused_data
        yield parse(b"".join(parts))


def parse(raw: bytes) -> Record:
    """One framed record; WarcError where version, Content-Length or a digest is wrong."""
    head, cut, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not cut or not first.startswith(b"WARC/"):
        raise WarcError("no WARC header")
    fields = []
    for line in lines:
        try:
            k, colon, v = line.decode().partition(":")
        except UnicodeDecodeError:
            raise WarcError(f"not a header in UTF-8: {line[:80]!r}") from None
        if not colon:
            raise WarcError(f"not a header field: {line[:80]!r}")
        fields.append((k.strip(), v.strip()))
    out = Record(fields, b"")
    length = out.get("Content-Length")
    if length is None or not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("Content-Length does not frame the record")
    out.block = rest[:-4]
    for name, data in (("WARC-Block-Digest", out.block), ("WARC-Payload-Digest", out.payload)):
        named = out.get(name)
        if named and not (name == "WARC-Payload-Digest" and out.get("WARC-Type") == "revisit"):
            if named != f"sha1:{base32_sha1(data)}":
                raise WarcError(f"{name} does not agree")
    return out


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> Record:
    """A page as response, or as revisit of the page with an equal payload."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    name = f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.UUID(bytes=hashlib.sha1((url or '').encode() + payload).digest()[:16])}"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", "2000-01-01T00:00:00Z")]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(url.split("\r")).replace("\n", "")))
    fields += [("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("WARC-Payload-Length", str(len(payload))),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
    ]
    return Record(fields, block)


def _revisits(src: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload one with a smaller id has as well.

    Only ids and digests are shuffled for it.  What is found is brought to the pages by broadcast where it is small, else by id,
    which no two payloads share but by accident, so a payload that a third of all pages have goes to no one task.
    """
    slim = src.where(F.col("page_id").isNotNull() & (F.col("bytes") >= least_bytes)).select("page_id", "digest", "bytes")
    firsts = slim.groupBy("digest", "bytes").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    found = slim.join(firsts, ["digest", "bytes"]).where("refers_to <> page_id").select("page_id", "digest", "refers_to").distinct()
    found = Workspace(src.sparkSession, "revisits").keep(found, "revisits")
    return F.broadcast(found) if found.count() <= BROADCAST_ROWS else found


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = 64 << 20, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archives of the pages under ``folder``; a lazy table (archive, n_records) that writes as it runs.

    Equal payloads of at least ``least_bytes`` are written once.  A file gets
    its name when it is whole; a task that runs again writes files of its own, and only
    those whose rows the job returned count.
    """
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "utf-8").alias("payload"))
    src = src.withColumns({"digest": F.sha1("payload"), "bytes": F.octet_length("payload")})
    revisits = _revisits(src, least_bytes)
    found = src.join(revisits, ["page_id", "digest"], "left")
    rows = found.select("page_id", "url", "payload", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def files() -> Iterator[tuple[str, int]]:
            out, size, n, name = None, 0, 0, ""
            for batch in batches:
                for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None:
                        name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = open_file(f"{folder}/_{name}", "wb")
                    data = member(page_record(page_id, url, payload, refers_to))
                    out.write(data)
                    size, n = size + len(data), n + 1
                    if size >= archive_bytes:
                        out.close()
                        commit_file(folder, f"_{name}", name)
                        out = None
                        yield f"{folder}/{name}", n
            if out is not None:
                out.close()
                commit_file(folder, f"_{name}", name)
                yield f"{folder}/{name}", n

        yield from in_batches({"archive": pa.string(), "n_records": pa.int64()}, files())

    return rows.mapInArrow(write, "archive string, n_records long")


RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the archives named in column ``archive``, each file read in one pass by one task."""

    def number(text: str | None) -> int | None:
        return int(text[10:-1]) if text and text.startswith("<urn:page:") else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for path in batch.column("archive").to_pylist():
                    with open_file(path, "rb") as stream:
                        for r in records(stream):
                            kind, body = r.get("WARC-Type"), r.payload
                            digest = (r.get("WARC-Payload-Digest") or "").removeprefix("sha1:")
                            # a revisit has no payload: its length and digest are those its header names
                            size = int(r.get("WARC-Payload-Length") or 0) if kind == "revisit" else len(body)
                            yield number(r.get("WARC-Record-ID")), r.get("WARC-Target-URI"), size, digest, kind, number(r.get("WARC-Refers-To")), body if payloads and kind != "revisit" else None

        yield from in_batches(kinds, rows(), 256)

    return archives.select("archive").mapInArrow(read, RECORD_SCHEMA)


def round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the pages to archives in the shared folder and read the records back, verified.

    A null html is an empty payload; a null url leaves the target out; a null id gets a
    name made from its content and reads back as null.  Rows that repeat the smallest
    id of a payload are responses all.  No page gives no archive and no record.
    """
    ws = Workspace(spark, "warc")
    written = ws.keep(write_archives(pages, f"{ws.root}/archives", least_bytes), "written")
    n = max(1, written.count())
    return read_archives(written.repartition(n), payloads=False).drop("payload", "url")
