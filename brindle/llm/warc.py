"""WARC archives, written and read as streams of chunks.

A record's payload is written chunk by chunk into a gzip member of its own.
The reader walks an archive in blocks and gives a row for each chunk: file,
record and chunk number, bytes, and the SHA-1 of the payload so far, so no
record is ever held as a whole; the last chunk's digest is the payload's.

Of rows with equal payloads (by SHA-1) of at least least_revisit
bytes, those with the smallest page_id become response records and the others
revisit records that name it; shorter payloads are always responses. A
revisit keeps the payload's length in its HTTP header.

Null html is an empty payload. A null page_id or url is written as an empty
name; nulls never are the smallest page_id unless all are null. Rows that
repeat a page_id and payload are all responses, and their records have one id. An empty table gives no
archive. Extra columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import shared_path, written

CHUNK = 64 << 10
DATE = "2026-01-01T00:00:00Z"
CHUNKS = "file string, record bigint, page_id bigint, url string, type string, refers_to bigint, full_bytes bigint, chunk bigint, n_bytes bigint, digest string"


def marked(pages: DataFrame, least_revisit: int = 0, most_broadcast: int = 200_000) -> DataFrame:
    """page_id, url, html, _sha1 and _first: the smallest page_id with an equal payload, null for a payload of its own.

    Only payloads that repeat go into the join, by broadcast while there are
    most_broadcast of them at most.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("_sha1"))
    several = pages.select("page_id", F.sha1(html).alias("_s"), F.octet_length(html).alias("_n")).where(F.col("_n") >= least_revisit)
    several = written(several.groupBy("_s").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_c")).where("_c > 1").select("_s", "_first"), "payloads")
    if several.count() <= most_broadcast:
        several = F.broadcast(several)
    return base.join(several, base["_sha1"] == several["_s"], "left").select("page_id", "url", "html", "_sha1", "_first")


def _head(kind: str, page_id: int | None, url: str | None, digest: str, first: int | None, length: int, http: bytes) -> bytes:
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {'' if url is None else ' '.join(url.split())}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(first)}"]
    return ("\r\n".join([*lines, f"Content-Length: {length}", "", ""])).encode() + http


def write(pages: DataFrame, folder: str, least_revisit: int = 0) -> DataFrame:
    """Writes the archives under folder (a URI that executors reach); returns the table of files that successful tasks wrote."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        out, n = None, 0
        file = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        for batch in batches:
            if out is None:
                where, root = fs.FileSystem.from_uri(folder)
                where.create_dir(root, recursive=True)
                out = where.open_output_stream(f"{root}/{file.rpartition('/')[2]}", compression=None)
            for i in range(batch.num_rows):
                page_id, url, html, sha1, first = (c[i] for c in batch.columns)
                page_id, url, first = page_id.as_py(), url.as_py(), first.as_py()
                payload = memoryview(html.as_buffer())
                digest = base64.b32encode(bytes.fromhex(sha1.as_py())).decode()
                revisit = first is not None and page_id != first
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                packer = zlib.compressobj(1, wbits=31)
                out.write(packer.compress(_head("revisit" if revisit else "response", page_id, url, digest, first, len(http) + (0 if revisit else len(payload)), http)))
                if not revisit:
                    for at in range(0, len(payload), CHUNK):
                        out.write(packer.compress(payload[at : at + CHUNK]))
                out.write(packer.compress(b"\r\n\r\n"))
                out.write(packer.flush())
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([n], pa.int64())], ["file", "n"])

    return written(marked(pages, least_revisit).mapInArrow(store, "file string, n bigint"), "archives")


class _Blocks:
    """The bytes of a file of gzip members, in blocks of a bounded size."""

    def __init__(self, stream):
        self.stream, self.raw, self.unpacker, self.ready = stream, b"", None, b""

    def more(self) -> bool:
        """Puts at least one byte more into ready; False at the end."""
        while True:
            if not self.raw:
                self.raw = self.stream.read(CHUNK)
                if not self.raw:
                    return False
            if self.unpacker is None:
                self.unpacker = zlib.decompressobj(31)
            got = self.unpacker.decompress(self.raw, CHUNK)
            self.raw = self.unpacker.unconsumed_tail
            if self.unpacker.eof:
                self.raw, self.unpacker = self.unpacker.unused_data, None
            if got:
                self.ready += got
                return True

    def until(self, end: bytes) -> bytes | None:
        while (at := self.ready.find(end)) < 0:
            if not self.more():
                return None
        head, self.ready = self.ready[:at], self.ready[at + len(end) :]
        return head

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.ready and not self.more():
                raise ValueError("the archive ends inside a record")
            part, self.ready = self.ready[:n], self.ready[n:]
            n -= len(part)
            yield part


def _fields(head: bytes) -> dict[str, str]:
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}


def chunks(archives: DataFrame, payload: bool = False) -> DataFrame:
    """The chunk table of the archives, with payload also the bytes of each chunk."""
    schema = CHUNKS + (", payload binary" if payload else "")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
        types = [kinds[c.split()[1]] for c in schema.split(", ")]
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        number = lambda x: int(x[len("<urn:page:") : -1]) if len(x) > len("<urn:page:>") else None
        for batch in batches:
            for file in batch.column(0).to_pylist():
                where, path = fs.FileSystem.from_uri(file)
                with where.open_input_stream(path, compression=None) as stream:
                    blocks, record = _Blocks(stream), 0
                    while (head := blocks.until(b"\r\n\r\n")) is not None:
                        about = _fields(head)
                        http = blocks.until(b"\r\n\r\n")
                        full = int(_fields(http)["content-length"])
                        left = int(about["content-length"]) - len(http) - 4
                        refers = number(about["warc-refers-to"]) if "warc-refers-to" in about else None
                        own = (file, record, number(about["warc-record-id"]), about["warc-target-uri"], about["warc-type"], refers, full)
                        stated = about["warc-payload-digest"].removeprefix("sha1:")
                        if about["warc-type"] == "revisit":
                            rows.append((*own, 0, 0, stated, *([b""] if payload else [])))
                        else:
                            sha1, k, digest = hashlib.sha1(), 0, ""
                            for part in blocks.take(left) if left else [b""]:
                                sha1.update(part)
                                digest = base64.b32encode(sha1.digest()).decode()
                                rows.append((*own, k, len(part), digest, *([part] if payload else [])))
                                k += 1
                                if len(rows) >= (64 if payload else 10_000):
                                    yield flush()
                            if digest != stated:
                                raise ValueError(f"record {record} of {file} does not have its digest")
                        if b"".join(blocks.take(4)) != b"\r\n\r\n":
                            raise ValueError(f"record {record} of {file} has no end")
                        record += 1
        if rows:
            yield flush()

    return archives.select("file").repartition(max(1, min(archives.count(), 100_000))).mapInArrow(load, schema)


def report(archives: DataFrame) -> DataFrame:
    """One row for each record: page_id, payload_bytes, payload_digest, record_type and refers_to."""
    per = chunks(archives).groupBy("file", "record").agg(
        *[F.first(c).alias(c) for c in ("page_id", "type", "refers_to", "full_bytes")], F.sum("n_bytes").alias("read"), F.max_by("digest", "chunk").alias("digest")
    )
    return per.select("page_id", F.when(F.col("type") == "revisit", F.col("full_bytes")).otherwise(F.col("read")).alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return report(write(pages, shared_path(spark, "warc")))
