"""WARC archives: a writer of one gzip member a record, and a sequential reader that checks what it reads.

The reader streams each file once: members are decompressed incrementally, the header block is parsed as soon as it
is complete, the block is framed by Content-Length, and the digests of block and payload are computed over what was read.
A file is a task's unit, since the places of members are known only by reading; files are opened through Arrow's file
systems, so they may lie on any store that those know. Damage never ends a file: the damaged member gives a row with an
error and reading goes on at the next gzip magic after its start, which is found by seeking back, so no member's raw bytes
are kept. A header may take HEAD bytes and a block LARGEST; decompression goes in pieces, so a member that would expand
without end takes no more room than that.

Defined results: a null html is archived as a metadata record without block and comes back null; an empty html comes back
empty; null urls and page_ids leave their headers out and come back null; repeated rows are repeated records; extra columns
are ignored; an empty table or an empty file gives no rows. A record cut off by the end of the file has error
"truncated", one whose member can't be decompressed "bad gzip", one whose length isn't its Content-Length "length",
one without a WARC header "header", one with a longer block than LARGEST "too long"; a wrong digest sets verified to false.
Pages needn't be UTF-8: what isn't comes back with replacement characters, and verified speaks of the bytes. Long pages are
framed and digested piece by piece; ties can't occur.
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

from . import common

MAGIC = b"\x1f\x8b\x08"
READ, FLUSH = 1 << 18, 8 << 20
HEAD, LARGEST = 1 << 20, 1 << 29
SCHEMA = "file string, offset long, type string, record_id string, url string, html binary, verified boolean, error string"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(kind: str, record_id: str | None, url: str | None, block: bytes, payload: bytes | None, extra: dict[str, str]) -> bytes:
    """One record as one gzip member."""
    head = {"WARC-Type": kind, "WARC-Date": "2024-01-01T00:00:00Z"}
    head |= {"WARC-Record-ID": record_id} if record_id else {}
    head |= {"WARC-Target-URI": url} if url is not None else {}
    head |= {"WARC-Payload-Digest": digest(payload)} if payload is not None else {}
    head |= extra | {"WARC-Block-Digest": digest(block), "Content-Length": str(len(block))}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def page_member(page_id: int | None, url: str | None, html: str | None) -> bytes:
    record_id = None if page_id is None else f"<urn:page:{page_id}>"
    clean = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    if html is None:
        return _member("metadata", record_id, clean, b"", None, {})
    body = html.encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    return _member("response", record_id, clean, http + body, body, {"Content-Type": "application/http; msgtype=response"})


def write_pages(pages: DataFrame, folder: str) -> DataFrame:
    """Archive (page_id, url, html), a file a partition; gives (file, records). Only files of tasks that ended well are in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        store, path = fs.FileSystem.from_uri(name)
        n = 0
        with store.open_output_stream(path, compression=None) as out:
            out.write(_member("warcinfo", None, None, b"software: quillframe\r\n", None, {"Content-Type": "application/warc-fields"}))
            for batch in batches:
                for page_id, url, html in zip(*(batch.column(c) for c in ("page_id", "url", "html"))):
                    out.write(page_member(page_id.as_py(), url.as_py(), html.as_py()))
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "records"])

    spark = pages.sparkSession
    path, store = common.file_system(spark, folder)
    store.mkdirs(path)
    return common.settle(common.need(pages, "page_id", "url", "html").mapInArrow(run, "file string, records long"), "archives")


class _Record:
    """What one member holds, taken in piece by piece."""

    def __init__(self) -> None:
        self.head = bytearray()
        self.fields: dict[str, str] | None = None
        self.block = bytearray()
        self.rest = bytearray()
        self.sha = hashlib.sha1()
        self.length = self.size = 0
        self.wrong = self.long = False

    def feed(self, data: bytes) -> None:
        if self.fields is None and not self.wrong:
            seen = max(0, len(self.head) - 3)
            self.head += data
            end = self.head.find(b"\r\n\r\n", seen)
            if end < 0:
                self.wrong = len(self.head) > HEAD
                return
            lines = bytes(self.head[:end]).decode("utf-8", "replace").split("\r\n")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            if not lines[0].startswith("WARC/") or not fields.get("content-length", "").isdigit():
                self.wrong = True
                return
            self.fields, self.length = fields, int(fields["content-length"])
            self.long = self.length > LARGEST
            data, self.head = bytes(self.head[end + 4 :]), bytearray()
        if self.wrong:
            return
        take = data[: self.length - self.size]
        self.sha.update(take)
        self.size += len(take)
        if not self.long:
            self.block += take
        if len(take) < len(data):
            self.rest += data[len(take) : len(take) + 5 - len(self.rest)]

    def row(self, file: str, offset: int, error: str | None) -> tuple:
        if self.fields is None:
            return file, offset, None, None, None, None, False, error or "header"
        if error is None and (self.size != self.length or bytes(self.rest) != b"\r\n\r\n"):
            error = "length"
        f, kind = self.fields, self.fields.get("warc-type")
        if self.long:
            return file, offset, kind, f.get("warc-record-id"), f.get("warc-target-uri"), None, False, error or "too long"
        body: bytes | None = bytes(self.block)
        if kind == "response":
            head, gap, payload = body.partition(b"\r\n\r\n")
            body = payload if gap and head.startswith(b"HTTP/") else body
        elif kind == "metadata" and not body:
            body = None
        told = f.get("warc-block-digest", "")
        ok = error is None and (not told.startswith("sha1:") or told == "sha1:" + base64.b32encode(self.sha.digest()).decode())
        told = f.get("warc-payload-digest", "")
        ok = ok and (not told.startswith("sha1:") or body is not None and told == digest(body))
        return file, offset, kind, f.get("warc-record-id"), f.get("warc-target-uri"), body, ok, error


def records(stream, file: str) -> Iterator[tuple]:
    """All records of an open stream that can be sought in, in order."""
    start = 0
    while True:
        stream.seek(start)
        lead = stream.read(len(MAGIC))
        if not lead:
            return
        error = None
        if lead == MAGIC:
            unpack, record, read, rest = zlib.decompressobj(31), _Record(), len(MAGIC), lead
            try:
                while not unpack.eof:
                    if not rest:
                        rest = stream.read(READ)
                        read += len(rest)
                        if not rest:
                            error = "truncated"
                            break
                    record.feed(unpack.decompress(rest, READ * 4))
                    rest = unpack.unconsumed_tail
            except zlib.error:
                error = "bad gzip"
            if error is None:
                yield record.row(file, start, None)
                start += read - len(unpack.unused_data)
                continue
        else:
            error = "bad gzip"
        yield (file, start, None, None, None, None, False, error) if error == "bad gzip" else record.row(file, start, error)
        start = _next_magic(stream, start + 1)
        if start < 0:
            return


def _next_magic(stream, start: int) -> int:
    """The place of the next magic from a place on, -1 without one."""
    stream.seek(start)
    buffer = b""
    while piece := stream.read(READ):
        buffer += piece
        at = buffer.find(MAGIC)
        if at >= 0:
            return start + at
        keep = min(len(buffer), len(MAGIC) - 1)
        start += len(buffer) - keep
        buffer = buffer[len(buffer) - keep :]
    return -1


def read_warc(files: DataFrame) -> DataFrame:
    """The records of the files named in the column file; see SCHEMA. Each file is read by one task, from end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.bool_(), pa.string()]

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for file in batch.column("file").to_pylist():
                store, path = fs.FileSystem.from_uri(file)
                rows, size = [], 0
                with store.open_input_file(path) as stream:
                    for row in records(stream, file):
                        rows.append(row)
                        size += len(row[5] or b"") + 200
                        if size > FLUSH:
                            yield flush(rows)
                            rows, size = [], 0
                if rows:
                    yield flush(rows)

    n = max(1, files.count())
    return files.select("file").repartitionByRange(n, "file").mapInArrow(run, SCHEMA)


def pages_of(found: DataFrame) -> DataFrame:
    """(page_id, url, html, verified, error) of the page records."""
    page = F.regexp_extract("record_id", "^<urn:page:(-?[0-9]+)>$", 1)
    return found.filter("type is null or type != 'warcinfo'").select(F.when(page != "", page.cast("long")).alias("page_id"), "url", F.make_valid_utf8(F.col("html").cast("string")).alias("html"), "verified", "error")


def opquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through an archive and back: what the reader returns of each, and whether its digests held. Without a digest, verified says that the frame held."""
    files = write_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), common.new_path(spark, "warc"))
    return pages_of(read_warc(files))


SQL = "SELECT page_id, url, html, true AS verified, CAST(NULL AS VARCHAR) AS error FROM pages"
