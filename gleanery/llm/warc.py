"""WARC archives: written as one gzip stream per file, then normalised to one gzip member per record with a sidecar offset index.

Records carry the page's URL, id and SHA-1 payload digest (bare upper-case base32 after ``sha1:``). Of the pages with equal payloads of
``min_revisit`` bytes or more, the one with the largest page_id is a response, the others are revisits that name it and hold its HTTP
header only; rows that repeat the largest id are responses too. A page without an id ranks below every id. Null html is an empty payload.

The normaliser inflates each file once, as a stream, and copies each record into a gzip member of its own, in pieces of bounded size, so
neither files nor records need fit in memory. The sidecar (``.idx``) has a line per record: offset, length, type, page id. Any record can
then be read alone, and the index rows can be dealt to any number of tasks.

Files live in the shared folder, under names fixed by partition; a task writes beside the name and moves the file when it is whole, so an
attempt that is lost or repeated does no harm.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import filesystem, fresh_dir, stored

CHUNK, LEVEL, DATE = 1 << 20, 6, "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    target = "".join(c for c in url or "" if c >= " ")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if is_revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])} | {"": lines[0]}


def page_of(named: str) -> int | None:
    value = named.removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value else None


def marked_pages(pages: DataFrame, min_revisit: int) -> DataFrame:
    """(page_id, url, html, keep): ``keep`` is the id of the response if the page is to be a revisit of it."""
    plain = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    plain = plain.withColumn("_d", F.sha1(F.col("html").cast("binary")))
    # only digests that occur twice come back, so the join's right side holds no unique page
    last = plain.filter(F.octet_length("html") >= min_revisit).groupBy("_d").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    older = F.col("_last").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("_last")))
    return plain.join(last, "_d", "left").select("page_id", "url", "html", F.when(older, F.col("_last")).alias("keep"))


def write_archives(pages: DataFrame, folder: str, min_revisit: int = 0, level: int = LEVEL) -> DataFrame:
    """One whole-file gzip stream per partition; (file, records), stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, root = filesystem(folder)
        name = f"{root}/part-{context.partitionId():06d}.warc.gz"
        part, out, n = f"{name}.{context.taskAttemptId()}", None, 0
        squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
        for batch in batches:
            for page_id, url, html, keep in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(part)
                payload = html.encode()
                out.write(squeeze.compress(record(page_id, url, payload, base32_sha1(payload), keep, keep is not None)))
                n += 1
        if out is not None:
            out.write(squeeze.flush())
            out.close()
            store.move(part, name)
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [n]})

    return stored(marked_pages(pages, min_revisit).mapInArrow(run, "file string, records long"), "archives")


class Inflated:
    """Bytes of a gzip file, all members in a row, read through a bounded buffer."""

    def __init__(self, raw: BinaryIO) -> None:
        self.raw, self.left, self.buffer, self.engine = raw, b"", bytearray(), zlib.decompressobj(31)

    def fill(self) -> bool:
        while True:
            data = self.left or self.raw.read(CHUNK)
            if not data:
                return False
            got = self.engine.decompress(data, CHUNK)
            self.left = self.engine.unconsumed_tail
            if self.engine.eof:
                self.left, self.engine = self.engine.unused_data, zlib.decompressobj(31)
            if got:
                self.buffer += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with the mark; None at the end of the file."""
        seen = 0
        while (at := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if not self.fill():
                if self.buffer.strip():
                    raise ValueError("the archive ends inside a record")
                return None
        out = bytes(self.buffer[: at + len(mark)])
        del self.buffer[: at + len(mark)]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self.fill():
                raise ValueError("the archive ends inside a record")
            out = bytes(self.buffer[: min(n, CHUNK)])
            del self.buffer[: len(out)]
            n -= len(out)
            yield out


def normalise_stream(raw: BinaryIO, out: BinaryIO, level: int = LEVEL) -> Iterator[tuple[int, int, str, int | None]]:
    """Copy each record into its own gzip member; yields (offset, length, type, page id)."""
    source, offset = Inflated(raw), 0
    while (head := source.until(b"\r\n\r\n")) is not None:
        head = head.lstrip(b"\r\n")
        named = headers_of(head[:-4])
        squeeze, start = zlib.compressobj(level, zlib.DEFLATED, 31), offset
        for piece in chain([head], source.pieces(int(named["content-length"]))):
            offset += out.write(squeeze.compress(piece))
        for _ in source.pieces(4):
            pass
        offset += out.write(squeeze.compress(b"\r\n\r\n"))
        offset += out.write(squeeze.flush())
        yield start, offset - start, named["warc-type"], page_of(named["warc-record-id"])


class Counted:
    """Output whose write returns the number of bytes."""

    def __init__(self, out) -> None:
        self.out = out

    def write(self, data: bytes) -> int:
        if data:
            self.out.write(data)
        return len(data)


def normalise(files: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """Each monolithic file rewritten beside its sidecar index; (file, records), stored. One task a file, however many files there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store.create_dir(root, recursive=True)
                name = f"{root}/{path.rpartition('/')[2]}"
                attempt = TaskContext.get().taskAttemptId()
                n = 0
                with store.open_input_file(path) as raw, store.open_output_stream(f"{name}.{attempt}") as out, store.open_output_stream(f"{name}.idx.{attempt}") as index:
                    for start, length, kind, page_id in normalise_stream(raw, Counted(out), level):
                        index.write(f"{start}\t{length}\t{kind}\t{'' if page_id is None else page_id}\n".encode())
                        n += 1
                store.move(f"{name}.{attempt}", name)
                store.move(f"{name}.idx.{attempt}", f"{name}.idx")
                yield pa.RecordBatch.from_pydict({"file": [name], "records": [n]})

    n = max(1, files.count())
    spread = files.select("file").repartition(min(n, 10_000), "file")
    return stored(spread.mapInArrow(run, "file string, records long"), "normalised")


def index_rows(files: DataFrame, folder: str) -> DataFrame:
    """(file, offset, length, record_type, page_id) of every record, from the sidecars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(f"{path}.idx") as raw:
                    rest = b""
                    while data := raw.read(CHUNK):
                        *lines, rest = (rest + data).split(b"\n")
                        rows = [line.decode().split("\t") for line in lines]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([path] * len(rows), pa.string()), pa.array([int(r[0]) for r in rows], pa.int64()), pa.array([int(r[1]) for r in rows], pa.int64()),
                             pa.array([r[2] for r in rows], pa.string()), pa.array([int(r[3]) if r[3] else None for r in rows], pa.int64())],
                            ["file", "offset", "length", "record_type", "page_id"])

    return files.select("file").mapInArrow(run, "file string, offset long, length long, record_type string, page_id long")


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records behind index rows: page_id, url, record_type, refers_to, payload_digest, payload_bytes and, if asked, the html held."""
    fields = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, html string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(folder)
        held: tuple[str, BinaryIO] | None = None
        for batch in batches:
            rows = []
            for path, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held is None or held[0] != path:
                    if held:
                        held[1].close()
                    held = (path, store.open_input_file(path))
                held[1].seek(offset)
                data = zlib.decompress(held[1].read(length), 31)
                at = data.index(b"\r\n\r\n")
                named = headers_of(data[:at])
                block = data[at + 4: at + 4 + int(named["content-length"])]
                cut = block.index(b"\r\n\r\n")
                payload, digest = block[cut + 4:], named["warc-payload-digest"].removeprefix("sha1:")
                revisit = named["warc-type"] == "revisit"
                if not revisit and base32_sha1(payload) != digest:
                    raise ValueError(f"{path} at {offset}: the payload does not have its digest")
                size = int(headers_of(block[:cut])["content-length"]) if revisit else len(payload)
                rows.append((page_of(named["warc-record-id"]), named["warc-target-uri"], named["warc-type"], page_of(named["warc-refers-to"]) if revisit else None, digest, size, payload.decode() if payloads and not revisit else None))
            if rows:
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "html"])

    return index.select("file", "offset", "length").mapInArrow(run, fields)


def round_trip(pages: DataFrame, min_revisit: int = 0, payloads: bool = False) -> DataFrame:
    """Write, normalise and read back."""
    spark = pages.sparkSession
    raw, clean = fresh_dir(spark, "warc-raw"), fresh_dir(spark, "warc")
    files = normalise(write_archives(pages, raw, min_revisit), clean)
    return read_records(index_rows(files, clean), clean, payloads)


def digest(records: DataFrame) -> DataFrame:
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
