"""WARC archives: a writer with payload deduplication and a splittable reader.

The archives hold one gzip member per record. The writer hashes pages to files by page_id, so that a task that is run
again writes the same file; it writes under another name and renames at the end. Equal payloads are found on narrow
(page_id, digest) rows, counted before they are joined.

The reader cuts files into byte ranges. A task looks for gzip's magic bytes from the start of its range, takes a
candidate only if what it decodes to begins with the headers of a WARC record, and then follows the chain of members;
it owns the records that start inside its range, whose ends may lie beyond. After a damaged member it looks for the
next magic bytes. (A range that starts inside a member which holds, uncompressed, the bytes of another WARC member
would take that for a record; the writer always compresses.)

Defined results: a null html is an empty payload; a null url leaves the target out; rows that share the smallest
page_id of a payload are all responses; a null page_id never refers to or is referred to, its record is a response
and its page_id null again. Empty tables give archives without pages. Damaged or truncated members give no row.
Further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import shared

MAGIC = b"\x1f\x8b\x08"
#: Bytes that a reading task is given, bytes after which a writer begins another file, bytes read at once until the headers are complete.
SPLIT, FILE, HEADERS = 8 << 20, 256 << 20, 1 << 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "path string, offset long, warc_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, digest_ok boolean, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))])
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [("WARC-Record-ID", _uri(page_id)), ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload))]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if refers_to is None:
        return record("response", head, http + payload)
    return record("revisit", [*head, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", _uri(refers_to))], http)


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload a page of smaller id has too."""
    narrow = pages.select("page_id", F.expr("sha1(CAST(coalesce(html, '') AS BINARY))").alias("digest"), F.expr("octet_length(coalesce(html, ''))").alias("size")).filter(F.col("size") >= min_bytes)
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).filter("refers_to <> last")
    return narrow.join(first, "digest").filter("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def _pages(batch: pa.RecordBatch):
    """(page_id, url, payload, refers_to) of each row, made one at a time: a batch may hold many long pages."""
    page_id, url, html, refers_to = batch.columns
    for row in zip(page_id, url, html.cast(pa.binary()), refers_to, strict=True):
        i, u, h, r = (x.as_py() for x in row)
        yield i, u, h or b"", r


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE) -> DataFrame:
    """Writes the archives and returns their table: path, bytes, records (itself written to the shared folder)."""
    marked = pages.select("page_id", "url", "html", F.expr("sha1(CAST(coalesce(html, '') AS BINARY))").alias("digest"))
    rows = marked.join(revisits(pages, min_bytes), ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        out, done, k = None, [], 0

        def close():
            final = f"{root}/pages-{task.partitionId():06d}-{k:04d}.warc.gz"
            out.close()
            fs.move(temp, final)
            done.append((f"{folder.rstrip('/')}/{os.path.basename(final)}", size, n))

        for batch in batches:
            for page_id, url, payload, refers_to in _pages(batch):
                if out is None:
                    temp, size, n = f"{root}/.{task.partitionId()}-{task.taskAttemptId()}-{k}", 0, 0
                    out = fs.open_output_stream(temp, compression=None)
                    info = record("warcinfo", [("WARC-Record-ID", f"<urn:file:{task.partitionId()}:{k}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC file version 1.1\r\n")
                    out.write(info)
                    size += len(info)
                member = page_record(page_id, url, payload, refers_to, date)
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= file_bytes:
                    close()
                    out, k = None, k + 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True) if done else ((), (), ()), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "bytes", "records"])

    return shared.written(rows.mapInArrow(run, "path string, bytes long, records long"), "archives")


class _Window:
    """Random access to a file by buffered pieces."""

    def __init__(self, f, size: int, step: int = 1 << 18):
        self.f, self.size, self.step, self.at, self.data = f, size, step, 0, b""

    def read(self, pos: int) -> bytes:
        """Some bytes from pos on; none at the end."""
        if not self.at <= pos < self.at + len(self.data):
            self.f.seek(pos)
            self.at, self.data = pos, self.f.read(min(self.step, self.size - pos)) if pos < self.size else b""
        return self.data[pos - self.at :]

    def find(self, pos: int, end: int) -> int:
        """Place of the magic bytes at pos <= place < end, or -1."""
        while pos < end:
            data = self.read(pos)
            if len(data) < len(MAGIC):
                self.at, self.data = pos, b""  # the magic may lie across two pieces
                data = self.read(pos)
                if len(data) < len(MAGIC):
                    return -1
            if (k := data.find(MAGIC)) >= 0:
                return pos + k if pos + k < end else -1
            pos += len(data) - len(MAGIC) + 1
        return -1


def _headers(data: bytes) -> tuple[dict[str, str], int] | None:
    """Headers of a record and the length of its head; None if data begins with no record."""
    if not data.startswith(b"WARC/"):
        return None
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    out = {}
    for line in data[:end].split(b"\r\n")[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            return None
        out[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    return (out, end + 4) if "warc-type" in out and out.get("content-length", "").isdigit() else None


def _member(window: _Window, pos: int) -> tuple[bytes, int] | None:
    """The record in the gzip member at pos and the place after the member; None if there is none in full."""
    z, got, told, at = zlib.decompressobj(31), [], False, pos
    begin = tail = b""
    while not z.eof:
        data = window.read(at)
        if not data:
            return None
        try:
            piece = z.decompress(data if told else data[:HEADERS])
        except zlib.error:
            return None
        at += len(data if told else data[:HEADERS])
        got.append(piece)
        if not told:
            begin, tail = (begin + piece[:5])[:5], tail + piece
            if not b"WARC/".startswith(begin):
                return None
            if z.eof or b"\r\n\r\n" in tail:
                if _headers(b"".join(got)) is None:
                    return None
                told = True
            tail = tail[-3:]  # the blank line may lie across two pieces
    return (b"".join(got), at - len(z.unused_data)) if told else None


def records(window: _Window, start: int, end: int):
    """(offset, headers, block) of every record that starts at start <= offset < end."""
    pos = start
    while (pos := window.find(pos, end)) >= 0:
        member = _member(window, pos)
        if member is None:
            pos += 1
            continue
        data, after = member
        headers, head = _headers(data)
        n = int(headers["content-length"])
        if len(data) >= head + n:
            yield pos, headers, data[head : head + n]
        pos = after


def _row(path: str, offset: int, headers: dict[str, str], block: bytes) -> tuple:
    kind, payload, size = headers["warc-type"], None, None
    digest, ok = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None, None
    head, sep, body = block.partition(b"\r\n\r\n")
    if kind == "response" and sep:
        payload, size = body, len(body)
        told, digest = digest, base32_sha1(body)
        ok = told is None or told == digest
    elif kind == "revisit":
        lengths = [line.split(b":", 1)[1].strip() for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")]
        size = int(lengths[0]) if lengths and lengths[0].isdigit() else None
    return path, offset, kind, headers.get("warc-record-id"), headers.get("warc-target-uri"), headers.get("warc-refers-to"), digest, size, ok, payload


def read_archives(spark: SparkSession, files: DataFrame, split: int = SPLIT, with_payload: bool = True) -> DataFrame:
    """Every record of the archives in ``files`` (path, bytes), in the columns of RECORD. with_payload: if false, payloads
    are read and their digests checked as ever, but stay in the Python workers."""
    schema = RECORD if with_payload else RECORD.rpartition(", ")[0]
    n = files.agg(F.coalesce(F.expr(f"sum(ceil(bytes / {split}))"), F.lit(0))).first()[0]
    ranges = files.filter("bytes > 0").select("path", "bytes", F.explode(F.expr(f"sequence(0L, bytes - 1, {split}L)")).alias("start"))
    ranges = ranges.repartition(max(1, min(int(n), 100_000)))

    def run(batches):
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary()]
        names = [c.split()[0] for c in schema.split(", ")]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds[: len(names)], strict=True)], names)

        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, inner = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(inner) as f:
                    rows, held = [], 0
                    for offset, headers, block in records(_Window(f, size), start, min(size, start + split)):
                        rows.append(_row(path, offset, headers, block)[: len(names)])
                        held += len(block) * with_payload
                        if held > 4 << 20 or len(rows) >= 2000:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    return ranges.mapInArrow(run, schema)


def uri(path: str) -> str:
    """A path as a URI, as the archive file systems want it."""
    if path.startswith("file:"):
        return "file:///" + path[5:].lstrip("/")
    return path if "://" in path else "file://" + os.path.abspath(path)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back, one row per page."""
    spark = pages.sparkSession
    files = write_archives(pages, uri(shared.fresh(spark, "warc")), min_bytes)
    got = read_archives(spark, files, with_payload=False).filter("warc_type IN ('response', 'revisit')")

    def number(c):
        return F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(.*)>', 1) AS BIGINT)")

    return got.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to"))
