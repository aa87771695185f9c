"""WARC archives: a writer with one gzip member per record, and a sequential reader.

Pages go to ``.warc.gz`` files in the shared folder, one per task. The reader
streams each file through an incremental zlib decompressor, frames blocks by
Content-Length, and recomputes every stored payload's SHA-1, so that neither a
file nor a payload needs to be held as a whole.

Null html is the empty payload; a null url writes no target. Of equal payloads
the record of the largest page_id is a response and the others revisit it;
repeated rows of that page_id are responses too, and where all ids are null
every record is. Extra columns are ignored; an empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archgraph.llm.common import Scratch, join_hot

CHUNK = 1 << 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(sha: bytes) -> str:
    return base64.b32encode(sha).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None) -> bytes:
    """One gzip member. A revisit's block keeps the HTTP head with the payload's length, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", "WARC-Type: " + ("response" if refers_to is None else "revisit"),
            "WARC-Record-ID: <urn:page:%s>" % ("" if page_id is None else page_id),
            "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http;msgtype=response",
            f"WARC-Payload-Digest: sha1:{sha}", f"WARC-Block-Digest: sha1:{digest(hashlib.sha1(block).digest())}",
            f"Content-Length: {len(block)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() and c != " " else "%%%02X" % ord(c) for c in url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    out = zlib.compressobj(6, zlib.DEFLATED, 31)
    return out.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + out.flush()


class Record:
    """One record as it is read; raises ValueError where framing or digests are wrong."""

    def __init__(self, keep: bool):
        self.buffer, self.headers, self.rest = b"", None, 0
        self.http: bytes | None = b""
        self.block, self.payload, self.length, self.kept = hashlib.sha1(), hashlib.sha1(), 0, [] if keep else None

    def feed(self, data: bytes) -> None:
        self.buffer += data
        if self.headers is None:
            if b"\r\n\r\n" not in self.buffer:
                return
            head, _, self.buffer = self.buffer.partition(b"\r\n\r\n")
            first, *lines = head.decode().split("\r\n")
            if not first.startswith("WARC/"):
                raise ValueError(f"not a WARC record: {first[:40]!r}")
            self.headers = dict(line.split(": ", 1) for line in lines)
            self.rest = int(self.headers["Content-Length"])
        data, self.buffer = self.buffer[:self.rest], self.buffer[self.rest:]
        self.rest -= len(data)
        self.block.update(data)
        if self.http is not None:
            self.http += data
            if b"\r\n\r\n" not in self.http:
                return
            head, _, data = self.http.partition(b"\r\n\r\n")
            self.stated = int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])["Content-Length"])
            self.http = None
        self.payload.update(data)
        self.length += len(data)
        if self.kept is not None:
            self.kept.append(data)

    def row(self, keep: bool) -> tuple:
        h = self.headers
        if h is None or self.rest or self.buffer != b"\r\n\r\n" or self.http is not None:
            raise ValueError("a record ends before its Content-Length or runs over it")
        if h["WARC-Block-Digest"] != "sha1:" + digest(self.block.digest()):
            raise ValueError(f"block digest of {h['WARC-Record-ID']} is wrong")
        sha, kind = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"]
        if kind == "response":
            if self.length != self.stated or digest(self.payload.digest()) != sha:
                raise ValueError(f"payload digest of {h['WARC-Record-ID']} is wrong")
        page = lambda x: int(y) if (y := x.removeprefix("<urn:page:").removesuffix(">")) else None
        to = page(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None
        out = (page(h["WARC-Record-ID"]), self.stated, sha, kind, to)
        return (*out, b"".join(self.kept) if kind == "response" else None) if keep else out


def read_records(stream, keep: bool = False) -> Iterator[tuple]:
    """Records of an open archive: one gzip member after the other, CHUNK bytes at a time."""
    data = stream.read(CHUNK)
    while data:
        member, found = zlib.decompressobj(31), Record(keep)
        while not member.eof:
            if not data:
                raise ValueError("an archive ends within a record")
            found.feed(member.decompress(data, CHUNK))
            data = member.unconsumed_tail or (member.unused_data if member.eof else b"") or stream.read(CHUNK)
        yield found.row(keep)


def write_archives(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Write all pages; the result lists the files: path, records, bytes."""
    marked = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    marked = marked.withColumn("sha", F.sha1(F.encode("html", "utf-8")))
    again = scratch.save(marked.groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
                         .where("n > 1"), "repeated")
    marked = join_hot(marked, again.select("sha", "last"), "sha", again.select("sha", "n"), "left")
    marked = marked.select("page_id", "url", "html", "sha",
                           F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))
    root = scratch.path("archives")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, records, size = None, 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                page, url, html, sha, to = (batch.column(k)[i].as_py() for k in range(5))
                if out is None:  # a task that is tried again writes another file; only listed files are read
                    store, folder = fs.FileSystem.from_uri(root)
                    store.create_dir(folder, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{folder}/{name}", compression=None)
                data = record(page, url, html.encode(), digest(bytes.fromhex(sha)), to)
                out.write(data)
                records, size = records + 1, size + len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{root}/{name}"], "records": [records], "bytes": [size]})

    return scratch.save(marked.mapInArrow(write, "path string, records long, bytes long"), "files")


def read_archives(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to[, payload]) of the listed files."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][:5 + with_payload]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_stream(place, compression=None) as stream:
                    rows, held = [], 0
                    for row in read_records(stream, with_payload):
                        rows.append(row)
                        held += len(row[5] or b"") if with_payload else 0
                        if len(rows) == 10_000 or held > 1 << 24:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    one_each = files.select("path").repartition(max(1, files.count()))
    return one_each.mapInArrow(read, schema + (", payload binary" if with_payload else ""))


def round_trip(pages: DataFrame) -> DataFrame:
    return read_archives(write_archives(pages, Scratch(pages.sparkSession, "warc")))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
m AS (SELECT page_id, html, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (5 * (3 - i % 4))) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM m
"""
