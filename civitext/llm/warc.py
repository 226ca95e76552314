"""WARC archives through a table of chunks.

A payload goes in and out as rows (record, chunk number, bytes), so that no Python
task holds a whole record: the writer copies chunk after chunk into the archive, the
reader yields chunk after chunk with the digest of the payload up to there. The last
chunk's running digest is the payload's.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civitext.llm.token_files import store_of
from civitext.session import stage, stage_path

CHUNK = 1 << 16
DATE = "2024-01-01T00:00:00Z"
_CRLF = b"\r\n"
_BATCH_BYTES = 1 << 22


def _safe(value: str) -> str:
    """Header value without controls, blanks or bytes above 127, percent-encoded."""
    return re.sub(rb"[^\x21-\x7e]", lambda m: b"%%%02X" % m[0][0], value.encode("utf-8", "surrogatepass")).decode()


def payload_chunks(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url", chunk: int = CHUNK) -> DataFrame:
    """(key, url, size, sha1, refers_to, chunk_no, data): pages as rows of chunks, decided.

    Of pages with equal payloads the largest key is the response, `refers_to` is null;
    the others refer to it and carry no data. Payloads are UTF-8; a null one is empty.
    Pages with a null key refer to a page with one if there is any, else they are all
    responses; rows that repeat the largest key are all responses.
    """
    raw = F.coalesce(F.col(f"`{payload}`"), F.lit("")).cast("binary")
    read = pages.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{url}`").alias("url"), raw.alias("data"))
    read = read.withColumn("size", F.octet_length("data").cast("long")).withColumn("sha1", F.sha1("data"))
    first = read.groupBy("sha1", "size").agg(F.max("key").alias("head"), F.count(F.lit(1)).alias("copies"))
    repeated = stage(first.filter("copies > 1").select("sha1", "size", "head"), "repeated")
    decided = read.join(repeated, ["sha1", "size"], "left")
    refers = F.when(~F.col("key").eqNullSafe(F.col("head")), F.col("head"))
    decided = decided.withColumn("refers_to", refers)
    numbers = F.sequence(F.lit(0), F.when(F.col("refers_to").isNull(), F.greatest(F.ceil(F.col("size") / chunk) - 1, F.lit(0))).otherwise(0).cast("int"))
    cut = decided.select("key", "url", "size", "sha1", "refers_to", "data", F.explode(numbers).alias("chunk_no"))
    part = F.substring(F.col("data"), F.col("chunk_no") * chunk + 1, F.lit(chunk))
    return cut.select(
        "key", "url", "size", "sha1", "refers_to", "chunk_no", F.when(F.col("refers_to").isNull(), part).alias("data")
    )


def _head(row: dict) -> tuple[bytes, bytes]:
    """Record headers and HTTP headers of a record."""
    name = "" if row["key"] is None else str(row["key"])
    sha1 = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
    revisit = row["refers_to"] is not None
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{sha1}", f"X-Payload-Length: {row['size']}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (0 if revisit else row['size'])}",
    ]
    if row["url"] is not None:
        lines.append(f"WARC-Target-URI: {_safe(row['url'])}")
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{row['refers_to']}>",
        ]
    return "\r\n".join(lines).encode() + _CRLF + _CRLF, http


def _archiver(folder: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = store_of(folder)
        name, records, packer = f"{uuid.uuid4().hex}.warc.gz", 0, None
        with store.open_output_stream(f"{path}/{name}", compression=None) as out:
            for batch in batches:
                for at in range(batch.num_rows):
                    row = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                    if row["chunk_no"] == 0:
                        if packer:
                            out.write(packer.compress(_CRLF * 2) + packer.flush())
                        packer, records = zlib.compressobj(6, zlib.DEFLATED, 31), records + 1
                        out.write(packer.compress(b"".join(_head(row))))
                    out.write(packer.compress(row["data"] or b""))
            if packer:
                out.write(packer.compress(_CRLF * 2) + packer.flush())
        if records:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records])], ["name", "records"])

    return run


def write_warc(chunks: DataFrame, folder: str) -> DataFrame:
    """(name, records): one archive for each task that has records, a gzip member each.

    Chunks of a record follow each other in one task, as `payload_chunks` makes them.
    Archives of lost or repeated tasks are not listed.
    """
    store, path = store_of(folder)
    store.create_dir(path, recursive=True)
    return stage(chunks.mapInArrow(_archiver(folder), "name string, records long"), "archives")


class _Source:
    """Bytes of an archive of gzip members, by line and by size."""

    def __init__(self, file) -> None:
        self.file, self.packed, self.ready, self.unpacker = file, b"", b"", None

    def _more(self) -> bool:
        while True:
            if not self.packed:
                self.packed = self.file.read(1 << 18)
                if not self.packed:
                    return False
            if self.unpacker is None:
                self.unpacker = zlib.decompressobj(31)
            got = self.unpacker.decompress(self.packed, 1 << 18)
            self.packed = self.unpacker.unconsumed_tail or self.unpacker.unused_data
            if self.unpacker.eof:
                self.unpacker = None
            if got:
                self.ready += got
                return True

    def line(self) -> bytes | None:
        while (at := self.ready.find(b"\n")) < 0:
            if not self._more():
                return None
        out, self.ready = self.ready[: at + 1], self.ready[at + 1 :]
        return out.rstrip(_CRLF)

    def take(self, size: int) -> bytes:
        while len(self.ready) < size:
            if not self._more():
                raise EOFError("the archive ends inside a record")
        out, self.ready = self.ready[:size], self.ready[size:]
        return out

    def headers(self) -> dict[str, str]:
        out = {}
        while line := self.line():
            name, _, value = line.decode().partition(":")
            out[name.lower()] = value.strip()
        return out


_CHUNKS = pa.schema(
    [
        ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()),
        ("payload_length", pa.int64()), ("payload_digest", pa.string()), ("chunk_no", pa.int32()),
        ("data", pa.binary()), ("digest", pa.string()), ("last", pa.bool_()),
    ]
)
CHUNK_COLUMNS = (
    "record_id string, record_type string, refers_to string, target_uri string, payload_length long, "
    "payload_digest string, chunk_no int, data binary, digest string, last boolean"
)


def records_of(file, chunk: int = CHUNK) -> Iterator[dict]:
    """Chunk rows of one archive, read from its start to its end."""
    source = _Source(file)
    while (line := source.line()) is not None:
        if not line.startswith(b"WARC/"):
            continue
        head = source.headers()
        left = int(head["content-length"])
        before = {"record_id": head.get("warc-record-id"), "record_type": head.get("warc-type"),
                  "refers_to": head.get("warc-refers-to"), "target_uri": head.get("warc-target-uri"),
                  "payload_digest": head.get("warc-payload-digest"),
                  "payload_length": int(head["x-payload-length"]) if "x-payload-length" in head else None}
        if head.get("content-type", "").startswith("application/http"):
            while True:
                line = source.line()
                if line is None:
                    raise EOFError("the archive ends inside a record")
                left -= len(line) + 2
                if not line:
                    break
        running, number = hashlib.sha1(), 0
        while True:
            data = source.take(min(left, chunk))
            left -= len(data)
            running.update(data)
            done = base64.b32encode(running.digest()).decode()
            yield {**before, "chunk_no": number, "data": data, "digest": done, "last": not left}
            number += 1
            if not left:
                break


def _opener(folder: str, chunk: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = store_of(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with store.open_input_stream(f"{path}/{name}", compression=None) as file:
                    rows, size = [], 0
                    for row in records_of(file, chunk):
                        rows.append(row)
                        size += len(row["data"]) + 500
                        if size > _BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, _CHUNKS)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, _CHUNKS)

    return run


def read_warc(archives: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """Chunk rows of the listed archives: one task for each archive, in bounded batches.

    `digest` is the SHA-1 in base32 of the payload up to the chunk's end; `last` marks a
    record's last chunk. A revisit has one empty chunk. A record without payload has one too.
    """
    return archives.repartition(max(archives.count(), 1), "name").mapInArrow(_opener(folder, chunk), CHUNK_COLUMNS)


def archived_pages(pages: DataFrame, folder: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Chunk rows of `pages` after a round through archives in `folder`."""
    folder = folder or warc_folder(pages.sparkSession)
    return read_warc(write_warc(payload_chunks(pages, chunk=chunk), folder), folder, chunk)


def page_records(chunks: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) from chunk rows.

    Length and digest of a response are those of the bytes read; a revisit has those of
    the payload it stands for, from its headers.
    """
    ends = chunks.filter("last")
    revisit = F.col("record_type") == "revisit"

    def page(name: str):
        return F.nullif(F.regexp_extract(name, "^<urn:page:(-?[0-9]+)>$", 1), F.lit("")).cast("long")

    read_bytes = F.col("chunk_no").cast("long") * CHUNK + F.octet_length("data")
    return ends.select(
        page("record_id").alias("page_id"),
        F.when(revisit, F.col("payload_length")).otherwise(read_bytes).alias("payload_bytes"),
        F.when(revisit, F.replace("payload_digest", F.lit("sha1:"), F.lit(""))).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )


def warc_folder(spark: SparkSession) -> str:
    return stage_path(spark, "warc")
