"""WARC archives: written as whole-file gzip streams, normalised to one member a record with a sidecar index, and read back by it.

A file is made by one task under a name of its own attempt, and a manifest row
names it once the task has ended; a task that is lost is run again under another
name, so readers never see a file cut short. Manifests are kept by a reliable
checkpoint, so what is read is written once. Files go through `pyarrow.fs`, to
any store it knows. A record must fit in memory, a file need not.

Nulls: a null html is an empty payload, a null url an empty address, a null
page_id reads back as null. Rows that repeat a page_id with an equal payload
are responses all if that id is the largest.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import parts_for, settled, work_folder, written

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
SPACE = 0x6F1D0C5A8B4E4D2A
LEVEL = 9
READ = 1 << 20


def record_id(page_id: int | None) -> str:
    """A URN that holds the page's id, so that it can be read back."""
    return "<urn:uuid:" + str(uuid.UUID(int=0 if page_id is None else SPACE << 64 | page_id & (1 << 64) - 1)) + ">"


def page_of(urn: str) -> int | None:
    value = uuid.UUID(urn.strip("<>").rpartition(":")[2]).int
    low = value & (1 << 64) - 1
    return None if not value else low - (1 << 64) if low >> 63 else low


def plain(value: str) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = HTTP if revisit else HTTP + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {plain(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def header_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record begins with {lines[0][:40]!r}")
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def records_in(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and whole bytes of each record of an inflated stream."""
    held = bytearray()
    chunks = iter(chunks)

    def fill(n: int) -> bool:
        while len(held) < n:
            more = next(chunks, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        looked = 0
        while (end := held.find(b"\r\n\r\n", max(0, looked - 3))) < 0:
            looked = len(held)
            if not fill(looked + 1):
                if bytes(held).strip():
                    raise ValueError("the stream ends within a record")
                return
        header = header_of(bytes(held[:end]))
        size = end + 4 + int(header["content-length"]) + 4
        if not fill(size):
            raise ValueError("the stream ends within a record")
        yield header, bytes(held[:size])
        del held[:size]


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip file of one member or many, read once."""
    out = zlib.decompressobj(31)
    while data := stream.read(READ):
        while data:
            if out.eof:
                out = zlib.decompressobj(31)
            yield out.decompress(data)
            data = out.unused_data if out.eof else b""
    if not out.eof:
        raise ValueError("the gzip stream is cut short")


def opened(place: str):
    return fs.FileSystem.from_uri(place)


def _create(folder: str, suffix: str):
    store, path = opened(folder)
    store.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    return store.open_output_stream(f"{path}/{name}", compression=None), f"{folder}/{name}"


def write_streams(records: DataFrame, folder: str) -> DataFrame:
    """path, n_records: records(page_id, url, html, refers_to, revisit) as one
    gzip stream a task. Tasks without rows write no file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, n = None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if sink is None:
                    sink, path = _create(folder, ".warc.gz")
                    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                payload = (row["html"] or "").encode()
                sink.write(pack.compress(record(row["page_id"], row["url"] or "", payload, row["refers_to"], row["revisit"])))
                n += 1
        if sink is not None:
            sink.write(pack.flush())
            sink.close()
            yield pa.record_batch([pa.array([path]), pa.array([n], pa.int64())], ["path", "n_records"])

    return settled(records.mapInArrow(write, "path string, n_records bigint"))


def normalised(archives: DataFrame, folder: str) -> DataFrame:
    """path, index_path, n_records of archives rewritten with a member for each
    record. The index has a JSON line for each: offset, length, record id, type."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column("path").to_pylist():
                store, path = opened(source)
                sink, made = _create(folder, ".warc.gz")
                lines, at = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for header, whole in records_in(inflated(stream)):
                        pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = pack.compress(whole) + pack.flush()
                        sink.write(member)
                        lines.append(json.dumps({"offset": at, "length": len(member), "id": header["warc-record-id"], "type": header["warc-type"]}))
                        at += len(member)
                sink.close()
                index, index_path = _create(folder, ".index")
                index.write("\n".join(lines).encode())
                index.close()
                yield pa.record_batch([pa.array([made]), pa.array([index_path]), pa.array([len(lines)], pa.int64())], ["path", "index_path", "n_records"])

    spread = archives.select("path").repartition(parts_for(archives), "path")
    return settled(spread.mapInArrow(rewrite, "path string, index_path string, n_records bigint"))


def read_records(archives: DataFrame) -> DataFrame:
    """Each record of normalised archives, found through the index and inflated by itself."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index_path in zip(batch.column("path").to_pylist(), batch.column("index_path").to_pylist(), strict=True):
                store, inner = opened(index_path)
                with store.open_input_stream(inner, compression=None) as stream:
                    entries = [json.loads(x) for x in stream.read().decode().split("\n") if x]
                store, inner = opened(path)
                with store.open_input_file(inner) as file:
                    for start in range(0, len(entries), 512):
                        out = []
                        for e in entries[start : start + 512]:
                            file.seek(e["offset"])
                            (header, whole), *_ = records_in([zlib.decompress(file.read(e["length"]), 31)])
                            payload = whole[whole.index(b"\r\n\r\n") + 4 + len(HTTP) : -4]
                            revisit = header["warc-type"] == "revisit"
                            stated = base64.b32decode(header["warc-payload-digest"].partition(":")[2]).hex()
                            if not revisit and hashlib.sha1(payload).hexdigest() != stated:
                                raise ValueError(f"{header['warc-record-id']}: the payload does not have its digest")
                            out.append({
                                "page_id": page_of(header["warc-record-id"]), "url": header["warc-target-uri"], "payload_bytes": int(header["warc-payload-length"]), "payload_digest": stated,
                                "record_type": header["warc-type"], "refers_to": page_of(header["warc-refers-to"]) if revisit else None, "payload": None if revisit else payload,
                            })
                        yield pa.RecordBatch.from_pylist(out, schema=READ_SCHEMA)

    return archives.repartition(parts_for(archives), "path").mapInArrow(read, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary")


READ_SCHEMA = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
)


def archived(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Every page written to archives, payloads of `least` bytes or more once, and read back.

    The largest page of each payload is found from narrow rows, counted before
    they are shuffled, and those of payloads that repeat are written as a small
    table. Its size is then known: Spark broadcasts it while it is below the
    session's own limit, and else sorts and joins, where it deals a payload that
    very many pages share to several tasks."""
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", "html").withColumn("_digest", F.unhex(F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))))
    kept = rows.where(F.octet_length("html") >= least).groupBy("_digest").agg(F.max("page_id").alias("_largest"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    kept = written(kept, "warc-largest")
    joined = rows.join(kept, "_digest", "left")
    revisit = F.coalesce(F.col("page_id") < F.col("_largest"), F.lit(False))
    records = joined.select("page_id", "url", F.col("html"), F.when(revisit, F.col("_largest")).alias("refers_to"), revisit.alias("revisit"))
    streams = write_streams(records, work_folder(spark, "warc-streams"))
    return read_records(normalised(streams, work_folder(spark, "warc")))
