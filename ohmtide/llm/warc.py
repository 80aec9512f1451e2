"""Dictionary-compressed WARC archives (.warc.zst).

An archive begins with a skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary built from the archive's own
records; each record follows as a frame of its own, compressed with that dictionary, so any record can be read alone. Of records
with equal payloads, the one with the smallest page_id is a response, and the others are revisits that refer to it and keep only
its HTTP header; payloads under `revisit_from` bytes are always written whole.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ohmtide.llm import common
from ohmtide.llm.common import join_dealt, scratch_path, shuffle_parts, written

DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "archive string, records bigint, archive_bytes bigint, dictionary_bytes bigint"
RECORDS = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary, archive string, record_offset bigint"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI; a plain path is a local (mounted) one."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri else pafs.FileSystem.from_uri(f"file://{uri.removeprefix('file:')}")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id: int | None, digest: str, shared: bool) -> str:
    """A record's id: of a response that others refer to, by its page and payload, so that they know it; else new."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'x-page:{page_id}:{digest}') if shared else uuid.uuid4()}>"


def _page(value: str | None) -> int | None:
    return int(value) if value else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = "1970-01-01T00:00:00Z", shared: bool = False) -> bytes:
    """One record. Pages are named in fields of our own; `refers_to` is the page of the response that a revisit stands for, and
    `shared` says that others refer to this response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block, digest = http if revisit else http + payload, sha1_base32(payload)
    # A line break would end the header's line.
    target = "".join(c for c in url or "" if c not in "\r\n")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(page_id, digest, shared and not revisit)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Refers-To: {urn(refers_to, digest, True)}", f"X-Refers-To-Page-ID: {'' if refers_to is None else refers_to}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's fields; a response's payload is held against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"{fields['WARC-Record-ID']}: the record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or sha1_base32(payload) != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload is damaged")
    return {
        "page_id": _page(fields.get("X-Page-ID")), "url": fields["WARC-Target-URI"], "record_type": kind, "refers_to": _page(fields.get("X-Refers-To-Page-ID")) if kind == "revisit" else None,
        "payload_digest": digest, "payload_bytes": size, "payload": payload if kind == "response" else None,
    }


def build_dictionary(records: list[bytes], size: int, most: int) -> bytes:
    """A dictionary from records spread evenly over an archive, `most` bytes of them; raw content where there is too little to train
    on."""
    step = max(1, -(-sum(map(len, records)) // most))
    samples = [r[:most] for r in records[::step]]
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def write_archive(uri: str, records: list[bytes], dictionary_size: int, sample_bytes: int, level: int) -> tuple[int, int]:
    """Writes one archive; its size and that of its dictionary."""
    raw = build_dictionary(records, dictionary_size, sample_bytes)
    packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=True, write_checksum=True)
    fs, path = filesystem(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path, compression=None) as out:
        out.write(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
        for r in records:
            out.write(packer.compress(r))
        return out.tell(), len(raw)


def read_archive(uri: str, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of an archive, read as a stream: memory holds a record and a chunk."""
    fs, path = filesystem(uri)
    with fs.open_input_stream(path, compression=None) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != DICTIONARY_MAGIC:
            raise ValueError(f"{uri}: no dictionary frame")
        unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(f.read(size)))
        at, data = 8 + size, f.read(chunk)
        while data:
            frame, out, used = unpacker.decompressobj(), [], 0
            while True:
                out.append(frame.decompress(data))
                if frame.eof:
                    left = frame.unused_data
                    used += len(data) - len(left)
                    break
                used += len(data)
                data = f.read(chunk)
                if not data:
                    raise ValueError(f"{uri}: cut off at {at}")
            yield at, b"".join(out)
            at, data = at + used, left or f.read(chunk)


def write_archives(pages: DataFrame, folder: str, revisit_from: int = 0, archive_bytes: int = 16 << 20, dictionary_size: int = 112_640, sample_bytes: int = 4 << 20, level: int = 3) -> DataFrame:
    """Writes `pages` (page_id, url, html) as archives in `folder`, a URI that all executors reach; their manifest.

    Null html is an empty payload, a null url an empty one. A null page_id sorts after all others and may repeat. Rows that repeat
    the smallest page_id of their payload are all responses. Records are dated by the time of the call. An empty table gives no archive. A task gathers records up to
    `archive_bytes` (a longer record has an archive of its own), trains the dictionary on `sample_bytes` spread over them, and writes
    them under a name of its own attempt; the manifest names only the archives of attempts that ended, so nothing is read twice
    after an executor is lost.
    """
    spark = pages.sparkSession
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), html.alias("payload"), F.octet_length(html).alias("size"), F.sha2(html, 256).alias("key"))
    shared = rows.where(F.col("size") >= revisit_from).groupBy("key").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(shared, "warc-shared")
    # Most payloads are alone; those that are not are few enough to send, or else are joined by a shuffle, but for hot ones.
    few, n_shared, firsts = common.BROADCAST_ROWS, shared.count(), shared.select("key", "first_id")
    rows = rows.join(F.broadcast(firsts), ["key"], "left") if n_shared <= few else join_dealt(rows, firsts, shared.select("key", F.col("n").alias("ohmtide_n")), ["key"], "left")
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = rows.withColumn("revisit", F.expr(f"size >= {revisit_from} AND first_id IS NOT NULL AND NOT page_id <=> first_id"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records: list[bytes] = []
        done: list[tuple] = []

        def flush() -> None:
            uri = f"{folder}/{uuid.uuid4().hex}.warc.zst"
            done.append((uri, len(records), *write_archive(uri, records, dictionary_size, sample_bytes, level)))
            records.clear()

        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, first, revisit = (batch.column(k)[i].as_py() for k in range(5))
                r = record(page_id, url, payload, first, revisit, date, first is not None)
                if records and size + len(r) > archive_bytes:
                    flush()
                    size = 0
                records.append(r)
                size += len(r)
        if records:
            flush()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["archive", "records", "archive_bytes", "dictionary_bytes"])

    return written(rows.select("page_id", "url", "payload", "first_id", "revisit").mapInArrow(write, MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the archives that a manifest names, checked; `payloads`: with their bytes, else null. An empty manifest gives no
    rows; a record without a page has a null page_id; a damaged or cut archive is an error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("archive", pa.string()), ("record_offset", pa.int64())])
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                lot, size = [], 0
                for at, raw in read_archive(uri):
                    lot.append(parse(raw) | {"archive": uri, "record_offset": at} | ({} if payloads else {"payload": None}))
                    size += len(raw) if payloads else 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(lot, schema)
                        lot, size = [], 0
                if lot:
                    yield pa.RecordBatch.from_pylist(lot, schema)

    dealt = manifest.select("archive").repartition(shuffle_parts(manifest.sparkSession))
    return dealt.mapInArrow(read, RECORDS)


def archive_folder(spark) -> str:
    return scratch_path(spark, "warc")
