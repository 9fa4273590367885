"""WARC archives in seekable Zstandard bundles.

Every page is one WARC/1.1 record. Records are grouped into independent
Zstandard frames of about ``frame_bytes``; a bundle is a file of such frames
with a seek table in a skippable frame at its end, so one frame can be read
without the rest, by any Zstandard reader. An index table maps each record's
identifier to its bundle, frame and place inside the frame.

Of the pages whose payloads are equal and not short, that with the largest id
is written in full (response) and the others refer to it (revisit). Which pages
refer to which is settled on (id, digest) rows alone; the pages themselves are
written by the tasks that read them. Only where the table of revisits is too
large for Spark to broadcast are pages dealt out by id.

A task writes its bundles under temporary names and renames them when done, so
an attempt that is run again leaves the same files.

Defined results: a null payload is empty, a null url is written without target;
repeated rows are written each for itself (rows that share the largest id are
all responses); a page without id may refer to others, but is referred to by
none. Columns besides page_id, url and html are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, shuffle_partitions

# Fixed values of the seekable format: a skippable frame's magic number, and the seek table's own.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Payloads below this many bytes are never revisits.
LEAST_BYTES = 1000
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 128 << 20
LEVEL = 3


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame that ends a bundle; frames: (compressed, decompressed) sizes."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(read_at, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed, decompressed) of each frame; ``read_at(offset, n)`` reads the bundle."""
    count, flags, magic = struct.unpack("<IBI", read_at(size - 9, 9))
    if magic != SEEKABLE:
        raise ValueError("the bundle has no seek table")
    entry = 12 if flags & 0x80 else 8
    raw = read_at(size - 9 - entry * count, entry * count)
    out, at = [], 0
    for i in range(count):
        packed, plain = struct.unpack_from("<II", raw, entry * i)
        out.append((at, packed, plain))
        at += packed
    return out


def _line(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, n_bytes: int, refers_to: int | None) -> tuple[str, bytes]:
    """A record's identifier and bytes."""
    name = f"<urn:page:{'' if page_id is None else page_id}>"
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name}", "WARC-Date: 1970-01-01T00:00:00Z",
        *([] if url is None else [f"WARC-Target-URI: {_line(url)}"]), f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {n_bytes}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(plain: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, payload) of each record of a decompressed frame."""
    at = 0
    while at < len(plain):
        end = plain.index(b"\r\n\r\n", at)
        lines = plain[at:end].decode().split("\r\n")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        start, n = end + 4, int(headers["content-length"])
        block = plain[start : start + n]
        yield at, headers, block[block.index(b"\r\n\r\n") + 4 :]
        at = start + n + 4


class _Bundle:
    """One file being written: frames, then the seek table."""

    def __init__(self, filesystem: pafs.FileSystem, folder: str, name: str):
        self.fs, self.name, self.to = filesystem, name, f"{folder}/{name}"
        self.part = f"{folder}/.{name}.{uuid.uuid4().hex}"
        self.out = filesystem.open_output_stream(self.part)
        self.frames: list[tuple[int, int]] = []
        self.size = 0

    def add(self, plain: bytes) -> None:
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(plain)
        self.out.write(packed)
        self.frames.append((len(packed), len(plain)))
        self.size += len(packed)

    def close(self) -> None:
        self.out.write(seek_table(self.frames))
        self.out.close()
        self.fs.move(self.part, self.to)


def revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, refers_to) of the pages whose payload another page with a larger id has as well."""
    html = F.coalesce("html", F.lit(""))
    keyed = pages.where(F.octet_length(html) >= least_bytes).select("page_id", F.sha2(html.cast("binary"), 256).alias("payload_key"))
    shared = keyed.groupBy("payload_key").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    return keyed.join(shared, "payload_key").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "payload_key", "refers_to").distinct()


def write_archives(pages: DataFrame, out: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes bundles below ``out`` and returns the index table, also written there: record_id, page_id, bundle, frame, frame_offset, frame_bytes, offset."""
    names = ["record_id", "page_id", "bundle", "frame", "frame_offset", "frame_bytes", "offset"]
    folder = f"{out}/bundles"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, path = pafs.FileSystem.from_uri(folder)
        filesystem.create_dir(path, recursive=True)
        # Only the index of the attempt that counts is kept, so each attempt of a task writes bundles of its own.
        task, attempt, number, bundle = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], 0, None
        rows, plain = [], bytearray()

        def end_frame() -> list[tuple]:
            nonlocal bundle, number, plain
            if bundle is None:
                bundle, number = _Bundle(filesystem, path, f"part-{task:06d}-{attempt}-{number:04d}.warc.zst"), number + 1
            at, frame = bundle.size, len(bundle.frames)
            bundle.add(bytes(plain))
            done = [(r, p, bundle.name, frame, at, bundle.size - at, o) for r, p, o in rows]
            rows.clear()
            plain = bytearray()
            if bundle.size >= bundle_bytes:
                bundle.close()
                bundle = None
            return done

        index: list[tuple] = []
        for batch in batches:
            for page in batch.to_pylist():
                payload = (page["html"] or "").encode()
                name, raw = record(page["page_id"], page["url"], payload, hashlib.sha1(payload).hexdigest(), len(payload), page["refers_to"])
                rows.append((name, page["page_id"], len(plain)))
                plain += raw
                if len(plain) >= frame_bytes:
                    index += end_frame()
            if index:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in index], schema=arrow)
                index = []
        if rows:
            index = end_frame()
        if bundle is not None:
            bundle.close()
        if index:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in index], schema=arrow)

    arrow = pa.schema([(n, {"record_id": pa.string(), "bundle": pa.string(), "frame": pa.int32()}.get(n, pa.int64())) for n in names])
    refs = revisits(pages, least_bytes).withColumnsRenamed({"page_id": "ref_id", "payload_key": "ref_key"})
    key = F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)
    rows = pages.select("page_id", "url", "html", key.alias("payload_key")).join(refs, F.col("page_id").eqNullSafe(F.col("ref_id")) & (F.col("payload_key") == F.col("ref_key")), "left")
    index = rows.select("page_id", "url", "html", "refers_to").mapInArrow(write, "record_id string, page_id bigint, bundle string, frame int, frame_offset bigint, frame_bytes bigint, offset bigint")
    index.write.parquet(f"{out}/index")
    return pages.sparkSession.read.parquet(f"{out}/index")


def read_archives(spark: SparkSession, out: str) -> DataFrame:
    """Every record of the bundles below ``out``, from the files alone: record_id, page_id, payload, payload_bytes, payload_digest, record_type, refers_to."""
    bundles = spark.read.parquet(f"{out}/index").select("bundle").distinct()
    folder = f"{out}/bundles"
    schema = "record_id string, page_id bigint, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"

    def number(name: str | None) -> int | None:
        digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, path = pafs.FileSystem.from_uri(folder)
        columns = ["record_id", "page_id", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = pa.schema(list(zip(columns, [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()], strict=True)))
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with filesystem.open_input_file(f"{path}/{name}") as f:
                    read_at = lambda at, n: (f.seek(at), f.read(n))[1]
                    for at, packed, plain in read_seek_table(read_at, f.size()):
                        found = []
                        for _, h, payload in parse_records(zstandard.ZstdDecompressor().decompress(read_at(at, packed), max_output_size=plain)):
                            full = h["warc-type"] == "response"
                            n_bytes = len(payload) if full else int(h["x-payload-length"])
                            digest = hashlib.sha1(payload).hexdigest() if full else h["warc-payload-digest"].removeprefix("sha1:")
                            found.append((h["warc-record-id"], number(h["warc-record-id"]), payload, n_bytes, digest, h["warc-type"], number(h.get("warc-refers-to"))))
                        yield pa.RecordBatch.from_pylist([dict(zip(columns, r, strict=True)) for r in found], schema=types)

    return bundles.repartition(shuffle_partitions(spark), "bundle").mapInArrow(read, schema)


def read_record(out: str, bundle: str, frame_offset: int, frame_bytes: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record by its place in the index: reads its frame only."""
    filesystem, path = pafs.FileSystem.from_uri(f"{out}/bundles")
    with filesystem.open_input_file(f"{path}/{bundle}") as f:
        f.seek(frame_offset)
        plain = zstandard.ZstdDecompressor().decompressobj().decompress(f.read(frame_bytes))
    return next((h, payload) for at, h, payload in parse_records(plain) if at == offset)


def archive_round_trip(pages: DataFrame, out: str | None = None) -> DataFrame:
    """Writes all pages and reads the archives back: one row per record, without payloads."""
    spark = pages.sparkSession
    out = out or shared_dir(spark, "warc")
    write_archives(pages, out)
    return read_archives(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
