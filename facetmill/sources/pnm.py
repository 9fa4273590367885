"""Gray image files as a Spark data source, ``pnm``: read with just the columns asked for, written as one file a row.

Reading takes a schema of any of the columns in COLUMNS; a file is opened only
if its size in pixels or the pixels are among them::

    spark.dataSource.register(PnmSource)
    spark.read.format("pnm").schema("path string, label int").load(folder)    # opens nothing
    images.select("name", "h", "w", "pix").write.format("pnm").mode("append").save(folder)

Options: ``pattern`` of the names (``*.pgm``), ``partitionBytes`` (64 MB). Folders
are those that ``pyarrow.fs`` knows (local, hdfs, s3, gs, abfs). Listing them is
the driver's work, as for Spark's own files; contents are read by the tasks, a
few megabytes at a time.
"""

from __future__ import annotations

import fnmatch
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.images import decode_pnm

COLUMNS = "path string, name string, label int, length bigint, modified timestamp, h int, w int, pix array<float>"
KINDS = {"path": pa.string(), "name": pa.string(), "label": pa.int32(), "length": pa.int64(), "modified": pa.timestamp("us", "UTC"), "h": pa.int32(), "w": pa.int32(), "pix": pa.list_(pa.float32())}
#: Columns for which a file must be opened.
INSIDE = {"h", "w", "pix"}
#: Contents a task holds at a time.
HELD_BYTES = 16 << 20
#: What opening and describing a small file costs, as if it were so many bytes more.
OPEN_BYTES = 1 << 14
_NAME, _LABEL = re.compile(r"[^/\\]+"), re.compile(r"p(\d+)_i")


def file_system(path: str) -> tuple[pafs.FileSystem, str, str]:
    """(file system, the path within it, what to put before such a path to get Spark's form of it)."""
    m = re.match(r"([a-zA-Z][a-zA-Z0-9+.-]*):(?://([^/]*))?(/.*)?$", path, re.DOTALL)
    if not m or m[1] == "file":
        return pafs.LocalFileSystem(), m[3] or "/" if m else path, "file:"
    scheme = {"s3a": "s3", "s3n": "s3"}.get(m[1], m[1])
    found, base = pafs.FileSystem.from_uri(f"{scheme}://{m[2] or ''}/")
    base = base.strip("/")
    return found, f"{base}{m[3] or '/'}", f"{m[1]}://{(m[2] or '').removesuffix(base)}"


def content_of(path: str) -> bytes | None:
    """A file's bytes; None if it can't be read."""
    fs, inner, _ = file_system(path)
    try:
        with fs.open_input_stream(inner) as f:
            return f.read()
    except OSError:
        return None


def opened(files: DataFrame, partition_bytes: int = 64 << 20) -> DataFrame:
    """Adds content to rows with path and length, dealt evenly over as many tasks as the bytes and the number of files need; null if a file is gone or can't be read."""
    total = files.agg(F.sum(F.coalesce("length", F.lit(0)) + OPEN_BYTES).alias("n")).first().n or 0
    kept = files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, sizes, at = batch.column("path").to_pylist(), batch.column("length").to_pylist(), 0
            while at < len(paths):
                end, held = at, 0
                while end < len(paths) and (end == at or held + (sizes[end] or 0) <= HELD_BYTES):
                    held += sizes[end] or 0
                    end += 1
                rows = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in kept], pa.array([content_of(p) for p in paths[at:end]], pa.binary())], names=[*kept, "content"])
                at = end

    return files.repartition(max(1, -(-total // partition_bytes))).mapInArrow(run, StructType([*files.schema.fields]).add("content", "binary"))


@dataclass
class Files(InputPartition):
    rows: list  # (path, length, modified in nanoseconds)


class PnmReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.folder, self.pattern = options["path"], options.get("pattern", "*.pgm")
        self.size = int(options.get("partitionbytes", options.get("partitionBytes", 64 << 20)))
        self.columns = schema.names
        unknown = set(self.columns) - set(KINDS)
        if unknown:
            raise ValueError(f"no such columns: {sorted(unknown)}; there are {COLUMNS}")

    def partitions(self) -> list[Files]:
        fs, inner, before = file_system(self.folder)
        found = [f for f in fs.get_file_info(pafs.FileSelector(inner)) if f.type == pafs.FileType.File and fnmatch.fnmatchcase(f.base_name, self.pattern) and f.base_name[0] not in "._"]
        if not found:
            raise FileNotFoundError(f"no {self.pattern} in {self.folder}")
        parts, held = [Files([])], 0
        for f in sorted(found, key=lambda f: f.path):
            weight = f.size + (1 << 12)  # opening a file costs something too
            if parts[-1].rows and held + weight > self.size:
                parts.append(Files([]))
                held = 0
            parts[-1].rows.append((before + f.path, f.size, f.mtime_ns))
            held += weight
        return parts

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        inside, at = INSIDE & set(self.columns), 0
        while at < len(partition.rows):
            rows, held = [], 0
            while at < len(partition.rows) and len(rows) < 10_000 and (not rows or not inside or held + partition.rows[at][1] <= HELD_BYTES):
                rows.append(partition.rows[at])
                held += partition.rows[at][1]
                at += 1
            names = [p.rsplit("/", 1)[-1] for p, _, _ in rows]
            images = [decode_pnm(content_of(p)) for p, _, _ in rows] if inside else []
            made = {
                "path": lambda: [p for p, _, _ in rows],
                "name": lambda: names,
                "label": lambda: [int(m[1]) if m and int(m[1]) < 1 << 31 else -1 for m in map(_LABEL.match, names)],
                "length": lambda: [n for _, n, _ in rows],
                "modified": lambda: [(ns or 0) // 1000 for _, _, ns in rows],
                "h": lambda: [None if i is None else i.shape[0] for i in images],
                "w": lambda: [None if i is None else i.shape[1] for i in images],
                "pix": lambda: [None if i is None else i.ravel() for i in images],
            }
            yield pa.RecordBatch.from_arrays([pa.array(made[c](), KINDS[c]) for c in self.columns], names=self.columns)


class PnmWriter(DataSourceArrowWriter):
    """Each row becomes a file; it appears under its name when it is whole, so a task that runs again writes the same files again."""

    def __init__(self, options: dict, schema: StructType):
        self.folder = options["path"]
        missing = {"name", "h", "w", "pix"} - set(schema.names)
        if missing:
            raise ValueError(f"needs the columns {sorted(missing)}")
        fs, inner, _ = file_system(self.folder)
        fs.create_dir(inner, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, inner, _ = file_system(self.folder)
        inner = inner.rstrip("/")
        for batch in iterator:
            for name, h, w, pix in zip(*[batch.column(batch.schema.get_field_index(c)) for c in ("name", "h", "w", "pix")], strict=True):
                name, h, w = name.as_py(), h.as_py(), w.as_py()
                if not name or not _NAME.fullmatch(name) or name[0] in "._":
                    raise ValueError(f"not a file name: {name!r}")
                values = np.clip(np.rint(np.asarray(pix.values, dtype=np.float64)), 0, 255).astype(np.uint8)
                if not h or not w or len(values) != h * w:
                    raise ValueError(f"{name}: {len(values)} pixels are not {h} x {w}")
                temporary = f"{inner}/_{uuid.uuid4().hex}"
                with fs.open_output_stream(temporary) as f:
                    f.write(b"P5\n%d %d\n255\n" % (w, h) + values.tobytes())
                fs.move(temporary, f"{inner}/{name}")
        return WriterCommitMessage()


class PnmSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pnm"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> PnmReader:
        return PnmReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> PnmWriter:
        if overwrite:
            raise ValueError("only appends")
        return PnmWriter(self.options, schema)


def read_pnm(spark: SparkSession, folder: str, columns: str = COLUMNS, pattern: str = "*.pgm") -> DataFrame:
    """The folder's images with the columns given as a schema; an error if there is none."""
    spark.dataSource.register(PnmSource)
    return spark.read.format("pnm").schema(columns).option("pattern", pattern).load(folder)


def write_pnm(images: DataFrame, folder: str) -> None:
    """A P5 file for each row of (name, h, w, pix), pixels rounded to 0 to 255; names must be unique, the folder may hold others."""
    images.sparkSession.dataSource.register(PnmSource)
    images.select("name", "h", "w", "pix").write.format("pnm").mode("append").save(folder)
