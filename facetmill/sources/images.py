"""Image folders: read, decode, crop and describe in one narrow pass."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.images import clahe, crop_bars, decode_pnm, hog
from ..functions.names import base_name, label_of, natural_key, picture_key


def list_images(spark: SparkSession, folder: str, pattern: str = "*.pgm") -> DataFrame:
    """(path, name, label, content) of every image file; an error if there is none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    if files.select("path").isEmpty():
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return named_images(files)


def named_images(files: DataFrame) -> DataFrame:
    """Adds name and label to rows with path and content; also for a stream of files."""
    name = base_name(F.col("path"))
    return files.select("path", name.alias("name"), label_of(name).alias("label"), "content")


def fit_names(files: DataFrame, fit_limit: int) -> DataFrame:
    """(path, where there is one, and name) of the first ``fit_limit`` images in natural order (all, if it is not positive); contents are not read."""
    names = files.select(*[c for c in ("path", "name") if c in files.columns])
    return names.orderBy(natural_key(F.col("name")), "name", *({"path"} & set(names.columns))).limit(fit_limit) if fit_limit > 0 else names


def _with(df: DataFrame, dropped: set[str], added: str) -> tuple[list[str], StructType]:
    """The columns that a pass keeps as they are, and its schema."""
    kept = [f for f in df.schema.fields if f.name not in dropped]
    return [f.name for f in kept], StructType([*kept, *StructType.fromDDL(added).fields])


def cropped(files: DataFrame) -> DataFrame:
    """Decoded images without their gray side bars in place of content; files that can't be read have null h, w and pix."""
    kept, schema = _with(files, {"content"}, "h int, w int, left int, right int, pix array<float>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for content in batch.column("content").to_pylist():
                image = decode_pnm(content)
                if image is None:
                    rows.append((None,) * 5)
                else:
                    image, left, right = crop_bars(image)
                    rows.append((*image.shape, left, right, image.ravel()))
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float32())]
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *made], names=schema.names)

    return files.mapInArrow(run, schema)


def described(images: DataFrame, equalise: bool = True) -> DataFrame:
    """The gradient histogram, features, of each (equalised) image in place of its pixels."""
    kept, schema = _with(images, {"left", "right", "pix"}, "features array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for h, w, pix in zip(batch.column("h").to_pylist(), batch.column("w").to_pylist(), batch.column("pix"), strict=True):
                image = np.asarray(pix.values).reshape(h, w)
                found.append(hog(clahe(image) if equalise else image))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(found, pa.list_(pa.float64()))], names=schema.names)

    return images.where("pix is not null").select(*kept, "pix").mapInArrow(run, schema)


def in_picture_order(predictions: DataFrame) -> DataFrame:
    """(name, prediction) sorted by picture key over range partitions: the whole table's order is that of its partitions."""
    key = picture_key(F.col("name"))
    parts = int(predictions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return predictions.select("name", "prediction").repartitionByRange(parts, key, "name").sortWithinPartitions(key, "name")


def write_line(predictions: DataFrame, path: str) -> None:
    """The predictions in picture order, each followed by a comma, as text files that together, in the order of their names, are one line.

    Every task writes a part of it; nothing is gathered.
    """
    in_picture_order(predictions).select(F.col("prediction").cast("string").alias("value")).write.mode("overwrite").option("lineSep", ",").text(path)


def prediction_line(predictions: DataFrame) -> DataFrame:
    """One row, ``value``: the line that write_line writes. Tasks join their parts of it; one row holds it all in the end."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for i, batch in enumerate(batches):
            text = "".join(f"{p}," for p in batch.column("prediction").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + i]), pa.array([text])], names=["at", "text"])

    parts = in_picture_order(predictions).mapInArrow(joined, "at bigint, text string")
    return parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "").alias("value"))


def first_files(files: DataFrame, fit_limit: int) -> DataFrame:
    """The first ``fit_limit`` images in natural order (all, if it is not positive): their paths are chosen by name, and only these files are opened."""
    if fit_limit <= 0:
        return files
    paths = [r.path for r in fit_names(files, fit_limit).collect()]  # at most fit_limit
    literal = lambda path: re.sub(r"([\[\]{}*?\\])", r"\\\1", path)
    return named_images(files.sparkSession.read.format("binaryFile").load([literal(p) for p in paths])) if paths else files
