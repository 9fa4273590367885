"""A feature store of an image folder: each refresh describes only files that are new or changed.

Below the store's folder lie ``parts`` (features), ``manifests`` (which file, by
path, length and time, is in which part), ``pipelines`` (what was fitted) and
``versions``, a table to which each refresh appends one row at its very end.
Readers take the newest row, so a refresh that dies leaves the version before.
The version names all it needs; nothing that is written is changed later. If two
refreshes run at once both are whole, and the one that counts is the same for
all readers.

The parameters are fitted on the first files in natural order, as in a fresh
run: if these files change, all is fitted and described anew, unless
``keep_fit`` holds on to the parameters that are there.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.images import fit_names
from ..sources.pnm import opened
from ..sources.shared import written
from .prepare import Pipeline, apply_pipeline, fit_pipeline, listed

VERSION = "version bigint, id string, pipeline string, fit string, parts array<string>, superseded bigint, files bigint"
FEATURES = "path string, name string, label int, features array<double>"
STAMP = ["path", "length", "modified"]
#: Parts of a version above which its rows are written as one part again.
MOST_PARTS = 16


@dataclass
class Snapshot:
    """A version of the store: rows (path, name, label, features) of the files of the common shape."""

    version: int
    features: DataFrame
    pipeline: Pipeline
    described: int  # files opened for their features by this refresh
    kept: int  # files whose rows were there already
    refitted: bool


def newest(spark: SparkSession, store: str):
    """The row of VERSION that counts; None if the store is empty."""
    try:
        return spark.read.schema(VERSION).parquet(f"{store}/versions").orderBy(F.desc("version"), "id").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def rows_of(spark: SparkSession, store: str, version) -> DataFrame:
    """(path, name, label, features) of a version; where parts hold rows of files that have changed or gone, the manifest tells which count."""
    parts = [spark.read.schema(FEATURES).parquet(f"{store}/parts/{p}").withColumn("part", F.lit(p)) for p in version.parts]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    if version.superseded:
        rows = rows.join(spark.read.parquet(f"{store}/manifests/{version.id}").select("path", "part"), ["path", "part"], "left_semi")
    return rows.drop("part")


def stamp_of(files: DataFrame) -> str:
    """Digest of a set of files by path, length and time, whatever their order."""
    row = files.select(F.xxhash64(*STAMP).alias("a"), F.xxhash64(F.lit("again"), *STAMP).alias("b")).agg(F.count("*").alias("n"), F.expr("bit_xor(a)").alias("a"), F.expr("bit_xor(b)").alias("b")).first()
    return f"{row.n}-{row.a}-{row.b}"


def refresh(spark: SparkSession, folder: str, store: str, fit_limit: int = 800, n_components: int = 225, keep_fit: bool = False, pattern: str = "*.pgm") -> Snapshot:
    """Brings the store in line with the folder and returns what it holds then; an error if the folder has no image."""
    files = written(listed(spark, folder, pattern), "listing")
    last = newest(spark, store)
    fit_set = files.join(fit_names(files, fit_limit).select("path"), "path", "left_semi")
    stamp = stamp_of(fit_set)
    refitted = last is None or (last.fit != stamp and not keep_fit)
    if refitted:
        pipeline, pipeline_id, fit = fit_pipeline(opened(fit_set), 0, n_components), uuid.uuid4().hex, stamp
        pipeline.save(spark, f"{store}/pipelines/{pipeline_id}")
        new, same, n_kept, parts, superseded = files, None, 0, [], 0
    else:
        pipeline, pipeline_id, fit = Pipeline.load(spark, f"{store}/pipelines/{last.pipeline}"), last.pipeline, last.fit
        old = spark.read.parquet(f"{store}/manifests/{last.id}")
        same = files.join(old, STAMP).select(*STAMP, "part")
        new = written(files.join(old, STAMP, "left_anti"), "new-files")
        n_kept = same.count()
        parts, superseded = list(last.parts), last.superseded + last.files - n_kept
    n_new = new.count()
    if not refitted and not n_new and n_kept == last.files:
        return Snapshot(last.version, rows_of(spark, store, last), pipeline, 0, n_kept, False)
    version, part = uuid.uuid4().hex, uuid.uuid4().hex
    manifest = new.select(*STAMP, F.lit(part).alias("part"))
    if n_new:
        apply_pipeline(opened(new), pipeline)[0].select("path", "name", "label", "features").write.parquet(f"{store}/parts/{part}")
        parts.append(part)
    if same is not None:
        manifest = same.unionByName(manifest)
    _row = lambda vid, ps, gone: spark.createDataFrame([((last.version if last else 0) + 1, vid, pipeline_id, fit, ps, gone, n_kept + n_new)], VERSION)
    manifest.write.parquet(f"{store}/manifests/{version}")
    row = _row(version, parts, superseded)
    if len(parts) > MOST_PARTS or superseded > n_kept + n_new:
        whole, compact = uuid.uuid4().hex, uuid.uuid4().hex
        rows_of(spark, store, row.first()).write.parquet(f"{store}/parts/{whole}")
        files.select(*STAMP, F.lit(whole).alias("part")).write.parquet(f"{store}/manifests/{compact}")
        row = _row(compact, [whole], 0)
    row.coalesce(1).write.mode("append").parquet(f"{store}/versions")
    current = row.first()
    return Snapshot(current.version, rows_of(spark, store, current), pipeline, n_new, n_kept, refitted)
