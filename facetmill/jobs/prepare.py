"""From a folder of images to features, and what is learned on the way."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import base_name, label_of, natural_key
from ..operators.features import Components, Scaler, common_shape, fit_pca, fit_scaler, load_model, project, save_model, standardise
from ..sources.images import cropped, described, first_files


@dataclass
class Pipeline:
    h: int
    w: int
    scaler: Scaler
    pca: Components

    def save(self, spark: SparkSession, path: str) -> None:
        save_model(spark, path, shape=np.array([self.h, self.w]), mean=self.scaler.mean, std=self.scaler.std, pca_mean=self.pca.mean, components=self.pca.components, ratio=self.pca.ratio)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Pipeline:
        m = load_model(spark, path)
        return Pipeline(int(m["shape"][0]), int(m["shape"][1]), Scaler(m["mean"], m["std"]), Components(m["pca_mean"], m["components"], m["ratio"]))


def listed(spark: SparkSession, folder: str, pattern: str = "*.pgm") -> DataFrame:
    """(path, name, label, length, modified) of every image file, none of which is opened; an error if there is none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    if not files.select("path").take(1):
        raise FileNotFoundError(f"no {pattern} in {folder}")
    name = base_name(F.col("path"))
    # Spark takes each file for at least 4 MB, so a task would list 32 of them.
    return files.coalesce(2 * spark.sparkContext.defaultParallelism).select("path", name.alias("name"), label_of(name).alias("label"), "length", F.col("modificationTime").alias("modified"))


def fit_pipeline(files: DataFrame, fit_limit: int = 800, n_components: int = 225, equalise: bool = True) -> Pipeline:
    """Learns shape, scaling and components from the first images in natural order (all that are given, if the limit is not positive)."""
    images = cropped(first_files(files, fit_limit)).where("h is not null").withColumn("ord", natural_key(F.col("name")))
    shape = common_shape(images).first()
    if shape is None:
        raise ValueError("no image could be read")
    features = described(images.where((F.col("h") == shape.h) & (F.col("w") == shape.w)).drop("ord"), equalise).persist()
    try:
        scaler = fit_scaler(features)
        return Pipeline(shape.h, shape.w, scaler, fit_pca(standardise(features, scaler), n_components))
    finally:
        features.unpersist()


def apply_pipeline(files: DataFrame, pipeline: Pipeline, equalise: bool = True) -> tuple[DataFrame, DataFrame]:
    """(path, name, label, features) of images of the common shape, and path, name and shape of all others; files without path have none here either."""
    images = cropped(files)
    fits = (F.col("h") == pipeline.h) & (F.col("w") == pipeline.w)
    features = project(standardise(described(images.where(fits), equalise), pipeline.scaler), pipeline.pca)
    keys = [c for c in ("path", "name") if c in files.columns]
    return features.select(*keys, "label", "features"), images.where(~F.coalesce(fits, F.lit(False))).select(*keys, "h", "w")


def prepare(spark: SparkSession, folder: str, out: str, fit_limit: int = 800, n_components: int = 225) -> tuple[DataFrame, Pipeline]:
    """(path, name, label, features) of a folder and what was fitted, from the store below ``out`` whose name holds the parameters; only what is new is described."""
    from .store import refresh

    found = refresh(spark, folder, f"{out}/limit={fit_limit}-components={n_components}", fit_limit, n_components)
    return found.features, found.pipeline
