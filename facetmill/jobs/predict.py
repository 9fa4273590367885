"""Train on all labelled images, label a folder of others, write the line of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.selection import SVMFamily
from ..sources.images import list_images, write_line
from ..sources.vectors import trainable
from .prepare import apply_pipeline, prepare


def predict_folder(spark: SparkSession, labelled: str, unlabelled: str, work: str, out: str, c: float = 5.0, kernel: str = "rbf") -> DataFrame:
    """Writes predictions (path, name, prediction) and their line below ``out``; images of another shape are in none of them."""
    train, pipeline = prepare(spark, labelled, work)
    test, _ = apply_pipeline(list_images(spark, unlabelled), pipeline)
    numbered = lambda df: df.withColumn("id", F.xxhash64("path"))
    test = numbered(test)
    found = SVMFamily([{"kernel": kernel, "c": c}]).predict(trainable(numbered(train)).drop("path", "name"), test, ())
    found.join(test.select("id", "path", "name"), "id").select("path", "name", "prediction").write.mode("overwrite").parquet(f"{out}/predictions")
    predictions = spark.read.parquet(f"{out}/predictions")
    write_line(predictions, f"{out}/line")
    return predictions
