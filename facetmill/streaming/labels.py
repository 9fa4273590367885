"""Label image files as they arrive, and count labels by time.

The feature job and the model's votes are narrow or keyed by row, so they run
on a stream as they do on a table: each micro-batch is described, projected and
labelled. Counts by window of arrival are kept as state below a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..jobs.prepare import Pipeline, apply_pipeline
from ..operators.svm import predict_pairs
from ..sources.images import named_images

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def arriving_images(spark: SparkSession, folder: str, pattern: str = "*.pgm") -> DataFrame:
    """A stream of image files with name and label."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).load(folder)
    return named_images(files)


def label_stream(images: DataFrame, pipeline: Pipeline, models: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends (name, prediction) of every arriving image of the common shape to a Parquet folder."""

    def label(batch: DataFrame, number: int) -> None:
        features, _ = apply_pipeline(batch, pipeline)
        rows = features.withColumn("id", F.xxhash64("name")).persist()
        predictions = predict_pairs(models, rows)
        # A batch that is run again writes over its own folder.
        rows.select("id", "name").join(predictions, "id").select("name", "prediction").write.mode("overwrite").parquet(f"{out}/batch={number}")
        rows.unpersist()

    return images.writeStream.foreachBatch(label).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def label_counts(rows: DataFrame, time: str = "time", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, label, n) of a stream with time and label; rows later than the watermark are not counted."""
    counts = rows.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "label").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), "label", "n")
