"""Streams give what the batch job gives."""

import numpy as np

from facetmill.jobs.prepare import apply_pipeline, fit_pipeline
from facetmill.operators.svm import fit_pairs, gamma_of
from facetmill.sources.images import list_images
from facetmill.streaming.labels import arriving_images, label_counts, label_stream
from pyspark.sql import functions as F


def write(folder, n, first=0):
    rng = np.random.default_rng(first)
    stripes = np.tile(np.arange(32) // 4 % 2 * 200, (32, 1))
    for i in range(first, first + n):
        image = np.clip((stripes, stripes.T)[i % 2] + rng.integers(0, 15, (32, 32)), 0, 255).astype("u1")
        (folder / f"p{i % 2}_i{i}.pgm").write_bytes(b"P5 32 32 255\n" + image.tobytes())


def test_labels_of_arriving_images(spark, tmp_path):
    known, new = tmp_path / "known", tmp_path / "new"
    known.mkdir()
    new.mkdir()
    write(known, 12)
    files = list_images(spark, str(known))
    pipeline = fit_pipeline(files, n_components=4)
    train = apply_pipeline(files, pipeline)[0].withColumn("id", F.xxhash64("name")).drop("name")
    configs = spark.createDataFrame([("0", "rbf", 5.0, gamma_of(train, "scale"))], "config string, kernel string, c double, gamma double")
    models = fit_pairs(train, configs).persist()
    out, checkpoint = f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint"
    for first in (100, 103):
        write(new, 3, first)
        label_stream(arriving_images(spark, str(new)), pipeline, models, out, checkpoint).awaitTermination(120)
    got = {r.name: r.prediction for r in spark.read.parquet(out).collect()}
    assert got == {f"p{i % 2}_i{i}.pgm": i % 2 for i in range(100, 106)}


def test_counts_by_window(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 10:05:00", 1), ("2024-01-01 10:50:00", 1), ("2024-01-01 11:10:00", 2)], "time string, label int").withColumn("time", F.to_timestamp("time"))
    path = f"file://{tmp_path}/rows"
    rows.write.parquet(path)
    stream = label_counts(spark.readStream.schema(rows.schema).parquet(path))
    query = stream.writeStream.format("memory").queryName("label_counts").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(str(r.start), r.label): r.n for r in spark.table("label_counts").collect()}
    assert got == {("2024-01-01 10:00:00", 1): 2, ("2024-01-01 11:00:00", 2): 1}
