"""Feature tables: (id, features array<double>, label int)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def as_features(df: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    label = F.col(label_col).cast("int") if label_col else F.lit(-1)
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("features"), label.alias("label"))


def read_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_features(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", "label")


def trainable(df: DataFrame) -> DataFrame:
    """Rows with a label; -1 marks the others."""
    return df.where("label >= 0")
