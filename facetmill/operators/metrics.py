"""Accuracy, per-class reports, leaderboards, and agreement of clusterings with labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def accuracy(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose prediction is their label, for each group."""
    return predictions.groupBy(*by).agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"))


def _class_counts(predictions: DataFrame, how: str) -> DataFrame:
    cells = predictions.groupBy("label", "prediction").agg(F.count("*").alias("n"))
    truth = cells.groupBy("label").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("hits"))
    said = cells.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("predicted"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return truth.join(said, "label", how).select("label", zero("support"), zero("hits"), zero("predicted"))


def class_report(predictions: DataFrame, union: bool = False) -> DataFrame:
    """Precision, recall, F1 and support of every class, then averages.

    Classes are those of the labels, with a ``macro`` row; with ``union`` also
    those that only occur as predictions, with rows ``accuracy``, ``macro`` and
    ``weighted`` (by support). Where a denominator is 0 the figure is 0.
    """
    precision, recall = ratio(F.col("hits"), F.col("predicted")), ratio(F.col("hits"), F.col("support"))
    classes = _class_counts(predictions, "full" if union else "left").select(F.col("label").cast("string").alias("class"), precision.alias("precision"), recall.alias("recall"), "support", "hits").withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    figures = ("precision", "recall", "f1")
    rows = [classes.select("class", *figures, "support"), classes.agg(*[F.avg(c).alias(c) for c in figures], F.sum("support").alias("support")).select(F.lit("macro").alias("class"), *figures, "support")]
    if union:
        weighted = classes.agg(*[ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in figures], F.sum("support").alias("support"))
        rows.append(weighted.select(F.lit("weighted").alias("class"), *figures, "support"))
        share = ratio(F.sum("hits"), F.sum("support"))
        rows.append(classes.agg(*[share.alias(c) for c in figures], F.sum("support").alias("support")).select(F.lit("accuracy").alias("class"), *figures, "support"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def leaderboard(scores: DataFrame, score: str = "accuracy", order: Sequence[str] = ("config",)) -> DataFrame:
    """Adds rank (highest score first, ties in the order given) and is_best."""
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), *order))).withColumn("is_best", F.col("rank") == 1)


def contingency(clusters: DataFrame) -> DataFrame:
    """Number of rows of every (label, cluster) that occurs."""
    return clusters.groupBy("label", "cluster").agg(F.count("*").alias("n"))


def adjusted_rand_index(table: DataFrame) -> DataFrame:
    """One row, ``ari``, from a contingency table; 1 where it is undefined."""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    both = table.agg(pairs("n").alias("s"), F.sum("n").alias("total"))
    side = lambda c, out: table.groupBy(c).agg(F.sum("n").alias("m")).agg(pairs("m").alias(out))
    row = both.crossJoin(side("label", "a")).crossJoin(side("cluster", "b"))  # three single rows
    expected = F.col("a") * F.col("b") / F.greatest(F.col("total") * (F.col("total") - 1) / 2, F.lit(1.0))
    return row.select(F.coalesce(F.try_divide(F.col("s") - expected, (F.col("a") + F.col("b")) / 2 - expected), F.lit(1.0)).alias("ari"))


def normalised_mutual_information(table: DataFrame) -> DataFrame:
    """One row, ``nmi``, with the mean of both entropies as norm; 1 where it is undefined."""
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    p = table.withColumn("p", F.col("n") / total)
    p = p.withColumn("pa", F.sum("p").over(Window.partitionBy("label"))).withColumn("pb", F.sum("p").over(Window.partitionBy("cluster")))
    entropy = lambda c: -F.sum(F.col("p") * F.log(c))  # noqa: E731  sum of p over a side's cells gives that side's entropy
    row = p.agg(F.sum(F.col("p") * F.log(F.col("p") / (F.col("pa") * F.col("pb")))).alias("mi"), entropy("pa").alias("ha"), entropy("pb").alias("hb"))
    return row.select(F.coalesce(F.try_divide("mi", (F.col("ha") + F.col("hb")) / 2), F.lit(1.0)).alias("nmi"))
