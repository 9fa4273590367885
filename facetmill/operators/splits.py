"""Holdouts and folds in a seeded hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordering import seeded_rank

SEED = 42


def stratified_holdout(df: DataFrame, one_in: int = 5, seed: int = SEED) -> DataFrame:
    """Adds ``is_test``: of every label its first rows in seeded order, one in ``one_in``.

    In all, ceil(n / one_in) rows are held out: every label gives the whole
    part of its share, and those with the largest remainders one more (ties:
    the smaller label).
    """
    labels = df.groupBy("label").agg(F.count("*").alias("_n"))
    everything = Window.partitionBy(F.lit(0))
    order = Window.orderBy(F.desc(F.col("_n") % one_in), "label")
    quota = (
        labels.withColumn("_base", F.floor(F.col("_n") / one_in))
        .withColumn("_more", F.ceil(F.sum("_n").over(everything) / one_in) - F.sum("_base").over(everything))
        .withColumn("_quota", F.col("_base") + (F.row_number().over(order) <= F.col("_more")).cast("int"))
        .select("label", "_quota")
    )
    ranked = seeded_rank(df, seed, ["label"], out="_rank")
    return ranked.join(quota, "label").withColumn("is_test", F.col("_rank") <= F.col("_quota")).select(*df.columns, "is_test")


def _fold(n: str, k: int, rank: str) -> Column:
    """The fold (1 to k) of a rank: the first n % k folds have one row more."""
    q, m = F.floor(F.col(n) / k), F.col(n) % k
    head = m * (q + 1)
    at = F.col(rank) - 1
    return (F.when(F.col(rank) <= head, F.floor(at / (q + 1))).otherwise(m + F.floor((at - head) / F.greatest(q, F.lit(1)))) + 1).cast("int")


def kfold(df: DataFrame, k: int = 5, seed: int = SEED, by: tuple[str, ...] = (), out: str = "fold") -> DataFrame:
    """Adds the fold of each row, 1 to k, within its group; sizes differ by one at most."""
    ranked = seeded_rank(df, seed, by, out="_rank")
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n"))
    joined = ranked.join(sizes, list(by)) if by else ranked.crossJoin(F.broadcast(sizes))  # without groups the sizes are one row
    return joined.withColumn(out, _fold("_n", k, "_rank")).select(*df.columns, out)


def nested_folds(df: DataFrame, k_outer: int = 5, k_inner: int = 3, seed: int = SEED) -> DataFrame:
    """For every outer fold its training rows, with the fold each belongs to inside: columns outer and inner are added."""
    own = kfold(df, k_outer, seed, out="_own")
    others = F.explode(F.filter(F.sequence(F.lit(1), F.lit(k_outer)), lambda f: f != F.col("_own")))
    return kfold(own.withColumn("outer", others).drop("_own"), k_inner, seed, by=("outer",), out="inner")


def fold_parts(folds: DataFrame, fold: int, column: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(train, test) of one fold."""
    return folds.where(F.col(column) != fold).drop(column), folds.where(F.col(column) == fold).drop(column)
