"""Seeded orders that any engine can repeat: md5 of seed and id, then the id itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hexadecimal digits of the hash by which rows are dealt into ranges for ranking.
PREFIX = 3


def seeded_key(seed: int | str, id_col: str = "id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"))


def seeded_rank(df: DataFrame, seed: int | str, by: Sequence[str] = (), id_col: str = "id", out: str = "rank") -> DataFrame:
    """Adds the rank (from 1) of each row in the seeded order of its group.

    Rows are ranked inside ranges of the hash and shifted by the number of rows
    in the ranges before, so one group, or no group at all, is still ranked by
    many tasks. The table of ranges has at most 16 ** PREFIX rows a group.
    """
    df = df.withColumn("_key", seeded_key(seed, id_col)).withColumn("_range", F.substring("_key", 1, PREFIX))
    keys = [*by, "_range"]
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = df.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*keys).orderBy("_key", id_col)
    return df.withColumn("_at", F.row_number().over(within)).join(shifts, keys).withColumn(out, (F.col("_shift") + F.col("_at")).cast("long")).drop("_key", "_range", "_shift", "_at")
