"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


#: Folders made by shared_dir and not yet deleted, in order.
_made: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path below ``spark.checkpoint.dir``, which driver and executors share.

    Where the session has no such setting, a temporary folder serves in local
    mode (tests); on a cluster that is an error, since each machine would
    write to its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="facetmill-")
        spark.sparkContext.setCheckpointDir(base)
    _made.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Deletes at its end the folders made meanwhile, but for tables written by the function that it gives.

    What is returned lazily may read such folders, so this is for callers that
    write their result inside it.
    """
    start, kept = len(_made), set()

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = written(df, name)
        kept.add(_made[-1])
        return out

    try:
        yield keep
    finally:
        gone = [path for path in _made[start:] if path not in kept]
        _made[start:] = [path for path in _made[start:] if path in kept]
        for path in gone:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def n_words(name: str = "text") -> Column:
    """Number of words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(name), F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused_name(name: str, df: DataFrame) -> str:
    """``name``, or a longer one where a column of ``df`` has it already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hash_sample(rows: DataFrame, place: str, limit: int, about: int) -> DataFrame:
    """The ``limit`` rows first by a 64-bit hash in column ``place``; ``about``: the number of ``rows``, within a factor of two.

    Only rows in the share of the hash's range that holds four times as many
    are sorted, so what tasks hand on does not grow with the table.
    """
    if about > 4 * limit:
        rows = rows.where(F.col(place) < -(1 << 63) + (1 << 64) * 4 * limit // about)
    return rows.orderBy(place, *[c for c in rows.columns if c != place]).limit(limit)


def join_group_value(rows: DataFrame, groups: DataFrame, key: str, salts: int = 32) -> DataFrame:
    """``rows`` with the other columns of ``groups`` (one row per ``key``, null being one); null where the key is not in it.

    Rows are dealt by key and a salt from their own values, so a key that holds
    most rows meets its value in many tasks. Where ``groups`` is small, Spark
    broadcasts it instead, by its own limit.
    """
    values = [c for c in groups.columns if c != key]
    salted = groups.select(F.col(key).alias("group_key"), *values).withColumn("group_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")
    met = rows.withColumn("row_salt", salt).join(salted, F.col(key).eqNullSafe(F.col("group_key")) & (F.col("row_salt") == F.col("group_salt")), "left")
    return met.select(*rows.columns, *values)
