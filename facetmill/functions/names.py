"""Keys and labels from file names such as ``p12_i3.pgm``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def natural_key(name: Column) -> Column:
    """An orderable key in which digit runs count as numbers: ``i2`` comes before ``i10``."""
    parts = F.regexp_extract_all(name, F.lit(r"(\D*)(\d*)"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^(\D*)", 1).alias("s"), F.coalesce(F.regexp_extract(p, r"(\d+)$", 1).try_cast("decimal(38,0)"), F.lit(-1).cast("decimal(38,0)")).alias("n")))


def picture_key(name: Column) -> Column:
    """The first digit run as a number, else 0."""
    return F.coalesce(F.regexp_extract(name, r"(\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def label_of(name: Column) -> Column:
    """The number after the leading ``p``, as in ``p<number>_i…``; -1 for other names."""
    return F.coalesce(F.regexp_extract(name, r"^p(\d+)_i", 1).try_cast("int"), F.lit(-1))
