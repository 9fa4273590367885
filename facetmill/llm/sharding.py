"""Sharding by a minimax contiguous partition.

Documents with equal texts are one atomic group and stay together. Groups lie
in the order of a hash of their text, in cells of whole groups; the cells'
sizes, at most ``cells`` numbers whatever the corpus, are the ordered atomic
sizes. The smallest shard capacity with which a greedy sweep needs no more
than the given number of shards is found by binary search; the cuts are made
within that capacity, as near to equal shares as it allows.

A document's shard then follows from its hash and the cuts. Slots are counted
within the cells; a cell with many rows (a large group of copies) is counted
in parts, so no task sees more than a bounded share of rows.

Defined results: a null text counts as empty (size 1, the same group as ``''``);
equal rows get different slots; with fewer groups than shards some shards stay
empty. Columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import text_or_empty, written

CELLS = 16_384
#: Rows of a cell above this many times the mean are counted in parts.
PART_ROWS_X = 4


def _cuts_at(prefix: np.ndarray, capacity: int) -> list[int]:
    """Greedy sweep: the end of each shard, as cell indices."""
    ends, start, n = [], 0, len(prefix) - 1
    while start < n:
        end = int(np.searchsorted(prefix, prefix[start] + capacity, side="right")) - 1
        ends.append(end)
        start = end
    return ends


def minimax_cuts(sizes: np.ndarray, shards: int) -> list[int]:
    """Cell indices at which the shards 1, 2, … start, for the smallest feasible capacity."""
    prefix = np.concatenate([[0], np.cumsum(np.asarray(sizes, dtype=np.int64))])
    total, largest = int(prefix[-1]), int(max(sizes, default=0))
    low, high = max(largest, -(-total // shards)), total
    while low < high:
        mid = (low + high) // 2
        if len(_cuts_at(prefix, mid)) <= shards:
            high = mid
        else:
            low = mid + 1
    return _even_cuts(prefix, low, shards) if total else []


def _even_cuts(prefix: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Of all cuts within the capacity, those nearest to equal shares.

    The greedy sweep from the end gives the earliest place of each cut, that
    from the cut before the latest.
    """
    n, earliest = len(prefix) - 1, [len(prefix) - 1]
    for _ in range(shards - 1):
        earliest.append(int(np.searchsorted(prefix, prefix[earliest[-1]] - capacity, side="left")))
    earliest = earliest[:0:-1]
    cuts, at = [], 0
    for i in range(1, shards):
        share = prefix[-1] * i / shards
        near = int(np.searchsorted(prefix, share))
        near -= near > 0 and share - prefix[near - 1] < prefix[min(near, n)] - share
        latest = int(np.searchsorted(prefix, prefix[at] + capacity, side="right")) - 1
        at = min(max(near, earliest[i - 1], at), latest)
        cuts.append(at)
    return cuts


def shard_documents(docs: DataFrame, shards: int = 16, cells: int = CELLS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for every document."""
    spark, text = docs.sparkSession, text_or_empty()
    rows = written(
        docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h")).withColumn("cell", F.pmod("h", F.lit(cells)).cast("int")),
        "shard-rows",
    )
    # At most `cells` rows come to the driver, however large the corpus is.
    found = {r.cell: (r.bytes, r.n) for r in rows.groupBy("cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
    sizes = np.array([found.get(c, (0, 0))[0] for c in range(cells)], dtype=np.int64)
    cuts = minimax_cuts(sizes, shards)
    part_rows = max(1000, PART_ROWS_X * sum(n for _, n in found.values()) // cells)
    parts = {c: -(-n // part_rows) for c, (_, n) in found.items() if n > part_rows}

    # Cells in the order of shards: (cell, part) with its number of rows; parts are at most cells + rows / part_rows.
    schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("parts", T.IntegerType())])
    shard_of = np.searchsorted(np.array(cuts, dtype=np.int64), np.arange(cells), side="right") if cuts else np.zeros(cells, dtype=np.int64)
    of_cell = spark.createDataFrame([(c, int(shard_of[c]), parts.get(c, 1)) for c in sorted(found)], schema)
    placed = (
        rows.join(F.broadcast(of_cell), "cell")
        .withColumn("part", F.pmod(F.xxhash64("doc_id", "h"), F.col("parts")).cast("int"))
        .drop("parts")
    )
    counted = placed.groupBy("shard", "cell", "part").agg(F.count("*").alias("n"))
    base = counted.select("cell", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell", "part")) - F.col("n")).alias("base"))
    within = Window.partitionBy("cell", "part").orderBy("doc_id", "h")
    return placed.withColumn("at", F.row_number().over(within) - 1).join(F.broadcast(base), ["cell", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("at")).cast("long").alias("slot"))
