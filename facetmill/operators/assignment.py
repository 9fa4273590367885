"""One-to-one maps of greatest total count from a sparse table, by auction (Bertsekas, 1988).

Rows bid for the column worth most to them at its price, by what it is worth
over their second choice and ``eps`` more; a column goes to the highest bidder
and the bid is its new price. All rows without a column bid at once. With
``eps`` cut down step by step the last map is the best one as soon as ``eps``
times the number of bidders is below one; counts are multiplied to allow whole
numbers throughout.

That holds where all rows and columns find a partner. So the table is mirrored:
beside every row stands a copy of each column that bids, beside every column a
copy of each row, and each may take its own copy at no worth. A best map of the
doubled table is a best map of the table and one of its mirror image.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.meeting import Meeting
from ..sources.shared import written

#: ``eps`` is divided by this from one step to the next.
STEP = 5
NONE = np.iinfo(np.int64).min // 4


class Bidders:
    """The bidders of one task with their worths, ordered by bidder."""

    def __init__(self, who: np.ndarray, what: np.ndarray, worth: np.ndarray):
        order = np.lexsort((what, who))
        self.what, self.worth = what[order], worth[order]
        self.who, self.start = np.unique(who[order], return_index=True)
        self.size = np.diff(np.append(self.start, len(order)))

    def bids(self, free: np.ndarray, prices: np.ndarray, eps: int) -> np.ndarray:
        """Highest bid for every column, and the bidder, of those that are ``free``; ties go to the smaller bidder."""
        out = np.stack([np.full(len(prices), NONE), np.full(len(prices), len(prices))])
        at = np.flatnonzero(free)
        if not len(at):
            return out
        size = self.size[at]
        first = np.cumsum(size) - size
        edges = np.repeat(self.start[at] - first, size) + np.arange(size.sum())
        value = self.worth[edges] - prices[self.what[edges]]
        best = np.maximum.reduceat(value, first)
        places = np.where(value == np.repeat(best, size), np.arange(len(value)), len(value))
        chosen = np.minimum.reduceat(places, first)
        value[chosen] = NONE
        second = np.where(size > 1, np.maximum.reduceat(value, first), best)
        column = self.what[edges[chosen]]
        bid = prices[column] + best - second + eps
        last = np.lexsort((self.who[at], -bid, column))
        winners = last[np.append(True, np.diff(column[last]) > 0)]
        out[:, column[winners]] = bid[winners], self.who[at][winners]
        return out


def higher(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The higher of two tasks' bids for every column; ties go to the smaller bidder."""
    return np.where((b[0] > a[0]) | ((b[0] == a[0]) & (b[1] < a[1])), b, a)


def auction(edges: DataFrame, size: int, most: int, tasks: int = 0) -> DataFrame:
    """(who, what, rounds): the best perfect map of bidders to columns, both numbered from 0 to ``size`` - 1.

    ``edges``: (who, what, n) with whole n of at least 0 and at most ``most``,
    which must allow a perfect map. One barrier stage: its tasks hold the edges
    of their bidders; a round exchanges two numbers a column, and the outcome
    does not depend on how bidders are dealt.
    """
    if most * (size + 1) >= 1 << 58:
        raise ValueError("counts are too large for the number of rows and columns")
    n_tasks = tasks or edges.sparkSession.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[b.column(c).to_numpy() for c in ("who", "what", "n")] for b in batches if b.num_rows]
        who, what, n = (np.concatenate(c) for c in zip(*held, strict=True)) if held else (np.zeros(0, np.int64),) * 3
        mine = Bidders(who, what, n * (size + 1))
        meeting = Meeting(BarrierTaskContext.get())
        prices, eps, rounds = np.zeros(size, np.int64), max(1, most * (size + 1) // 2), 0
        while True:
            owner, has = np.full(size, -1), np.zeros(size, bool)
            while not has.all():
                bid, bidder = meeting.agree(mine.bids(~has[mine.who], prices, eps), higher)
                sold = np.flatnonzero(bid > NONE)
                before = owner[sold]
                has[before[before >= 0]] = False
                owner[sold], prices[sold] = bidder[sold], bid[sold]
                has[bidder[sold]] = True
                rounds += 1
            if eps == 1:
                break
            eps = max(1, eps // STEP)
        meeting.close()
        if meeting.me == 0:
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(np.arange(size), pa.int64()), pa.array(np.full(size, rounds), pa.int64())], names=["who", "what", "rounds"])

    return written(edges.select("who", "what", "n").repartition(n_tasks, "who").mapInArrow(run, "who bigint, what bigint, rounds bigint", barrier=True), "auction")


def numbered(df: DataFrame, column: str) -> DataFrame:
    """(column, at): its distinct values in order, numbered from 0; for the values of one side of a table."""
    return df.select(column).distinct().withColumn("at", (F.row_number().over(Window.orderBy(column)) - 1).cast("long"))


def best_map(table: DataFrame, rows: str, columns: str, count: str = "n", tasks: int = 0) -> DataFrame:
    """(rows, columns): the one-to-one map with the greatest sum of counts, of as many pairs as the smaller side has values.

    ``table`` has a row for each pair with a count above 0; nulls on either
    side are left out. Values that no count brings together are paired in order
    at the end.
    """
    table = written(table.where(F.col(rows).isNotNull() & F.col(columns).isNotNull()).select(rows, columns, F.col(count).cast("long").alias("n")), "counts")
    left, right = written(numbered(table, rows), "rows"), written(numbered(table, columns), "columns")
    n_left, n_right = left.count(), right.count()
    if not n_left:
        return table.select(rows, columns)
    at = lambda name: F.col("at").alias(name)
    pairs = table.join(left.select(rows, at("l")), rows).join(right.select(columns, at("r")), columns).select("l", "r", "n")
    ids = lambda n: table.sparkSession.range(n)
    edges = pairs.select(F.col("l").alias("who"), F.col("r").alias("what"), "n")
    edges = edges.unionByName(pairs.select((n_left + F.col("r")).alias("who"), (n_right + F.col("l")).alias("what"), "n"))
    edges = edges.unionByName(ids(n_left).select(F.col("id").alias("who"), (n_right + F.col("id")).alias("what"), F.lit(0).cast("long").alias("n")))
    edges = edges.unionByName(ids(n_right).select((n_left + F.col("id")).alias("who"), F.col("id").alias("what"), F.lit(0).cast("long").alias("n")))
    found = auction(edges, n_left + n_right, table.agg(F.max("n")).first()[0], tasks).where((F.col("who") < n_left) & (F.col("what") < n_right))
    named = found.join(left.withColumnRenamed("at", "who"), "who").join(right.withColumnRenamed("at", "what"), "what").select(rows, columns)
    rest = lambda side, name: numbered(side.join(named, name, "left_anti"), name)
    return named.unionByName(rest(left, rows).join(rest(right, columns), "at").select(rows, columns))
