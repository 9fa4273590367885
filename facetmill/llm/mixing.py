"""Mixing sources to target weights by capped water-filling.

Every source has a weight. Of a budget of words, each source gets its share by
weight, but at most ``max_epochs`` times its own words; what is above goes to
the other sources by weight, until none is above. A source's target is then
met by whole repetitions of all its documents and, for the rest, by a seeded
sample of them.

The water level is found on the table of sources. The sample needs no sort of
a source: its documents fall into hash buckets, whole buckets are taken in
order until one would exceed the quota, and that bucket is looked at document
by document (taken in seeded order if it still fits). With the room left this
is repeated on the later buckets' documents that still fit, until there are
none: the result is that of trying every document in order. A source with a
third of all rows is thus spread over 4096 buckets, or, if it has more than
16 million rows, as many as the square root of its rows.

Defined results: a null text has no words; a null source is a source of its
own, last in order; rows with equal id and text are taken or left together;
documents without words take none; an empty table gives an empty result.
Columns besides doc_id, text and source are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import n_words, written

#: Rows of the per-source table up to which it is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 100_000
#: Buckets of a source: about one for ROWS_PER_BUCKET rows, but no more than this or the square root of its rows.
LEAST_MOST_BUCKETS = 4096
ROWS_PER_BUCKET = 512
#: Rows of a source that a round looks at one by one (its first edge bucket in any case).
EDGE_ROWS = 16_384


def water_fill(sources: DataFrame, weights: Sequence[float], budget_ratio: float, max_epochs: float) -> DataFrame:
    """Adds ``target`` to (source, source_size, …).

    With the sources ordered by cap over weight, those before some place are at
    their cap and the rest share what is left by weight; the place is the first
    at which the level fits under the source's own cap.
    """
    by_name, all_rows = Window.orderBy(F.asc_nulls_last("source")), Window.partitionBy(F.lit(0))
    by_ratio = Window.orderBy("ratio", F.asc_nulls_last("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    levels = (
        sources.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(all_rows) * F.lit(float(budget_ratio)))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onwards))
        .withColumn("water", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(all_rows))
    )
    target = F.when(F.col("water").isNull() | (F.col("ratio") <= F.col("water")), F.col("cap")).otherwise(F.col("water") * F.col("weight"))
    return levels.withColumn("target", target).drop("weight", "cap", "ratio", "budget", "level", "water")


def keyed(docs: DataFrame, seed: int) -> tuple[Column, Column]:
    """Size in words, and the seeded place of a document in its source's order."""
    return n_words(), F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))


def _bucket() -> Column:
    return F.pmod(F.col("mix_key"), F.col("n_buckets"))


def _first_fit(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["bucket", "mix_key"], kind="stable")
    room, taken = float(group["left"].iloc[0]), []
    for size in group["size"].tolist():
        fits = size <= room
        room -= size * fits
        taken.append(fits)
    return group.loc[taken, ["source", "mix_key", "size"]]


def _round(rows: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round from the sources' (after, room): the buckets (low to high) to be looked at by document, with the room left there; and the keys taken of them.

    Only documents of buckets behind ``after`` that fit into the room count.
    Those in buckets before ``low`` are all taken; without such an edge, low
    and high lie behind the last bucket. Sources without such documents are left out.
    """
    in_order = Window.partitionBy("source").orderBy("bucket")
    buckets = (
        with_source(rows, state)
        .withColumn("bucket", _bucket())
        .where((F.col("bucket") > F.col("after")) & (F.col("size") <= F.col("room")))
        .groupBy("source", "n_buckets", "after", "room", "bucket")
        .agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        .withColumn("cum", F.sum("size").over(in_order))
        .withColumn("over", F.when(F.col("cum") > F.col("room"), F.col("n")))
        .withColumn("n_over", F.sum("over").over(in_order))
    )
    edge = F.when((F.col("n_over") == F.col("n")) | (F.col("n_over") <= EDGE_ROWS), F.col("bucket"))
    steps = written(
        buckets.groupBy("source", "n_buckets", "after", "room")
        .agg(F.min(edge).alias("low"), F.max(edge).alias("high"), F.min_by(F.col("room") - F.col("cum") + F.col("size"), F.when(edge.isNotNull(), F.col("bucket"))).alias("left"))
        .withColumns({"low": F.coalesce("low", "n_buckets"), "high": F.coalesce("high", "n_buckets")}),
        "mix-steps",
    )
    at_edge = with_source(rows, steps.where("low < n_buckets")).withColumn("bucket", _bucket()).where(F.col("bucket").between(F.col("low"), F.col("high")) & (F.col("size") <= F.col("room")))
    keys = at_edge.groupBy("source", "bucket", "mix_key").agg(F.sum("size").alias("size"), F.max("left").alias("left"))
    schema = rows.select("source", "mix_key", "size").schema
    return steps, written(keys.groupBy("source").applyInPandas(_first_fit, schema), "mix-edge")


def plan_mix(rows: DataFrame, weights: Sequence[float], budget_ratio: float, max_epochs: float) -> tuple[DataFrame, DataFrame]:
    """From (source, size, mix_key) rows: the sources with their targets, repetitions and rounds; and the keys taken of the edge buckets."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = (
        water_fill(sources, weights, budget_ratio, max_epochs)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
        .withColumn("quota", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("n_buckets", F.least(F.greatest(F.lit(LEAST_MOST_BUCKETS), F.ceil(F.sqrt("n"))), F.ceil(F.col("n") / ROWS_PER_BUCKET)).cast("long"))
        .drop("n")
    )
    sources = written(sources, "mix-sources")
    state = sources.select("source", "n_buckets", F.lit(-1).cast("long").alias("after"), F.col("quota").alias("room"))
    rounds, keys = None, None
    while True:
        steps, hits = _round(rows, state)
        rounds, keys = (steps, hits) if rounds is None else (rounds.unionByName(steps), keys.unionByName(hits))
        open_steps = steps.where("high < n_buckets - 1")
        if open_steps.isEmpty():
            break
        used = hits.groupBy(F.col("source").alias("hit_source")).agg(F.sum("size").alias("used"))
        state = written(
            open_steps.join(used, F.col("source").eqNullSafe(F.col("hit_source")), "left").select("source", "n_buckets", F.col("high").alias("after"), (F.col("left") - F.coalesce("used", F.lit(0))).alias("room")),
            "mix-state",
        )
    listed = rounds.groupBy(F.col("source").alias("round_source")).agg(F.collect_list(F.struct("after", "room", "low", "high")).alias("rounds"))
    sources = sources.join(listed, F.col("source").eqNullSafe(F.col("round_source")), "left").drop("round_source")
    return written(sources, "mix-targets"), keys.drop("size")


def with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Joins the per-source table to rows; broadcast while its counted size allows it."""
    right = sources.withColumnRenamed("source", "source_right")
    if sources.count() <= BROADCAST_SOURCES:
        right = F.broadcast(right)
    return rows.join(right, F.col("source").eqNullSafe(F.col("source_right")), "left").drop("source_right")


def with_copies(rows: DataFrame, sources: DataFrame, edge_keys: DataFrame) -> DataFrame:
    """Adds ``copies``, how often the mix takes a row, to rows that have source, size and mix_key."""
    rows = with_source(rows, sources).withColumn("bucket", _bucket())
    fits = lambda r: (F.col("bucket") > r["after"]) & (F.col("bucket") <= r["high"]) & (F.col("size") <= r["room"])
    one_by_one = F.exists("rounds", lambda r: fits(r) & (F.col("bucket") >= r["low"]))
    rows = rows.withColumn("edge", F.coalesce(one_by_one, F.lit(False)))
    in_whole = F.coalesce(F.exists("rounds", lambda r: fits(r) & (F.col("bucket") < r["low"])), F.lit(False))
    clear = rows.where(~F.col("edge")).withColumn("copies", F.col("whole") + in_whole.cast("int"))
    keys = edge_keys.select(F.col("source").alias("edge_source"), F.col("mix_key").alias("edge_key"), F.lit(1).alias("hit"))
    at_edge = (
        rows.where("edge")
        .join(keys, F.col("source").eqNullSafe(F.col("edge_source")) & (F.col("mix_key") == F.col("edge_key")), "left")
        .withColumn("copies", F.col("whole") + F.coalesce("hit", F.lit(0)))
        .drop("edge_source", "edge_key", "hit")
    )
    return clear.unionByName(at_edge)


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget_ratio: float = 1.5, max_epochs: float = 2.0, seed: int = 20) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    size, key = keyed(docs, seed)
    rows = written(docs.select("doc_id", "source", size.alias("size"), key.alias("mix_key")), "mix-rows")
    sources, edge_keys = plan_mix(rows, weights, budget_ratio, max_epochs)
    return with_copies(rows, sources, edge_keys).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeat_documents(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget_ratio: float = 1.5, max_epochs: float = 2.0, seed: int = 20) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with the columns of ``docs``."""
    size, key = keyed(docs, seed)
    sources, edge_keys = plan_mix(written(docs.select("source", size.alias("size"), key.alias("mix_key")), "mix-rows"), weights, budget_ratio, max_epochs)
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "source", size.alias("size"), key.alias("mix_key"))
    taken = with_copies(carried, sources, edge_keys).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
