"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, which has none itself."""
    tops = edges.select(F.col("v").alias("u")).distinct()
    return edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty() and edges.join(tops, "u", "left_semi").isEmpty()


def connected_components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """From links (u, v) to (node, root): every linked node with the smallest node it can reach.

    Alternates large-star and small-star rounds, in which nodes hand their
    larger and then their smaller neighbours to the smallest one they know;
    the number of rounds grows with the logarithm of the longest path. Every
    round is written to the shared folder. Nodes with very many neighbours only
    take part in grouped minima and equality joins.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges = written(edges, "links")
    for _ in range(max_rounds):
        if _all_stars(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v")).distinct()
        edges = written(small, "links")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def extended_components(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) for the components that further links (u, v) make of those in ``roots``: only the roots' graph is gone through again."""
    known = roots.select(F.col("node").alias("known"), F.col("root").alias("known_root"))
    lifted = lambda df, c: df.join(known, F.col(c) == F.col("known"), "left").withColumn(c, F.coalesce("known_root", c)).drop("known", "known_root")
    above = connected_components(lifted(lifted(links.select("u", "v"), "u"), "v")).select(F.col("node").alias("above"), F.col("root").alias("top"))
    single = links.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(roots, "node", "left_anti").withColumn("root", F.col("node"))
    return roots.select("node", "root").unionByName(single).join(above, F.col("root") == F.col("above"), "left").select("node", F.coalesce("top", "root").alias("root"))
