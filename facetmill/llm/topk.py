"""Exact top-k search by inner product: ball trees and branch and bound, shard by shard.

Candidates are dealt into shards of at most about ``shard_rows`` vectors by a hash. A
task builds a ball tree over its shard and searches it for blocks of queries:
nodes are opened in the order of their upper bound ``q.center + |q| * radius``,
and one is skipped for every query whose current k-th score it cannot reach.
That score is shared between shards: one shard is searched first, and its k-th
scores are the bar for all others, so these send only what can still be in the
answer. The final top k is taken over what all shards sent.

Vectors are of whole numbers, and scores are exact: sums are made in double
precision where they are proven to stay below 2^53, else in whole numbers.

Queries meet every shard, in blocks; neither side is broadcast or collected,
and a task holds one shard and one block.

Defined results: vectors that are null, empty or hold a null or a non-finite
number take no part; vectors of another length than a query's are no
candidates for it; ties go to the smaller id; a query's own id is never its
result; repeated rows of an id count once each, queries once. Rows without id
take no part. Scores are taken to fit 64 bits. Columns besides id and vector
are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shuffle_partitions, written

LEAF, BLOCK = 256, 512
#: Most rows of a shard; fewer, but not below the second number, while there are fewer shards than shuffle partitions.
SHARD_ROWS, LEAST_ROWS = 131_072, 8192
EXACT = float(1 << 53)


class BallTree:
    """Nodes (center, radius, children or members) over whole-number vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.ids, self.vectors = ids, vectors
        self.approx = vectors.astype(np.float64)
        self.center, self.radius, self.children, self.members = [], [], [], []
        self._add(np.arange(len(ids)), leaf)

    def _add(self, rows: np.ndarray, leaf: int) -> int:
        at = len(self.center)
        points = self.approx[rows]
        center = points.mean(axis=0)
        self.center.append(center)
        self.radius.append(float(np.sqrt(((points - center) ** 2).sum(axis=1).max())))
        self.children.append(())
        self.members.append(rows)
        if len(rows) > leaf:
            # Split at the median along the line between two far points.
            far = points[((points - center) ** 2).sum(axis=1).argmax()]
            other = points[((points - far) ** 2).sum(axis=1).argmax()]
            order = np.argsort(points @ (other - far), kind="stable")
            self.members[at] = None
            half = len(rows) // 2
            self.children[at] = (self._add(rows[order[:half]], leaf), self._add(rows[order[half:]], leaf))
        return at


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of whole-number rows."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Answers:
    """The best k (score, id) of each query of a block so far."""

    def __init__(self, own: np.ndarray, bar: np.ndarray, k: int):
        self.own, self.bar, self.k = own, bar, k
        self.best: list[list[tuple[int, int]]] = [[] for _ in own]

    def offer(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        hit = (scores >= self.bar[rows][:, None]) & (ids[None, :] != self.own[rows][:, None])
        for i in np.flatnonzero(hit.any(axis=1)):
            q, cols = rows[i], np.flatnonzero(hit[i])
            if len(cols) > 4 * self.k:
                least = np.partition(scores[i, cols], len(cols) - self.k)[len(cols) - self.k]
                cols = cols[scores[i, cols] >= least]
            merged = sorted(self.best[q] + [(-int(s), int(v)) for s, v in zip(scores[i, cols], ids[cols], strict=True)])[: self.k]
            self.best[q] = merged
            if len(merged) == self.k:
                self.bar[q] = max(self.bar[q], -merged[-1][0])


def search(tree: BallTree, own: np.ndarray, queries: np.ndarray, bar: np.ndarray, k: int) -> Answers:
    """Branch and bound for a block of queries; ``bar``: scores below which nothing is wanted."""
    found = Answers(own, bar.copy(), k)
    approx = queries.astype(np.float64)
    norm = np.sqrt((approx**2).sum(axis=1))

    def bound(node: int, rows: np.ndarray) -> np.ndarray:
        at = approx[rows] @ tree.center[node] + norm[rows] * tree.radius[node]
        return at + 1e-9 * (np.abs(at) + norm[rows] * (tree.radius[node] + np.linalg.norm(tree.center[node]))) + 1e-6  # never below the true bound

    everyone = np.arange(len(own))
    heap = [(0.0, 0, everyone, bound(0, everyone))]
    while heap:
        _, node, rows, above = heapq.heappop(heap)
        open_ = above >= found.bar[rows]
        rows = rows[open_]
        if not len(rows):
            continue
        if tree.children[node]:
            for child in tree.children[node]:
                reach = bound(child, rows)
                heapq.heappush(heap, (-float(reach.max()), child, rows, reach))
        else:
            members = tree.members[node]
            found.offer(rows, tree.ids[members], inner_products(queries[rows], tree.vectors[members]))
    return found


def whole_numbers(vector: Column, factor: int) -> Column:
    """floor(factor * x) of every component; null where the vector takes no part."""
    good = (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return F.when(good, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(factor))).cast("long")))


def _search_shards(shards: DataFrame, blocks: DataFrame, k: int, tasks: int) -> DataFrame:
    """(query_id, vec_id, score) of what each shard sends. shards: (shard, id, v); blocks: (shard, block, id, v, bar), one row per query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree, ids, vectors = None, None, [], []
        asked: list[pa.RecordBatch] = []
        key = None

        def matrix(rows: pa.Table) -> np.ndarray:
            return rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)

        def answer() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(asked)
            asked.clear()
            if tree is None or not rows.num_rows:
                return
            own = rows.column("id").to_numpy()
            found = search(tree, own, matrix(rows), rows.column("bar").to_numpy().copy(), k)
            triples = [(int(q), v, -s) for q, best in zip(own, found.best, strict=True) for s, v in best]
            if triples:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*triples, strict=True)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            keys = list(zip(batch.column("shard").to_pylist(), batch.column("block").to_pylist(), strict=True))
            at = 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                part = batch.slice(at, end - at)
                if keys[at] != key:
                    if asked:
                        yield from answer()
                    key = keys[at]
                    if key[0] != shard:
                        shard, tree, ids, vectors = key[0], None, [], []
                if key[1] < 0:
                    table = pa.Table.from_batches([part])
                    ids.append(table.column("id").to_numpy())
                    vectors.append(matrix(table))
                else:
                    if tree is None and ids:
                        tree = BallTree(np.concatenate(ids), np.concatenate(vectors))
                        ids, vectors = [], []
                    asked.append(part)
                at = end
        if asked:
            yield from answer()

    rows = shards.select("shard", F.lit(-1).cast("long").alias("block"), "id", "v", F.lit(0).cast("long").alias("bar")).unionByName(blocks.select("shard", "block", "id", "v", "bar"))
    return rows.repartition(tasks, "shard").sortWithinPartitions("shard", "block", "id").mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best per query, ties to the smaller id, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_top_k(vectors: DataFrame, queries: Column, k: int = 5, factor: int = 256, shard_rows: int = SHARD_ROWS, least_rows: int = LEAST_ROWS, block_rows: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of (vec_id, embedding) that meet the condition ``queries``, against all others."""
    spark = vectors.sparkSession
    rows = written(vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("id"), whole_numbers(F.col("embedding"), factor).alias("v"), queries.alias("asks")).where("v is not null").withColumn("width", F.size("v")), "topk-vectors")
    count, parts = rows.count(), shuffle_partitions(spark)
    n_shards = max(1, -(-count // shard_rows), min(parts, count // least_rows))
    n_blocks = max(1, -(-rows.where("asks").count() // block_rows))
    # A shard holds vectors of one length only: its number starts with the length.
    of_width = lambda number: F.col("width").cast("long") * F.lit(1 << 32) + number
    placed = rows.withColumn("number", F.pmod(F.xxhash64("id", "v"), F.lit(n_shards)))
    asked = rows.where("asks").dropDuplicates(["id", "v"]).withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(n_blocks)))
    lowest = F.lit(-(1 << 63)).cast("long")
    # The first shard is copied to as many tasks as share out the blocks.
    copies = min(n_blocks, parts)
    firsts = placed.where("number = 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("shard", of_width(F.col("copy")))
    first = _search_shards(firsts, asked.withColumn("shard", of_width(F.col("block") % copies)).withColumn("bar", lowest), k, copies)
    if n_shards == 1:
        return best_of(first, k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    first = written(first, "topk-first")
    bars = best_of(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("k_score"))
    others = F.explode(F.sequence(F.lit(1), F.lit(n_shards - 1)))
    blocks = asked.join(bars, "id", "left").withColumn("bar", F.coalesce("k_score", lowest)).withColumn("other", others).withColumn("shard", of_width(F.col("other")))
    rest = _search_shards(placed.where("number > 0").withColumn("shard", of_width(F.col("number"))), blocks, k, n_shards)
    return best_of(first.unionByName(rest), k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
