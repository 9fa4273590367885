"""k-means by Lloyd's rounds, and the match of its clusters with labels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import arrays, matrix
from ..functions.meeting import Meeting
from ..functions.ordering import seeded_key
from ..sources.shared import written
from .assignment import best_map
from .metrics import accuracy, contingency

SEED = 42


@dataclass
class KMeans:
    centroids: np.ndarray
    n_iter: int


def seeded_rows(df: DataFrame, n: int, seed: int = SEED) -> np.ndarray:
    """The features of the first n rows in seeded order."""
    rows = df.select(seeded_key(seed).alias("_key"), "id", "features").orderBy("_key", "id").limit(n).collect()
    return np.array([r.features for r in rows], dtype=float)


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] - 2.0 * (x @ centroids.T) + (centroids**2).sum(axis=1), 0.0)


def assign(df: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds cluster (ties: the lowest) and its squared distance to every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("features"))
            d = squared_distances(x, centroids) if len(x) else np.zeros((0, len(centroids)))
            best = d.argmin(axis=1).astype(np.int32)
            yield batch.append_column("cluster", pa.array(best)).append_column("dist", pa.array(d[np.arange(len(x)), best], pa.float64()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, cluster int, dist double")


def cluster_sums(df: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, pos, total, n): sums of features by cluster, added up in blocks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros_like(centroids), np.zeros(len(centroids), dtype=np.int64)
        for batch in batches:
            x = matrix(batch.column(0))
            if len(x):
                best = squared_distances(x, centroids).argmin(axis=1)
                np.add.at(total, best, x)
                n += np.bincount(best, minlength=len(n))
        used = np.flatnonzero(n)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), arrays(total[used]), pa.array(n[used])], names=["cluster", "total", "n"])

    parts = df.select("features").mapInArrow(run, "cluster int, total array<double>, n bigint")
    return parts.select("cluster", "n", F.posexplode("total").alias("pos", "x")).groupBy("cluster", "pos").agg(F.sum("x").alias("total"), F.sum("n").alias("n"))


def update(df: DataFrame, centroids: np.ndarray, spare: list[np.ndarray]) -> np.ndarray:
    """New centroids: means of their rows; an empty cluster takes the next spare row."""
    out, empty = np.zeros_like(centroids), np.ones(len(centroids), dtype=bool)
    for r in cluster_sums(df, centroids).collect():  # clusters x features numbers
        out[r.cluster, r.pos] = r.total / r.n
        empty[r.cluster] = False
    for c in np.flatnonzero(empty):
        out[c] = spare.pop(0) if spare else centroids[c]
    return out


def fit_kmeans(df: DataFrame, n_clusters: int = 28, max_iter: int = 100, seed: int = SEED, spares: int = 64) -> KMeans:
    """Starts from the first rows in seeded order; stops when centroids stand still or after ``max_iter`` rounds."""
    df = df.select("id", "features").persist()
    try:
        first = seeded_rows(df, n_clusters + spares, seed)
        if len(first) < n_clusters:
            raise ValueError("fewer rows than clusters")
        centroids, spare = first[:n_clusters].copy(), list(first[n_clusters:])
        for n_iter in range(1, max_iter + 1):
            new = update(df, centroids, spare)
            still = np.allclose(centroids, new)
            centroids = new
            if still:
                break
        return KMeans(centroids, n_iter)
    finally:
        df.unpersist()


class Bounded:
    """Rows with their cluster and, between rounds, bounds of their distances: one above to their own centroid, one below to all others (Hamerly, 2010)."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.cluster = np.zeros(len(x), dtype=np.int64)
        self.above, self.below = np.full(len(x), np.inf), np.zeros(len(x))
        self.made = 0

    def assign(self, centroids: np.ndarray, moved: np.ndarray | None) -> None:
        """Nearest centroids, after these ``moved`` by so much; only rows whose bounds cross look at all of them. Ties go to the lowest."""
        if moved is not None:
            others = np.array([np.delete(moved, c).max(initial=0.0) for c in range(len(moved))])
            self.above = (self.above + moved[self.cluster]) * (1 + 1e-12)
            self.below = (self.below - others[self.cluster]) * (1 - 1e-12) - 1e-12
        gaps = np.sqrt(squared_distances(centroids, centroids))
        np.fill_diagonal(gaps, np.inf)
        far = np.maximum(self.below, gaps.min(axis=1)[self.cluster] / 2) * (1 - 1e-9) - 1e-9
        open_ = np.flatnonzero(self.above >= far)
        own = np.sqrt(((self.x[open_] - centroids[self.cluster[open_]]) ** 2).sum(axis=1))
        self.made += len(open_)
        self.above[open_] = own * (1 + 1e-9) + 1e-9
        open_ = open_[self.above[open_] >= far[open_]]
        for at in range(0, len(open_), 4096):
            rows = open_[at : at + 4096]
            d = squared_distances(self.x[rows], centroids)
            self.made += d.size
            best = d.argmin(axis=1)
            self.cluster[rows] = best
            self.above[rows] = np.sqrt(d[np.arange(len(rows)), best]) * (1 + 1e-9) + 1e-9
            d[np.arange(len(rows)), best] = np.inf
            self.below[rows] = np.sqrt(d.min(axis=1)) * (1 - 1e-9) - 1e-9 if d.shape[1] > 1 else np.inf


def fit_kmeans_held(df: DataFrame, n_clusters: int = 28, max_iter: int = 100, seed: int = SEED, spares: int = 64, tasks: int = 0) -> tuple[KMeans, int]:
    """As fit_kmeans, in one job, and the number of distances made: the tasks of a barrier stage hold rows and bounds in memory for all rounds.

    A round exchanges clusters x (features + 1) numbers. For rows that fit the
    memory of the session's cores; if a task is lost, the stage starts again.
    """
    first = seeded_rows(df, n_clusters + spares, seed)
    if len(first) < n_clusters:
        raise ValueError("fewer rows than clusters")
    n_tasks = tasks or df.sparkSession.sparkContext.defaultParallelism

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [matrix(b.column("features")) for b in batches if b.num_rows]
        meeting = Meeting(BarrierTaskContext.get())
        centroids, spare, moved = first[:n_clusters].copy(), list(first[n_clusters:]), None
        rows = Bounded(np.concatenate(held) if held else np.zeros((0, centroids.shape[1])))
        for n_iter in range(1, max_iter + 1):
            rows.assign(centroids, moved)
            part = np.zeros((n_clusters, centroids.shape[1] + 1))
            np.add.at(part, rows.cluster, np.column_stack([rows.x, np.ones(len(rows.x))]))
            total = meeting.total(part)
            new = np.array([t[:-1] / t[-1] if t[-1] else spare.pop(0) if spare else c for t, c in zip(total, centroids, strict=True)])
            still, moved = np.allclose(centroids, new), np.sqrt(((new - centroids) ** 2).sum(axis=1))
            centroids = new
            if still:
                break
        made = int(meeting.total(np.array([float(rows.made)]))[0])
        meeting.close()
        if meeting.me == 0:
            yield pa.RecordBatch.from_arrays([pa.array([n_iter]), pa.array([made]), pa.array([centroids.ravel()], pa.list_(pa.float64()))], names=["n_iter", "made", "centroids"])

    found = written(df.select("id", "features").repartition(n_tasks, "id").mapInArrow(fit, "n_iter bigint, made bigint, centroids array<double>", barrier=True), "kmeans").first()
    return KMeans(np.array(found.centroids).reshape(n_clusters, -1), int(found.n_iter)), int(found.made)


def inertia(df: DataFrame, centroids: np.ndarray) -> DataFrame:
    """One row: the sum of squared distances to the nearest centroid."""
    return assign(df, centroids).agg(F.sum("dist").alias("inertia"))


def label_map(clusters: DataFrame, tasks: int = 0) -> DataFrame:
    """(cluster, mapped): the one-to-one map of clusters to labels with the most rows in agreement; surplus clusters have none."""
    return best_map(contingency(clusters), "cluster", "label", tasks=tasks).select("cluster", F.col("label").alias("mapped"))


def apply_label_map(clusters: DataFrame, mapping: DataFrame) -> DataFrame:
    """Adds prediction: the cluster's label, -1 where it has none."""
    return clusters.join(mapping, "cluster", "left").withColumn("prediction", F.coalesce("mapped", F.lit(-1))).drop("mapped")


def mapped_accuracy(train: DataFrame, test: DataFrame) -> DataFrame:
    """(part, accuracy) with the map learned on train; both need label and cluster."""
    mapping = label_map(train)
    part = lambda df, name: accuracy(apply_label_map(df, mapping)).select(F.lit(name).alias("part"), "accuracy")
    return part(train, "train").unionByName(part(test, "test"))
