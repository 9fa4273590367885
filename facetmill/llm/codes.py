"""Vector codes by product quantisation, its nearest entries found by Exponion search.

Vectors of whole numbers are cut into equal parts, each position with a
codebook of its own. A part's search starts at the entry it had in the round
before, at distance r: an entry that is as near lies within 2r of that one, so
only the start's neighbours inside this radius are looked at, nearest first,
and the radius shrinks to r + r' once an entry at r' < r is found. The
neighbour lists, sorted by distance, are made once a round from the codebooks
(parts x entries numbers, broadcast; their size does not depend on the rows).

Distances are exact in whole numbers, ties go to the lower index, and the means
are rounded down, so the result equals Lloyd rounds over all pairs on any
number of tasks. Each round writes the rows with their entries to the shared
folder, beside each task's sums per entry: a lost executor repeats tasks of one
round, and of a round only the sums (at most parts x entries rows a task) are
shuffled.

Defined results: rows whose vector is null or holds a null or a non-finite
component are dropped, as are vectors of another length than the first one's
(in order of vec_id, nulls last) or of a length that the parts do not divide;
rows with equal or missing ids count each for itself; with fewer rows than
entries the codebooks are shorter; an empty table gives an empty result.
Squared distances are taken to fit 63 bits, else the job fails. Columns
besides vec_id, embedding and label are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_group_value, written
from .topk import whole_numbers

PARTS, ENTRIES, ROUNDS, FACTOR = 4, 256, 4, 1024
#: Entries of a neighbour list that are looked at together.
STEP = 32


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared Euclidean distances of whole-number rows, all with all."""
    most = (float(np.abs(x).max(initial=0)) + float(np.abs(y).max(initial=0))) ** 2 * max(1, x.shape[1])
    if most >= 2.0**62:
        raise OverflowError("squared distances do not fit 63 bits")
    kind = np.float64 if most < 2.0**52 else np.int64
    a, b = x.astype(kind), y.astype(kind)
    return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)).astype(np.int64)


class Codebook:
    """Entries of one part position, each with all others in order of their distance (equal ones by index)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        between = squared_distances(entries, entries)
        self.near = np.argsort(between, axis=1, kind="stable")
        self.far = np.take_along_axis(between, self.near, axis=1)

    def search(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each row of ``x`` its nearest entry and the squared distance, from the entries ``start``; and how many distances were made."""
        best = np.asarray(start, dtype=np.int64).copy()
        least = np.zeros(len(x), dtype=np.int64)
        made = 0
        order = np.argsort(best, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(best[order])) + 1) if len(x) else []:
            home = int(best[rows[0]])
            first = squared_distances(x[rows], self.entries[home][None])[:, 0]
            least[rows] = first
            made += len(rows)
            reach = np.searchsorted(self.far[home], 4 * first, side="right")
            for at in range(0, len(self.entries), STEP):
                going = np.flatnonzero(reach > at)
                if not len(going):
                    break
                some = rows[going]
                listed = np.sort(self.near[home, at : min(at + STEP, int(reach.max()))])
                found = squared_distances(x[some], self.entries[listed])
                made += found.size
                column = found.argmin(axis=1)
                distance, index = found[np.arange(len(some)), column], listed[column]
                better = (distance < least[some]) | ((distance == least[some]) & (index < best[some]))
                least[some[better]], best[some[better]] = distance[better], index[better]
                # (r + r')^2, never rounded below the true square.
                bound = np.ceil((np.sqrt(first[going].astype(np.float64)) + np.sqrt(least[some].astype(np.float64))) ** 2 * (1 + 1e-12)) + 1
                reach[going] = np.minimum(reach[going], np.searchsorted(self.far[home], bound, side="right"))
        return best, least, made


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _searched(rows: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """``rows`` (vec_id, label, v, code) with new code and error; then for each task and entry met a row with part, entry, n and the sums of its parts."""
    parts, size = len(books), width // len(books)
    shared = rows.sparkSession.sparkContext.broadcast(books)
    names = ["vec_id", "label", "v", "code", "error", "part", "entry", "n", "sums"]
    label_type = pa.field("label", _arrow_type(rows, "label")).type
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [Codebook(b) for b in shared.value]
        sums = [np.zeros(b.shape, dtype=np.int64) for b in shared.value]
        counts = [np.zeros(len(b), dtype=np.int64) for b in shared.value]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(2), width)
            old = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint8).reshape(-1, parts)
            code, error = np.empty(old.shape, dtype=np.uint8), np.zeros(len(x), dtype=np.int64)
            for p, book in enumerate(tables):
                piece = x[:, p * size : (p + 1) * size]
                entry, distance, _ = book.search(piece, old[:, p])
                code[:, p] = entry
                error += distance
                np.add.at(sums[p], entry, piece)
                counts[p] += np.bincount(entry, minlength=len(counts[p]))
            codes = pa.array([c.tobytes() for c in code], pa.binary())
            none = lambda kind: pa.nulls(len(x), kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), codes, pa.array(error), none(pa.int32()), none(pa.int32()), none(pa.int64()), none(longs)], names=names)
        met = [(p, e, int(n), sums[p][e].tolist()) for p in range(parts) for e, n in enumerate(counts[p]) if n]
        if met:
            part, entry, n, total = zip(*met, strict=True)
            none = lambda kind: pa.nulls(len(met), kind)
            yield pa.RecordBatch.from_arrays([none(pa.int64()), none(label_type), none(longs), none(pa.binary()), none(pa.int64()), pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n, pa.int64()), pa.array(total, longs)], names=names)

    label = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "label", "v", "code").mapInArrow(run, f"vec_id bigint, label {label}, v array<bigint>, code binary, error bigint, part int, entry int, n bigint, sums array<bigint>")


def _arrow_type(rows: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema[name].dataType)


def _moved(met: DataFrame, books: list[np.ndarray], size: int) -> list[np.ndarray]:
    """The entries' new places: means rounded down, from the sums of all tasks; entries without parts stay. At most parts x entries rows are collected."""
    total = met.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(size)])
    out = [b.copy() for b in books]
    for part, entry, n, *sums in total.collect():
        out[part][entry] = np.array(sums, dtype=np.int64) // n
    return out


def compress_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, factor: int = FACTOR) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of the rows of (vec_id, embedding, label); at most 256 ``entries``."""
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte a part: at most 256 entries")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.when(F.size("embedding") == 0, F.array().cast("array<bigint>")).otherwise(whole_numbers(F.col("embedding"), factor)).alias("v"))
    rows = rows.where("v is not null").withColumn("code", F.lit(bytes(parts)))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()
    width = len(first[0].v) if first and len(first[0].v) % parts == 0 else 0
    if not first or (first[0].v and not width):
        rows = rows.where("false")
    state = written(rows.where(F.size("v") == width), "codes-start")
    firsts = [r.v for r in state.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]
    start = np.array(firsts, dtype=np.int64).reshape(len(firsts), width)
    size = width // parts
    books = [start[:, p * size : (p + 1) * size] for p in range(parts)]
    for number in range(rounds if len(start) and size else 0):
        state = written(_searched(state.where("part is null") if number else state, books, width), "codes-round")
        books = _moved(state.where("part is not null"), books, size)
    found = written(_searched(state.where("part is null") if "part" in state.columns else state, books, width).where("part is null").select("vec_id", "label", "code", "error"), "codes-found")
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    totals = found.groupBy("label").agg(F.sum("error").alias("label_error"))
    out = join_group_value(found, totals, "label")
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"), "label")
