"""Nearest-neighbour classification: exact neighbours in cells around pivots, majority vote."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.blocks import arrays, matrix
from ..sources.shared import written

#: Training rows held by a task (where groups share it: SHARED_ROWS), their numbers at most, and query rows a task should have at least.
SHARD_ROWS, SHARED_ROWS, SHARD_NUMBERS, QUERY_ROWS = 50_000, 150_000, 10_000_000, 2_000
#: Most groups that share a search, one bit each; how much more work it may be than searches of their own.
MOST_GROUPS, MORE_WORK = 60, 1.5
#: Most cells of a group: their pivots go to all tasks.
MOST_CELLS = 2_048
#: Distances in a tile, or numbers in a block of differences, and queries that meet tiles together.
BLOCK_CELLS, QUERY_BLOCK = 1_000_000, 128
#: Numbers of differences made together in single precision, so few that a core's cache holds them.
CACHE_NUMBERS = 131_072


def distances(queries: np.ndarray, train: np.ndarray, p: int) -> np.ndarray:
    """Sum of |a - b| ** p, without root."""
    gap = np.abs(queries[:, None, :] - train[None, :, :])
    return (gap if p == 1 else gap * gap if p == 2 else gap * gap * gap if p == 3 else gap**p).sum(axis=2)


def paired(queries: np.ndarray, train: np.ndarray, p: int) -> np.ndarray:
    """The distance of each row of one to that of the other."""
    gap = np.abs(queries - train)
    return (gap if p == 1 else gap * gap if p == 2 else gap * gap * gap if p == 3 else gap**p).sum(axis=1)


class Rows:
    """Training rows for searches: in double precision for the distances, in single precision for what rules out most rows before."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids, self.middle = x, ids, x.mean(axis=0) if len(x) else 0.0
        self.small = (x - self.middle).astype(np.float32)
        self.columns: np.ndarray | None = None
        self.squares = (self.small.astype(np.float64) ** 2).sum(axis=1)
        self.largest = float(np.sqrt(self.squares.max(initial=0.0)))

    def least(self, block: np.ndarray, at: slice, p: int) -> tuple[np.ndarray, np.ndarray]:
        """A number for each query and row of ``at`` that is at most the p-th power of their distance, and a query's slack in it.

        By p = 1 the sums themselves, else the squares: no row is nearer by a
        higher norm than its Euclidean distance times width ** (1 / p - 1 / 2).
        """
        small, width = (block - self.middle).astype(np.float32), max(1, block.shape[1])
        own = (small.astype(np.float64) ** 2).sum(axis=1)
        reach = np.sqrt(own) + self.largest
        if p == 1:
            self.columns = np.ascontiguousarray(self.small.T) if self.columns is None else self.columns
            total = np.zeros((len(block), at.stop - at.start), dtype=np.float32)
            gap = np.empty_like(total)
            for j in range(block.shape[1]):
                np.subtract(small[:, j, None], self.columns[j, at], out=gap)
                np.abs(gap, out=gap)
                total += gap
            return total, 1e-6 * width * np.sqrt(width) * reach
        total = (-2 * small) @ self.small[at].T
        total += self.squares[at].astype(np.float32)
        total += own.astype(np.float32)[:, None]
        return total, 1e-6 * (8 + width) * reach**2

    def within(self, block: np.ndarray, query: np.ndarray, row: np.ndarray, kth: np.ndarray, p: int) -> np.ndarray:
        """Which pairs may be no farther than their query's ``kth``, by their differences in single precision; p is 2 at least."""
        small, width = (block - self.middle).astype(np.float32), max(1, block.shape[1])
        reach = np.sqrt((small.astype(np.float64) ** 2).sum(axis=1)) + self.largest
        bars = (kth ** (1.0 / p) * (1 + 1e-6 * (1 + width / p)) + 1e-6 * reach) ** p
        bars = np.nextafter(np.minimum(bars, np.finfo(np.float32).max).astype(np.float32), np.float32(np.inf))  # where sums overflow, all may be
        out, step = np.empty(len(row), dtype=bool), max(1, CACHE_NUMBERS // width)
        for at in range(0, len(row), step):
            who = query[at : at + step]
            gap = small.take(who, axis=0)
            gap -= self.small.take(row[at : at + step], axis=0)
            np.abs(gap, out=gap)
            out[at : at + step] = ~(np.einsum("ij,ij->i", gap * gap, gap if p == 3 else gap ** (p - 2)) > bars[who])
        return out


def _bars(kth: np.ndarray, slack: np.ndarray, p: int, width: int) -> np.ndarray:
    """Below which values of Rows.least a row can be among the best, by the k-th distance so far."""
    if p == 1:
        return kth + slack
    return np.where(np.isfinite(kth), (kth ** (1.0 / p) * max(1, width) ** (0.5 - 1.0 / p)) ** 2 * (1 + 1e-6), np.inf) + slack


def nearest(queries: np.ndarray, rows: Rows, k: int, p: int, reach: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query rows, rows of train, distances) of the k nearest, ties to the smaller id, for blocks of queries; p is a whole number.

    Tiles of at most BLOCK_CELLS distances are made in single precision; rows
    that may be among the k best, with room for rounding, are measured anew.
    ``reach``: of each query, the distance beyond which no row is wanted.
    """
    n, width = len(rows.x), queries.shape[1]
    k = min(k, n)
    reach = np.full(len(queries), np.inf) if reach is None else reach
    step = max(k, BLOCK_CELLS // QUERY_BLOCK)
    for first in range(0, len(queries), QUERY_BLOCK):
        block, within = queries[first : first + QUERY_BLOCK], reach[first : first + QUERY_BLOCK]
        q = len(block)
        if not (np.abs(block).max(initial=0.0) < 1e9 and rows.largest < 1e9):  # not for single precision, or not finite
            for i in range(q):
                exact = np.concatenate([distances(block[i : i + 1], rows.x[low : low + step], p)[0] for low in range(0, n, step)])
                order = np.lexsort((rows.ids, exact))[:k]
                order = order[~(exact[order] > within[i])]
                yield np.full(len(order), first + i), order, exact[order]
            continue
        best, best_row = np.full((q, k), np.inf), np.full((q, k), -1, dtype=np.int64)
        for low in range(0, n, step):
            tile = slice(low, min(n, low + step))
            rough, slack = rows.least(block, tile, p)
            kth = np.minimum(best[:, -1], within)
            unknown = np.flatnonzero(~np.isfinite(kth))
            if len(unknown) and tile.stop - low >= k:  # a first k-th distance: the largest of the k roughly nearest rows here
                m = k if p <= 2 else min(4 * k, tile.stop - low)  # of higher norms the nearest are among more rows
                near = np.argpartition(rough[unknown], m - 1, axis=1)[:, :m]
                kth[unknown] = np.partition(paired(np.repeat(block[unknown], m, axis=0), rows.x[low + near.ravel()], p).reshape(-1, m), k - 1, axis=1)[:, k - 1]
                kth = np.minimum(kth, within)
            at = np.flatnonzero((rough <= np.nextafter(_bars(kth, slack, p, width).astype(np.float32), np.float32(np.inf))[:, None]).ravel())
            for part in np.array_split(at, max(1, len(at) * width // BLOCK_CELLS)):
                query, row = np.divmod(part, tile.stop - low)
                row += low
                kth = np.minimum(kth, best[:, -1])
                if p > 2:  # Euclidean distances leave too many
                    near = rows.within(block, query, row, kth, p)
                    query, row = query[near], row[near]
                dist = paired(block[query], rows.x[row], p)
                kept = dist <= kth[query]
                _merge(best, best_row, query[kept], row[kept], dist[kept], rows.ids)
        found = best_row >= 0
        yield first + np.nonzero(found)[0], best_row[found], best[found]


def nearest_of_groups(queries: np.ndarray, rows: Rows, k: int, p: int, reach: np.ndarray, wanted: np.ndarray, member: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(group, query rows, rows of train, distances): the k nearest rows of each group that a query is in; ``wanted`` and ``member`` have a bit a group.

    One list of the nearest rows of all groups serves all large ones; a query
    whose list holds too few rows of a group is searched for in its rows alone,
    and so are all for small groups.
    """
    n, own = len(rows.x), {}
    sizes = {g: int((member >> g & 1).sum()) for g in range(MOST_GROUPS) if (wanted >> g & 1).any()}
    large = [g for g, m in sizes.items() if m and 4 * m >= n]

    def alone(g: int, who: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        if g not in own:
            at = np.flatnonzero(member >> g & 1)
            own[g] = at, Rows(rows.x[at], rows.ids[at])
        at, few = own[g]
        for query, near, dist in nearest(queries[who], few, k, p, reach[who]):
            yield g, who[query], at[near], dist

    for g in sizes.keys() - set(large):
        if sizes[g]:
            yield from alone(g, np.flatnonzero(wanted >> g & 1))
    if not large:
        return
    share = min(sizes[g] for g in large) / n
    most = min(n, int((k + 4 * np.sqrt(k * (1 - share))) / share) + 2)
    asked = np.flatnonzero(wanted & sum(1 << g for g in large))
    lacking: dict[int, list] = {g: [] for g in large}
    for query, row, dist in nearest(queries[asked], rows, most, p, reach[asked]):
        query = asked[query]
        who, length = np.unique(query, return_counts=True)
        cut = who[(length == most) & (most < n)]  # there may be more rows within reach
        both = wanted[query] & member[row]
        for g in large:
            hit = np.flatnonzero(both >> g & 1)
            place = np.arange(len(hit)) - np.searchsorted(query[hit], query[hit])
            short = cut[(wanted[cut] >> g & 1 == 1) & (np.searchsorted(query[hit], cut, "right") - np.searchsorted(query[hit], cut) < min(k, sizes[g]))]
            lacking[g].append(short)
            hit = hit[(place < k) & ~np.isin(query[hit], short)]
            yield g, query[hit], row[hit], dist[hit]
    for g, short in lacking.items():
        if sum(map(len, short)):
            yield from alone(g, np.concatenate(short))


def _merge(best: np.ndarray, best_row: np.ndarray, query: np.ndarray, row: np.ndarray, dist: np.ndarray, ids: np.ndarray) -> None:
    """Puts more rows of some queries among their k best, in order of distance and id."""
    k = best.shape[1]
    changed = np.unique(query)
    old = best_row[changed] >= 0
    who = np.concatenate([np.repeat(changed, k)[old.ravel()], query])
    rows, dists = np.concatenate([best_row[changed][old], row]), np.concatenate([best[changed][old], dist])
    order = np.lexsort((ids[rows], dists, who))
    who, rows, dists = who[order], rows[order], dists[order]
    place = np.arange(len(who)) - np.searchsorted(who, who)
    top = place < k
    best[who[top], place[top]], best_row[who[top], place[top]] = dists[top], rows[top]


def neighbours(train: DataFrame, queries: DataFrame, k: int, p: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """(by…, query_id, rank, train_id, label, dist): the k nearest training rows of each query of the same group."""
    return neighbours_by_norm(train, queries, k, (p,), by).drop("p")


@dataclass(frozen=True)
class Cells:
    """Pivots of a group with, for each norm, the largest distance of a row in their cell, and how many rows these have."""

    pivots: np.ndarray
    counts: np.ndarray
    radius: np.ndarray  # norms x cells

    def bounds(self, queries: np.ndarray, i: int, p: int) -> tuple[np.ndarray, np.ndarray]:
        """Distances to the pivots, and what no row of a cell can be nearer than."""
        step = max(1, BLOCK_CELLS // max(1, self.pivots.size))
        far = np.concatenate([distances(queries[at : at + step], self.pivots, p) for at in range(0, len(queries), step)]) ** (1.0 / p) if len(queries) else np.zeros((0, len(self.pivots)))
        return far, np.maximum(far - self.radius[i], 0.0) * (1 - 1e-9) - 1e-12

    def homes(self, queries: np.ndarray, ps: Sequence[int], k: int) -> np.ndarray:
        """Whether a cell is among a query's nearest ones that together have k rows, by any norm."""
        out = np.zeros((len(queries), len(self.pivots)), dtype=bool)
        for i, p in enumerate(ps):
            order = np.argsort(self.bounds(queries, i, p)[0], axis=1, kind="stable")
            before = np.cumsum(self.counts[order], axis=1) - self.counts[order]
            np.put_along_axis(out, order, np.take_along_axis(out, order, 1) | ((before < k) & (self.counts[order] > 0)), 1)
        return out

    def others(self, queries: np.ndarray, ps: Sequence[int], k: int, reach: np.ndarray) -> np.ndarray:
        """Whether a cell that is no home of a query may have rows within its ``reach`` (query x norm)."""
        near = np.zeros((len(queries), len(self.pivots)), dtype=bool)
        for i, p in enumerate(ps):
            near |= (self.bounds(queries, i, p)[1] <= reach[:, i, None]) & (self.counts > 0)
        return near & ~self.homes(queries, ps, k)


def neighbours_by_norm(train: DataFrame, queries: DataFrame, k: int, ps: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """(by…, p, query_id, rank, train_id, label, dist): the k nearest training rows of each query of the same group, for every norm.

    More rows than a task takes are dealt into cells around pivots. A query
    first meets its nearest cells that have k rows; the k-th distance found
    there is its reach, and it goes on only to cells whose pivot's distance
    less their radius is within it. The best of all cells are chosen by a
    window. Cells with many rows are split, and cells that many queries go to
    are copied for blocks of queries; nothing but pivots, radii and counts (a
    row a cell, at most MOST_CELLS a group) comes to the driver.
    """
    both = train.select(*by, F.lit(1).alias("_n")).unionByName(queries.select(*by, F.lit(0).alias("_n")))
    counted = both.groupBy(*by).agg(F.sum("_n").alias("_t"), F.sum(1 - F.col("_n")).alias("_q")).withColumn("_c", F.lit(0).cast("bigint")).collect()  # a row a group
    if by and (shared := _shared(train, queries, by, [r for r in counted if r["_t"] and r["_q"]])):
        return _neighbours_shared(*shared, k, ps, by)
    cells = _cells(train, max((r["_t"] or 0 for r in counted), default=0))
    if cells <= 1:
        place = F.lit(0).cast("bigint")
        found = _search(train.select(*by, "id", "features", "label").withColumn("_c", place), queries.select(*by, "id", "features").withColumn("_c", place).withColumn("_reach", F.array(*[F.lit(float("inf")) for _ in ps])), k, ps, by, [r for r in counted if r["_t"] and r["_q"]])
    else:
        placed, known = pivot_cells(train, cells, ps, by)
        queries = written(queries.select(*by, "id", "features"), "knn-queries")
        first = written(_search(placed, targets(queries, known, k, ps, by), k, ps, by), "knn-first")
        rank = F.row_number().over(Window.partitionBy(*by, "p", "query_id").orderBy("dist", "train_id"))
        kth = first.withColumn("rank", rank).where(F.col("rank") == k).groupBy(*by, F.col("query_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("p", "dist"))).alias("_kth"))
        found = first.unionByName(_search(placed, targets(queries.join(kth, [*by, "id"], "left"), known, k, ps, by), k, ps, by))
    order = Window.partitionBy(*by, "p", "query_id").orderBy("dist", "train_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*by, "p", "query_id", "rank", "train_id", "label", "dist")


def _cells(train: DataFrame, rows: int) -> int:
    """The cells that so many rows are dealt into."""
    return min(MOST_CELLS, -(-rows // _held(train)))


def _held(train: DataFrame) -> int:
    """Training rows that a task holds."""
    first = train.select(F.size("features").alias("d")).first()
    return min(SHARED_ROWS if _bits(train) else SHARD_ROWS, max(1, SHARD_NUMBERS // max(1, first.d if first else 1)))


def _shared(train: DataFrame, queries: DataFrame, by: Sequence[str], groups: list) -> tuple | None:
    """Each row once with the groups it is in as bits ``_g`` (training rows, queries), their numbers, and (by…, _i) of the groups; None where groups hold other rows."""
    work = sum(r["_t"] * r["_q"] for r in groups)
    if not 1 < len(groups) <= MOST_GROUPS:
        return None
    n_train, n_queries = (df.select("id").distinct().count() for df in (train, queries))
    if n_train * n_queries > MORE_WORK * work:
        return None
    schema = T.StructType([*[train.schema[c] for c in by], T.StructField("_i", T.IntegerType())])
    index = train.sparkSession.createDataFrame([(*[r[c] for c in by], i) for i, r in enumerate(groups)], schema)
    once = []
    for df, columns in ((train, ["id", "features", "label"]), (queries, ["id", "features"])):
        bits = df.join(F.broadcast(index), list(by)).groupBy(*columns).agg(F.expr("bit_or(shiftleft(1L, _i))").alias("_g"), F.count("*").alias("_n"))  # index: a row a group
        once.append(written(bits, "knn-rows"))
    check = [df.agg(F.count("*").alias("n"), F.max(F.col("_n") - F.bit_count("_g")).alias("again"), F.countDistinct("id").alias("ids")).first() for df in once]
    if any(c.again for c in check) or check[1].n != check[1].ids or check[0].n * check[1].n > MORE_WORK * work:
        return None  # a row twice in a group, or rows that differ under one id
    return once[0].drop("_n"), once[1].drop("_n"), check[0].n, check[1].n, index


def _neighbours_shared(train: DataFrame, queries: DataFrame, n_train: int, n_queries: int, index: DataFrame, k: int, ps: Sequence[int], by: Sequence[str]) -> DataFrame:
    """As neighbours_by_norm, for groups that mostly hold the same rows, as folds do: distances are made once for all of them."""
    order = Window.partitionBy("_i", "p", "query_id").orderBy("dist", "train_id")
    cells = _cells(train, n_train)
    if cells <= 1:
        place = F.lit(0).cast("bigint")
        found = _search(train.withColumn("_c", place), queries.withColumn("_c", place).withColumn("_reach", F.array(*[F.lit(float("inf")) for _ in ps])), k, ps, (), [{"_c": 0, "_t": n_train, "_q": n_queries}])
    else:
        placed, known = pivot_cells(train, cells, ps)
        first = written(_search(placed, targets(queries, known, k, ps), k, ps, ()), "knn-first")
        kth = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).groupBy("p", F.col("query_id").alias("id")).agg(F.max("dist").alias("dist"), F.count("*").alias("_n"))
        kth = kth.join(queries.select("id", "_g"), "id").where(F.col("_n") == F.bit_count("_g")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("p", "dist"))).alias("_kth"))
        found = first.unionByName(_search(placed, targets(queries.join(kth, ["id"], "left"), known, k, ps), k, ps, ()))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(F.broadcast(index), "_i").select(*by, "p", "query_id", "rank", "train_id", "label", "dist")  # a row a group


def pivot_cells(train: DataFrame, cells: int, ps: Sequence[int], by: Sequence[str] = ()) -> tuple[DataFrame, dict[tuple, Cells]]:
    """Training rows with their cell ``_c``, written once, and the cells of each group. Pivots are the ``cells`` rows of a group that come first by a hash."""
    order = (F.md5(F.concat_ws(":", F.lit("pivot"), F.col("id").cast("string"))), F.col("id"))
    rows = train.select(*by, "id", "features")
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= cells) if by else rows.orderBy(*order).limit(cells)
    chosen: dict[tuple, list] = {}
    for r in first.collect():
        chosen.setdefault(tuple(r[c] for c in by), []).append((r.id, r.features))
    pivots = train.sparkSession.sparkContext.broadcast({key: np.array([f for _, f in sorted(rows)]) for key, rows in chosen.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, cell, far = matrix(batch.column("features")), np.zeros(batch.num_rows, dtype=np.int64), np.zeros((batch.num_rows, len(ps)))
            for key, rows in _by_key(batch, by):
                own = pivots.value[key]
                for part in np.array_split(rows, max(1, len(rows) // 256)):
                    cell[part] = (-2.0 * (x[part] @ own.T) + (own**2).sum(axis=1)).argmin(axis=1)
                    gap = np.abs(x[part] - own[cell[part]])
                    far[part] = np.column_stack([(gap**p).sum(axis=1) ** (1.0 / p) for p in ps])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), arrays(far)], names=[*batch.schema.names, "_c", "_far"])

    rows = train.select(*by, "id", "features", "label", *_bits(train))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = written(rows.mapInArrow(place, f"{fields}, _c bigint, _far array<double>"), "knn-cells")
    counts = placed.groupBy(*by, "_c").agg(F.count("*").alias("n"), *[F.max(F.col("_far")[i]).alias(f"r{i}") for i in range(len(ps))]).collect()
    known = {}
    for key, own in pivots.value.items():
        count, radius = np.zeros(len(own), dtype=np.int64), np.zeros((len(ps), len(own)))
        for r in counts:
            if tuple(r[c] for c in by) == key:
                count[r["_c"]] = r["n"]
                radius[:, r["_c"]] = [r[f"r{i}"] for i in range(len(ps))]
        known[key] = Cells(own, count, radius)
    return placed.drop("_far"), known


def _bits(df: DataFrame) -> list[str]:
    """The column of group bits, where there is one."""
    return ["_g"] if "_g" in df.columns else []


def _by_key(batch: pa.RecordBatch, by: Sequence[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """The groups in a batch and their rows' places."""
    keys = list(zip(*[batch.column(c).to_pylist() for c in by], strict=True)) if by else [()] * batch.num_rows
    places: dict[tuple, list[int]] = {}
    for i, key in enumerate(keys):
        places.setdefault(key, []).append(i)
    for key, rows in places.items():
        yield key, np.array(rows)


def targets(queries: DataFrame, known: dict[tuple, Cells], k: int, ps: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Each query once for every cell ``_c`` that it goes to: its homes, or with ``_kth`` (norm -> k-th distance found there) the others in reach. ``_reach``: by norm, the distance beyond which it wants no row."""
    columns = [*by, "id", "features", *_bits(queries)]
    shared, again = queries.sparkSession.sparkContext.broadcast(known), "_kth" in queries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("features"))
            for key, places in _by_key(batch, by):
                cells = shared.value.get(key)
                if cells is None:
                    continue
                # A query may go to all cells, so what is held and sent at once is bounded by cells and by numbers.
                for rows in np.array_split(places, -(-len(places) * len(cells.pivots) // BLOCK_CELLS)):
                    if again:
                        found = [dict(m or ()) for m in batch.column("_kth").take(pa.array(rows)).to_pylist()]
                        reach = np.array([[f.get(p, np.inf) ** (1.0 / p) * (1 + 1e-9) for p in ps] for f in found])
                        query, cell = np.nonzero(cells.others(x[rows], ps, k, reach))
                        wanted = np.array([[f.get(p, np.inf) for p in ps] for f in found])
                    else:
                        query, cell = np.nonzero(cells.homes(x[rows], ps, k))
                        wanted = np.full((len(rows), len(ps)), np.inf)
                    step = max(1, BLOCK_CELLS // max(1, x.shape[1]))
                    for at in range(0, len(query), step):
                        who = query[at : at + step]
                        part = batch.select(columns).take(pa.array(rows[who]))
                        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell[at : at + step].astype(np.int64)), arrays(wanted[who])], names=[*part.schema.names, "_c", "_reach"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.select(*columns).schema.fields)
    return queries.mapInArrow(run, f"{fields}, _c bigint, _reach array<double>")


def _search(train: DataFrame, queries: DataFrame, k: int, ps: Sequence[int], by: Sequence[str], cells: list | None = None) -> DataFrame:
    """(by…, p, query_id, train_id, label, dist): the k best of each part of a cell for the queries sent to that cell. cells: its rows (by…, _c, _t, _q), where known.

    Where both have bits ``_g``, the k best of each group ``_i`` that a query is in.
    """
    spark, bits = train.sparkSession, _bits(train)
    held_rows = _held(train)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if cells is None:
        cells = train.groupBy(*by, "_c").agg(F.count("*").alias("_t")).join(queries.groupBy(*by, "_c").agg(F.count("*").alias("_q")), [*by, "_c"]).collect()  # a row a cell
    work, grid, n_cells = sum(r["_t"] * r["_q"] for r in cells), [], 0
    for r in cells:
        # Queries are read in a stream, so their blocks are only as many as keep all tasks busy: each has a copy of the cell.
        subs = -(-r["_t"] // held_rows)
        blocks = max(1, min(-(-r["_q"] // QUERY_ROWS), -(-parts * r["_t"] * r["_q"] // (work * subs))))
        grid.append((*[r[c] for c in by], r["_c"], subs, blocks, n_cells))
        n_cells += subs * blocks
    tasks = max(1, min(n_cells, 4 * parts))
    fields = [*[train.schema[c] for c in by], *[T.StructField(c, T.LongType()) for c in ("_c", "_subs", "_blocks", "_first")]]
    grid = F.broadcast(spark.createDataFrame(grid, T.StructType(fields)))  # a row a cell
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    left = train.select(*by, "id", "features", "label", "_c", *bits).join(grid, [*by, "_c"]).withColumn("_s", dealt("_subs")).withColumn("_b", every("_blocks")).withColumn("_kind", F.lit(0)).withColumn("_reach", F.lit(None).cast("array<double>"))
    right = queries.select(*by, "id", "features", F.lit(0).alias("label"), "_c", "_reach", *bits).join(grid, [*by, "_c"]).withColumn("_b", dealt("_blocks")).withColumn("_s", every("_subs")).withColumn("_kind", F.lit(1))
    cell = F.col("_first") + F.col("_s") * F.col("_blocks") + F.col("_b")
    rows = left.unionByName(right).withColumn("_cell", cell).drop("_c", "_s", "_b", "_subs", "_blocks", "_first")
    names = [*by, "p", "query_id", "train_id", "label", "dist"] + ["_i"] * bool(bits)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, known, labels, member = None, [], None, None, None
        for batch in batches:
            cells, kinds = batch.column("_cell").to_pylist(), batch.column("_kind").to_pylist()
            at = 0
            while at < batch.num_rows:
                end = at
                while end < batch.num_rows and (cells[end], kinds[end]) == (cells[at], kinds[at]):
                    end += 1
                part = pa.Table.from_batches([batch.slice(at, end - at)])
                if cells[at] != current:
                    current, held, known, labels = cells[at], [], None, None
                if kinds[at] == 0:
                    held.append(part)
                elif held:
                    if known is None:
                        all_rows = pa.concat_tables(held)
                        known, labels = Rows(matrix(all_rows.column("features")), all_rows.column("id").to_numpy()), all_rows.column("label").to_numpy()
                        member = all_rows.column("_g").to_numpy() if bits else None
                        held = [part.slice(0, 0)]  # the rows are held once
                        del all_rows
                    block = matrix(part.column("features"))
                    reach = matrix(part.column("_reach"))
                    for i, p in enumerate(ps):
                        if bits:
                            lists = nearest_of_groups(block, known, k, p, reach[:, i], part.column("_g").to_numpy(), member)
                        else:
                            lists = ((None, *found) for found in nearest(block, known, k, p, reach[:, i]))
                        for group, query, near, dist in lists:
                            taken = part.select([*by, "id"]).take(pa.array(query))
                            more = [pa.array(np.full(len(query), group, dtype=np.int32))] if bits else []
                            yield from pa.table([*[taken.column(c) for c in by], pa.array(np.full(len(query), p, dtype=np.int32)), taken.column("id"), pa.array(known.ids[near]), pa.array(labels[near]), pa.array(dist), *more], names=names).combine_chunks().to_batches()
                at = end

    schema = T.StructType([*[train.schema[c] for c in by], T.StructField("p", T.IntegerType()), T.StructField("query_id", T.LongType()), T.StructField("train_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("dist", T.DoubleType()), *[T.StructField("_i", T.IntegerType()) for _ in bits]])
    return rows.repartitionById(tasks, F.pmod("_cell", F.lit(tasks)).cast("int")).sortWithinPartitions("_cell", "_kind").mapInArrow(search, schema)


def vote(near: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by…, id, prediction): the label most neighbours have; ties: the smallest."""
    counts = near.groupBy(*by, "query_id", "label").agg(F.count("*").alias("n"))
    best = counts.groupBy(*by, "query_id").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("prediction"))
    return best.withColumnRenamed("query_id", "id")


def knn_predict(train: DataFrame, queries: DataFrame, k: int = 5, p: int = 2, by: Sequence[str] = ()) -> DataFrame:
    return vote(neighbours(train, queries, k, p, by), by)


def knn_sweep(train: DataFrame, queries: DataFrame, ks: Sequence[int] = (1, 3, 5, 11), ps: Sequence[int] = (1, 2, 3), by: Sequence[str] = ()) -> DataFrame:
    """(by…, p, k, id, prediction) for every setting; one search serves all of them."""
    near = neighbours_by_norm(train, queries, max(ks), ps, by)
    near = near.withColumn("k", F.explode(F.lit(list(ks)))).where(F.col("rank") <= F.col("k"))
    return vote(near, [*by, "p", "k"])


class KNN:
    """Fit keeps the training table; predict votes among its rows."""

    def __init__(self, k: int = 5, p: int = 2):
        self.k, self.p = k, p

    def fit(self, df: DataFrame) -> KNN:
        self.train = df
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return knn_predict(self.train, df, self.k, self.p)
