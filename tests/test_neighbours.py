"""Neighbours over many cells: equal to the search of all rows, with fewer copies of the queries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetmill.operators import knn

SCHEMA = "id long, features array<double>, label int"


def clustered(spark, n, seed, at=0, spread=0.05, hot=False):
    rng = np.random.default_rng(seed)
    centers = np.random.default_rng(99).normal(0, 4, (12, 5))
    which = rng.integers(0, 12, n)
    if hot:
        which[: n // 2] = 3
    x = centers[which] + rng.normal(0, spread, (n, 5))
    x[:: 17] = np.round(x[:: 17])  # some equal rows
    return spark.createDataFrame([(at + i, f.tolist(), int(i) % 4) for i, f in enumerate(x)], SCHEMA)


@pytest.mark.parametrize(("spread", "hot"), [(0.05, False), (3.0, False), (0.05, True)])
def test_cells_change_nothing(spark, monkeypatch, spread, hot):
    train, queries = clustered(spark, 600, 1, spread=spread, hot=hot), clustered(spark, 90, 2, at=10_000, spread=spread)
    want = sorted(knn.neighbours_by_norm(train, queries, 7, (1, 2, 3)).collect())
    monkeypatch.setattr(knn, "SHARD_ROWS", 40)
    monkeypatch.setattr(knn, "QUERY_ROWS", 11)
    assert sorted(knn.neighbours_by_norm(train, queries, 7, (1, 2, 3)).collect()) == want and len(want) == 90 * 7 * 3


def test_groups_and_few_rows(spark, monkeypatch):
    train = clustered(spark, 200, 3).withColumn("fold", F.explode(F.array(F.lit(1), F.lit(2)))).where("fold = 1 or id < 3")
    queries = clustered(spark, 40, 4, at=10_000).withColumn("fold", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    want = sorted(knn.neighbours_by_norm(train, queries, 5, (2,), ["fold"]).collect())
    monkeypatch.setattr(knn, "SHARD_ROWS", 30)
    assert sorted(knn.neighbours_by_norm(train, queries, 5, (2,), ["fold"]).collect()) == want
    assert len(want) == 40 * 5 + 40 * 3


def test_queries_go_to_few_cells(spark, monkeypatch):
    """On clustered rows fewer than a third of the (query, cell) pairs are met."""
    train, queries = clustered(spark, 1200, 5), clustered(spark, 100, 6, at=10_000)
    placed, known = knn.pivot_cells(train, 24, (2,))
    first = knn.targets(queries, known, 5, (2,))
    monkeypatch.setattr(knn, "SHARD_ROWS", 50)
    near = knn.neighbours(train, queries, 5).where("rank = 5").select(F.col("query_id").alias("id"), F.create_map(F.lit(2), "dist").alias("_kth"))
    second = knn.targets(queries.join(near, "id"), known, 5, (2,))
    assert 100 <= first.count() and first.count() + second.count() < 100 * 24 / 3
    assert sum(c.counts.sum() for c in known.values()) == placed.count() == 1200


@pytest.mark.parametrize("p", [1, 2, 3, 4])
@pytest.mark.parametrize("kind", ["plain", "copies", "far", "huge", "holes"])
def test_screened_search_is_the_plain_one(p, kind, monkeypatch):
    rng = np.random.default_rng(p)
    x, queries, ids = rng.normal(0, 1, (700, 6)), rng.normal(0, 1, (60, 6)), rng.permutation(700)
    if kind == "copies":
        x[100:500] = x[0]
        queries[:20] = x[0]
    if kind == "far":
        x, queries = x * 1e-4 + 1000, queries * 1e-4 + 1000
    if kind == "huge":
        x, queries = x * 1e60, queries * 1e60
    if kind == "holes":
        x[::3, 2], queries[5, 0] = np.nan, np.inf
    monkeypatch.setattr(knn, "BLOCK_CELLS", 800)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 16)
    with np.errstate(all="ignore"):
        parts = list(knn.nearest(queries, knn.Rows(x, ids), 9, p))
        exact = knn.distances(queries, x, p)
    query, near, dist = (np.concatenate(c) for c in zip(*parts, strict=True))
    for i in range(60):
        order = np.lexsort((ids, exact[i]))[:9]
        assert near[query == i].tolist() == order.tolist() and np.array_equal(dist[query == i], exact[i][order], equal_nan=True)


def test_a_search_is_small_in_memory():
    """A shard of 50,000 rows took several arrays of 512 queries times all rows."""
    import tracemalloc

    rng = np.random.default_rng(0)
    rows, queries = knn.Rows(rng.normal(0, 1, (50_000, 8)), np.arange(50_000)), rng.normal(0, 1, (512, 8))
    tracemalloc.start()
    for p in (1, 2, 3):
        assert sum(len(d) for _, _, d in knn.nearest(queries, rows, 11, p)) == 512 * 11
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()


@pytest.mark.parametrize("shard", [50_000, 60])
def test_folds_share_a_search(spark, monkeypatch, shard):
    """Each fold had its own copy of the rows, and a pair's distance was made in every fold anew."""
    rows = clustered(spark, 400, 7, spread=2.0).withColumn("own", (F.col("id") % 4).cast("int")).withColumn("few", F.col("id") < 9)
    folds = F.explode(F.array(*[F.lit(i) for i in range(5)])).alias("fold")
    train = rows.select("*", folds).where("if(fold = 4, few, own <> fold)").drop("own", "few")  # one fold of few rows
    queries = rows.select("*", folds).where("fold = 4 or own = fold").select("id", "features", "fold")
    searched, count = [], knn._search
    monkeypatch.setattr(knn, "MORE_WORK", 0.0)
    want = sorted(knn.neighbours_by_norm(train, queries, 11, (1, 2, 3), ["fold"]).collect())
    monkeypatch.setattr(knn, "MORE_WORK", 9.0)
    monkeypatch.setattr(knn, "SHARED_ROWS", shard)
    monkeypatch.setattr(knn, "_search", lambda t, *a: searched.append(t.count()) or count(t, *a))
    assert sorted(knn.neighbours_by_norm(train, queries, 11, (1, 2, 3), ["fold"]).collect()) == want
    assert len(want) == 3 * (400 * 11 + 400 * 9) and set(searched) == {400}


def test_short_lists_are_searched_again():
    rng = np.random.default_rng(3)
    x, queries, ids = rng.normal(0, 1, (900, 3)), rng.normal(0, 1, (70, 3)), rng.permutation(900)
    member = np.where(x[:, 0] > 0, 1, 2) | np.where(rng.random(900) < 0.02, 4, 0)  # one half lies away from many queries, one group is small
    wanted, reach = rng.integers(0, 16, 70), np.full(70, np.inf)
    found = {}
    for g, query, row, dist in knn.nearest_of_groups(queries, knn.Rows(x, ids), 9, 2, reach, wanted, member):
        for q, r, d in zip(query, row, dist, strict=True):
            found.setdefault((g, int(q)), []).append((d, ids[r]))
    exact = knn.distances(queries, x, 2)
    want = {(g, q): sorted(zip(exact[q][at], ids[at], strict=True))[:9] for g in range(3) for at in [np.flatnonzero(member >> g & 1)] for q in range(70) if wanted[q] >> g & 1}
    assert found == want


def test_lists_are_merged_a_few_times(monkeypatch):
    """512 queries met tiles of 1,953 rows, so lists were put in order 26 times."""
    rng, merged, merge = np.random.default_rng(4), [], knn._merge
    monkeypatch.setattr(knn, "_merge", lambda *a: merged.append(1) or merge(*a))
    rows, queries = knn.Rows(rng.normal(0, 1, (50_000, 4)), np.arange(50_000)), rng.normal(0, 1, (100, 4))
    assert sum(len(d) for _, _, d in knn.nearest(queries, rows, 11, 2)) == 100 * 11 and len(merged) <= 8


def test_few_pairs_are_measured_by_the_third_norm(monkeypatch):
    """By their Euclidean distances alone one pair in twenty was measured in double precision."""
    rng, measured, paired = np.random.default_rng(5), [], knn.paired
    monkeypatch.setattr(knn, "paired", lambda queries, train, p: measured.append(len(train)) or paired(queries, train, p))
    x, queries = rng.normal(0, 1, (20_000, 64)), rng.normal(0, 1, (40, 64))
    query, near, dist = (np.concatenate(c) for c in zip(*knn.nearest(queries, knn.Rows(x, np.arange(20_000)), 5, 3), strict=True))
    exact = np.concatenate([knn.distances(queries[i : i + 1], x, 3) for i in range(40)])
    assert np.array_equal(near.reshape(40, 5), np.argsort(exact, axis=1, kind="stable")[:, :5]) and np.array_equal(dist, exact[query, near])
    assert sum(measured) < 40 * 20_000 / 200


def test_copies_of_queries_are_made_in_pieces(spark, monkeypatch):
    """A batch of queries was copied for all cells at once, so memory grew with the cells, which grow with the rows."""
    import tracemalloc

    rng, width = np.random.default_rng(6), 16
    pivots = rng.normal(0, 1, (400, width))
    known = {(): knn.Cells(pivots, np.full(400, 50_000), np.full((1, 400), 99.0))}
    queries = spark.createDataFrame([(i, f.tolist(), {2: 1.0}) for i, f in enumerate(rng.normal(0, 1, (3_000, width)))], "id long, features array<double>, _kth map<int,double>")
    batch = queries.toArrow().combine_chunks().to_batches()[0]
    monkeypatch.setattr(type(queries), "mapInArrow", lambda self, run, schema: run)
    tracemalloc.start()
    sent, most = 0, 0
    for part in knn.targets(queries, known, 5, (2,))(iter([batch])):
        sent, most = sent + part.num_rows, max(most, part.num_rows * width)
    assert sent == 3_000 * 399 and most <= knn.BLOCK_CELLS  # all cells but the home
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
