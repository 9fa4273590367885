"""The auction against the Hungarian method and against all permutations."""

import itertools

import numpy as np
import pytest

from facetmill.operators.assignment import Bidders, best_map, higher
from facetmill.operators.kmeans import label_map


def best_assignment(counts: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) pairs, each used once, with the largest total count: the Hungarian method on a small table."""
    n = max(counts.shape)
    cost = np.zeros((n + 1, n + 1))
    cost[1 : counts.shape[0] + 1, 1 : counts.shape[1] + 1] = -counts
    u, v, row_of, way = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, dtype=int), np.zeros(n + 1, dtype=int)
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        least, done = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=bool)
        while True:
            done[j] = True
            slack = cost[row_of[j]] - u[row_of[j]] - v
            open_ = ~done
            open_[0] = False
            closer = open_ & (slack < least)
            least[closer], way[closer] = slack[closer], j
            step_to = int(np.flatnonzero(open_)[least[open_].argmin()])
            delta = least[step_to]
            u[row_of[done]] += delta
            v[done] -= delta
            least[open_] -= delta
            j = step_to
            if row_of[j] == 0:
                break
        while j:
            row_of[j] = row_of[way[j]]
            j = way[j]
    return [(int(row_of[j]) - 1, j - 1) for j in range(1, n + 1) if row_of[j] <= counts.shape[0] and j <= counts.shape[1]]


def cells(counts):
    return [(int(i), int(j) * 10, int(counts[i, j])) for i, j in zip(*np.nonzero(counts), strict=True)]


def matched(spark, counts, tasks=0):
    found = best_map(spark.createDataFrame(cells(counts), "cluster int, label int, n long").repartition(3), "cluster", "label", tasks=tasks).collect()
    used = [(r.cluster, r.label // 10) for r in found]
    assert len({i for i, _ in used}) == len(used) == len({j for _, j in used})
    return sorted(used), sum(int(counts[i, j]) for i, j in used)


def test_hungarian_method_is_right():
    rng = np.random.default_rng(2)
    for rows, cols in itertools.product((1, 2, 4, 5), repeat=2):
        counts = rng.integers(0, 20, (rows, cols)).astype(float)
        pairs = best_assignment(counts)
        small = min(rows, cols)
        best = max(sum(counts[i, j] for i, j in zip(r, c, strict=True)) for r in itertools.permutations(range(rows), small) for c in itertools.combinations(range(cols), small))
        assert len(pairs) == small and sum(counts[i, j] for i, j in pairs) == best


@pytest.mark.parametrize(("rows", "cols", "share", "most"), [(1, 1, 1, 3), (5, 5, 1, 4), (30, 12, 0.3, 50), (12, 30, 0.3, 2), (120, 150, 0.05, 10**9), (60, 60, 1, 10)])
def test_total_is_that_of_the_hungarian_method(spark, rows, cols, share, most):
    rng = np.random.default_rng(rows * cols)
    counts = rng.integers(1, most + 1, (rows, cols)) * (rng.random((rows, cols)) < share)
    counts[0, 0] = max(1, counts[0, 0])
    pairs, total = matched(spark, counts)
    assert total == sum(counts[i, j] for i, j in best_assignment(counts.astype(float)))
    assert len(pairs) == min((counts.sum(axis=1) > 0).sum(), (counts.sum(axis=0) > 0).sum())


def test_map_does_not_depend_on_tasks(spark):
    rng = np.random.default_rng(8)
    counts = rng.integers(0, 4, (40, 40))  # many ties
    assert len({tuple(matched(spark, counts, tasks)[0]) for tasks in (1, 3, 8)}) == 1


def test_one_label_holds_most_rows(spark):
    counts = np.zeros((200, 40), dtype=int)
    counts[:, 0] = 10**6 + np.arange(200)
    counts[np.arange(200), np.arange(200) % 40] += 7
    pairs, total = matched(spark, counts)
    assert len(pairs) == 40 and total == sum(counts[i, j] for i, j in best_assignment(counts.astype(float)))


def test_nulls_and_no_rows(spark):
    rows = spark.createDataFrame([(1, None), (None, 2), (3, 4), (3, 4), (None, None)], "label int, cluster int")
    assert [tuple(r) for r in label_map(rows).collect()] == [(4, 3)]
    assert label_map(rows.limit(0)).collect() == [] and label_map(rows.limit(0)).columns == ["cluster", "mapped"]


def test_bids_of_two_tasks_are_those_of_one():
    rng = np.random.default_rng(4)
    who, what = np.repeat(np.arange(30), 6), np.concatenate([rng.choice(20, 6, replace=False) for _ in range(30)])
    worth, prices = rng.integers(0, 5, 180), rng.integers(0, 3, 20)
    parts = []
    for part in (who >= 0, who % 3 == 0, who % 3 > 0):
        b = Bidders(who[part], what[part], worth[part])
        parts.append(b.bids(b.who % 2 == 0, prices, 1))
    assert (higher(parts[1], parts[2]) == parts[0]).all() and (higher(parts[2], parts[1]) == parts[0]).all()
