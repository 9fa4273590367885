"""Exact top-k against brute force in whole numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetmill.llm.topk import BallTree, exact_top_k, search


def brute(rows, k):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), c) for c, b in good if c != q and len(a) == len(b))[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [100, 100_000])
def test_equals_brute_force(spark, shard_rows):
    rng = random.Random(shard_rows)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(700)]
    rows += [(1000 + i, [0.5] * 8) for i in range(300)]  # one very common vector
    rows += [(5000, None), (5050, [None] * 8), (5100, [float("nan")] * 8), (5150, [float("inf")] + [0.0] * 7), (5200, []), (None, [1.0] * 8), (5250, [1e9] * 8), (5300, [-0.001] * 8), (5350, [1.0] * 3), (5351, [2.0] * 3)]
    data = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, score int, shard string")
    got = exact_top_k(data, F.col("vec_id") % 50 == 0, k=5, shard_rows=shard_rows, block_rows=7)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5)


def test_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(50, [1.0])], [(50, [1.0]), (51, [2.0])], [(1, [1.0])]):
        got = exact_top_k(spark.createDataFrame(rows, schema), F.col("vec_id") % 50 == 0)
        assert sorted(map(tuple, got.collect())) == brute(rows, 5)


def test_nodes_are_skipped():
    rng = np.random.default_rng(1)
    centers = rng.normal(0, 4000, (40, 16))
    vectors = (centers[rng.integers(0, 40, 8000)] + rng.normal(0, 30, (8000, 16))).astype(np.int64)
    tree = BallTree(np.arange(8000), vectors, leaf=64)
    opened, real = [], tree.members
    tree.members = type("Counting", (list,), {"__getitem__": lambda self, i: opened.append(i) or list.__getitem__(self, i)})(real)
    found = search(tree, np.full(1, -1), vectors[:1], np.full(1, -(1 << 63)), 5)
    leaves = sum(not c for c in tree.children)
    scores = np.sort(vectors @ vectors[0])[::-1][:5]
    assert [-s for s, _ in found.best[0]] == scores.tolist()
    assert len(opened) < leaves / 3
