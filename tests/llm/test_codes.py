"""Vector codes against Lloyd rounds over all pairs in whole numbers."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from facetmill.llm.codes import Codebook, compress_vectors


def brute(rows, parts=4, entries=256, rounds=4):
    good = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not good:
        return []
    w = len(good[0][1]) // parts
    good = [g for g in good if len(g[1]) == len(good[0][1])]
    if len(good[0][1]) % parts:
        return []
    books = [[g[1][p * w : (p + 1) * w] for g in good[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for _, v, _ in good:
                held[nearest(v[p * w : (p + 1) * w], books[p])[1]].append(v[p * w : (p + 1) * w])
            books[p] = [[sum(c) // len(held[i]) for c in zip(*held[i], strict=True)] if i in held and w else e for i, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by_label = [], defaultdict(int)
    for i, v, lab in good:
        found = [nearest(v[p * w : (p + 1) * w], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), lab))
        by_label[lab] += out[-1][2]
    return [(i, c, e, by_label[lab], digest) for i, c, e, lab in out]


SCHEMA = "vec_id long, embedding array<double>, label int, code string, n int, part int"
BEYOND_NULL = lambda r: (r[0] is None, r[0] or 0, *r[1:])


def run(spark, rows, **kw):
    data = spark.createDataFrame([(i, v, lab, "x", 1, 2) for i, v, lab in rows], SCHEMA)
    got = compress_vectors(data, **kw).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    return sorted(map(tuple, got.collect()), key=BEYOND_NULL)


@pytest.mark.parametrize("entries", [3, 16, 256])
def test_equals_brute_force(spark, entries):
    rng = random.Random(entries)
    centers = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i * 3, [c + rng.gauss(0, 0.05) for c in rng.choice(centers)], rng.choice([0, 1, 1, 1, None])) for i in range(400)]
    rows += [(5000 + i, [0.25, -0.5] * 4, 1) for i in range(200)]  # one very common vector
    rows += [(7, [0.5] * 8, 2)] * 3 + [(None, [0.125] * 8, 4), (8, None, 0), (10, [None] * 8, 0), (11, [math.nan] * 8, 0), (13, [math.inf] + [0.0] * 7, 0), (14, [1.0] * 4, 0), (16, [-0.0001] * 8, None)]
    assert run(spark, rows, entries=entries) == sorted(brute(rows, entries=entries), key=BEYOND_NULL)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [0.5] * 4, None)], [(1, [0.5] * 3, 1)], [(1, [], 1), (2, [], None)], [(3, [1e5] * 8, 1), (4, [-1e5] * 8, 1)]])
def test_odd_tables(spark, rows):
    assert run(spark, rows) == sorted(brute(rows), key=BEYOND_NULL)


def test_too_large_numbers_are_an_error(spark):
    with pytest.raises(Exception, match="63 bits"):
        run(spark, [(1, [1e12] * 8, 1), (2, [-1e12] * 8, 1)])


def test_search_is_exact_from_any_start_and_prunes():
    rng = np.random.default_rng(2)
    centers = rng.integers(-2000, 2000, (256, 16))
    centers[17] = centers[3]  # equal entries: the lower index wins
    x = centers[rng.integers(0, 256, 3000)] + rng.integers(-40, 41, (3000, 16))
    all_pairs = ((x[:, None, :] - centers[None]) ** 2).sum(axis=2)
    book = Codebook(centers)
    near = all_pairs.argmin(axis=1)
    for start in (np.zeros(3000, dtype=int), rng.integers(0, 256, 3000), near):
        entry, distance, made = book.search(x, start)
        assert (entry == near).all() and (distance == all_pairs.min(axis=1)).all()
    assert made < 3000 * 256 / 4  # from the right start few others are looked at
