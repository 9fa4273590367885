"""Splits, folds and metrics on small tables."""

import hashlib
from collections import Counter

import pytest

from facetmill.functions.ordering import seeded_rank
from facetmill.operators.metrics import adjusted_rand_index, class_report, contingency, leaderboard, normalised_mutual_information
from facetmill.operators.splits import fold_parts, kfold, nested_folds, stratified_holdout


def key(seed, i):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


def rows(spark, n, labels=3):
    return spark.createDataFrame([(i, i % labels if i % 7 else 0) for i in range(n)], "id long, label int")


def test_rank_is_the_order_of_the_hash(spark):
    got = {r.id: r["rank"] for r in seeded_rank(rows(spark, 500), 42).collect()}
    assert got == {i: n + 1 for n, i in enumerate(sorted(range(500), key=lambda i: key(42, i)))}
    inside = seeded_rank(rows(spark, 500), 7, ["label"]).collect()
    for label in (0, 1, 2):
        members = sorted((r for r in inside if r.label == label), key=lambda r: key(7, r.id))
        assert [r["rank"] for r in members] == list(range(1, len(members) + 1))


@pytest.mark.parametrize("n", [1, 4, 5, 23, 200])
def test_holdout_sizes(spark, n):
    got = stratified_holdout(rows(spark, n)).collect()
    assert len(got) == n and sum(r.is_test for r in got) == -(-n // 5)
    total, held = Counter(r.label for r in got), Counter(r.label for r in got if r.is_test)
    assert all(held[c] in (total[c] // 5, total[c] // 5 + 1) for c in total)


@pytest.mark.parametrize("n", [3, 5, 17, 100])
def test_fold_sizes(spark, n):
    folds = kfold(rows(spark, n), 5)
    sizes = Counter(r.fold for r in folds.collect())
    assert [sizes[f] for f in range(1, 6)] == [n // 5 + (f <= n % 5) for f in range(1, 6)]
    train, test = fold_parts(folds, 1)
    assert train.count() + test.count() == n and test.count() == sizes[1]


def test_nested_folds_leave_the_outer_fold_out(spark):
    outer = {r.id: r.fold for r in kfold(rows(spark, 60), 5).collect()}
    seen = Counter()
    for r in nested_folds(rows(spark, 60), 5, 3).collect():
        assert r.outer != outer[r.id] and 1 <= r.inner <= 3
        seen[r.id] += 1
    assert set(seen.values()) == {4}


def test_report_by_hand(spark):
    data = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1), (1, 9), (2, 0)], "label int, prediction int")
    got = {r["class"]: r for r in class_report(data).collect()}
    assert set(got) == {"0", "1", "2", "macro"}
    assert (got["0"].precision, got["0"].recall, got["0"].support) == (pytest.approx(2 / 3), pytest.approx(2 / 3), 3)
    assert (got["2"].precision, got["2"].recall, got["2"].f1) == (0, 0, 0)
    assert got["macro"].recall == pytest.approx((2 / 3 + 1 / 2 + 0) / 3)
    both = {r["class"]: r for r in class_report(data, union=True).collect()}
    assert set(both) == {"0", "1", "2", "9", "macro", "weighted", "accuracy"}
    assert both["9"].support == 0 and both["accuracy"].f1 == pytest.approx(0.5)
    assert both["weighted"].recall == pytest.approx(0.5)


def test_leaderboard_ties_keep_the_order(spark):
    got = leaderboard(spark.createDataFrame([(0, 0.5), (1, 0.9), (2, 0.9)], "config int, accuracy double")).collect()
    assert {r.config: (r["rank"], r.is_best) for r in got} == {1: (1, True), 2: (2, False), 0: (3, False)}


@pytest.mark.parametrize(("pairs", "ari", "nmi"), [([(0, 5), (0, 5), (1, 7), (1, 7)], 1.0, 1.0), ([(0, 1)], 1.0, 1.0), ([(0, 1), (0, 2), (1, 1), (1, 2)], -0.5, 0.0), ([(0, 1), (1, 1)], 0.0, 0.0)])
def test_agreement(spark, pairs, ari, nmi):
    table = contingency(spark.createDataFrame(pairs, "label int, cluster int"))
    assert adjusted_rand_index(table).first().ari == pytest.approx(ari)
    assert normalised_mutual_information(table).first().nmi == pytest.approx(nmi, abs=1e-12)
