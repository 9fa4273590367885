"""Classifiers and clustering on separable and tied data, against NumPy."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetmill.jobs.compare import compare_families
from facetmill.operators import features as feat
from facetmill.operators import kmeans, knn, selection, softmax, svm
from facetmill.operators.metrics import accuracy


@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(0)
    centers = np.array([[0, 0, 8], [8, 0, 0], [0, 8, 0]])
    rows = [(i, (centers[i % 3] + rng.normal(0, 0.5, 3)).tolist(), i % 3) for i in range(120)]
    return spark.createDataFrame(rows, "id long, features array<double>, label int").persist()


def arrays(df):
    rows = df.orderBy("id").collect()
    return np.array([r.features for r in rows]), np.array([r.label for r in rows])


@pytest.mark.parametrize("p", [1, 2, 3])
def test_neighbours_equal_brute_force(spark, p):
    rng = random.Random(p)
    train = [(i, [float(rng.randrange(4)) for _ in range(3)], rng.randrange(3)) for i in range(80)]  # many ties
    queries = [(1000 + i, [float(rng.randrange(4)) for _ in range(3)], 0) for i in range(30)]
    schema = "id long, features array<double>, label int"
    got = knn.neighbours(spark.createDataFrame(train, schema), spark.createDataFrame(queries, schema), 5, p).collect()
    for q, x, _ in queries:
        want = sorted((sum(abs(a - b) ** p for a, b in zip(x, y, strict=True)), i) for i, y, _ in train)[:5]
        assert [(r.dist, r.train_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want


def test_neighbours_in_shards(spark, monkeypatch):
    schema = "id long, features array<double>, label int"
    rows = [(i, [float(i % 17), float(i % 5)], i % 4) for i in range(200)]
    data = spark.createDataFrame(rows, schema)
    whole = sorted(knn.neighbours(data, data, 3).collect())
    monkeypatch.setattr(knn, "SHARD_ROWS", 30)
    assert sorted(knn.neighbours(data, data, 3).collect()) == whole
    assert knn.neighbours(data.limit(2), data, 5).groupBy("query_id").count().agg(F.max("count")).first()[0] == 2


def test_votes(spark):
    near = spark.createDataFrame([(1, 2), (1, 2), (1, 0), (2, 3), (2, 1)], "query_id long, label int")
    assert {r.id: r.prediction for r in knn.vote(near).collect()} == {1: 2, 2: 1}


def test_scaler_and_components(separable):
    x, _ = arrays(separable)
    scaler = feat.fit_scaler(separable)
    assert np.allclose(scaler.mean, x.mean(axis=0)) and np.allclose(scaler.std, x.std(axis=0))
    pca = feat.fit_pca(separable, 2)
    values = np.linalg.svd(x - x.mean(axis=0))[1] ** 2
    assert np.allclose(pca.ratio, (values / values.sum())[:2])
    got, _ = arrays(feat.project(separable, pca))
    assert np.allclose(got, (x - x.mean(axis=0)) @ pca.components.T)
    assert (pca.components[np.arange(2), np.abs(pca.components).argmax(axis=1)] > 0).all()


def test_wide_components(spark, monkeypatch):
    """Components from blocks equal those of the whole scatter matrix, however slowly its values fall."""
    rng = np.random.default_rng(4)
    for fall in (0.99, 0.5):
        x = rng.normal(0, 1, (150, 60)) * fall ** np.arange(60)
        data = spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(x)], "id long, features array<double>, label int")
        whole = feat.fit_pca(data, 5)
        monkeypatch.setattr(feat, "WIDE", 2)
        parted = feat.fit_pca(data, 5)
        monkeypatch.undo()
        assert whole.residual.max() < 1e-9 and parted.residual.max() <= feat.PCA_TOLERANCE
        assert np.allclose(parted.ratio, whole.ratio, atol=1e-10) and np.allclose(parted.components, whole.components, atol=1e-6)


def test_leading_vectors_of_awkward_matrices():
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    for values in (np.ones(40), np.r_[5.0, 5, 5, np.zeros(37)], np.zeros(40), 0.9 ** np.arange(40)):
        matrix = (q * values) @ q.T
        found, vectors, residual = feat._leading(lambda b, m=matrix: m @ b, 40, 4, 1)
        assert np.allclose(found, values[:4], atol=1e-8) and residual.max(initial=0) < 1e-8 and np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-8)
    with pytest.raises(RuntimeError, match="passes"):
        feat._leading(lambda b: rng.normal(size=b.shape), 400, 4, 1)


def test_constant_columns(spark):
    data = spark.createDataFrame([(i, [1.0, float(i)], 0) for i in range(4)], "id long, features array<double>, label int")
    assert feat.fit_scaler(data).std[0] == 1.0
    assert feat.scaler_table(data).orderBy("pos").first()["std"] == 1.0


def test_saved_models(spark, tmp_path):
    a = np.arange(6.0).reshape(2, 3)
    feat.save_model(spark, f"file://{tmp_path}/m", a=a, b=np.array([1.0]))
    got = feat.load_model(spark, f"file://{tmp_path}/m")
    assert (got["a"] == a).all() and got["b"].shape == (1,)


def test_kmeans(spark, separable):
    model = kmeans.fit_kmeans(separable, 3)
    clusters = kmeans.assign(separable, model.centroids)
    train = clusters.select("id", "label", "cluster")
    assert [r.accuracy for r in kmeans.mapped_accuracy(train, train).collect()] == [1.0, 1.0]
    x, _ = arrays(separable)
    assert kmeans.inertia(separable, model.centroids).first().inertia == pytest.approx(kmeans.squared_distances(x, model.centroids).min(axis=1).sum())


@pytest.mark.parametrize("tasks", [1, 5])
def test_held_rounds_equal_the_jobs(spark, tasks):
    """Same centroids and rounds with far fewer distances, also with equal rows, ties and a cluster that starts empty."""
    rng = np.random.default_rng(6)
    centers = rng.normal(0, 6, (9, 4))
    x = centers[rng.integers(0, 9, 900)] + rng.normal(0, 0.6, (900, 4))
    x[:60] = x[0]
    data = spark.createDataFrame([(i, f.tolist(), 0) for i, f in enumerate(x)], "id long, features array<double>, label int").persist()
    want = kmeans.fit_kmeans(data, 9)
    got, made = kmeans.fit_kmeans_held(data, 9, tasks=tasks)
    assert got.n_iter == want.n_iter and np.allclose(got.centroids, want.centroids, rtol=0, atol=1e-9)
    assert made < 900 * 9 * want.n_iter / 2


def test_bounds_never_miss_a_nearer_centroid():
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(0, 2, (2000, 2)))  # many ties
    rows, centroids, moved = kmeans.Bounded(x), np.round(rng.normal(0, 2, (12, 2))), None
    for _ in range(15):
        rows.assign(centroids, moved)
        assert (rows.cluster == kmeans.squared_distances(x, centroids).argmin(axis=1)).all()
        step = np.where(rng.random((12, 1)) < 0.5, np.round(rng.normal(0, 1, (12, 2))), 0.0)
        centroids, moved = centroids + step, np.sqrt((step**2).sum(axis=1))


def test_empty_cluster_takes_a_spare_row(spark):
    data = spark.createDataFrame([(i, [float(i // 5)], 0) for i in range(10)], "id long, features array<double>, label int")
    new = kmeans.update(data, np.array([[0.0], [1.0], [50.0]]), [np.array([7.0])])
    assert new.ravel().tolist() == [0.0, 1.0, 7.0]


def test_surplus_clusters_have_no_label(spark):
    rows = spark.createDataFrame([(1, 0), (1, 0), (1, 5), (2, 7)], "label int, cluster int")
    mapped = kmeans.apply_label_map(rows, kmeans.label_map(rows)).collect()
    assert {(r.cluster, r.prediction) for r in mapped} == {(0, 1), (5, -1), (7, 2)}


def test_softmax_optimum_has_no_gradient(separable):
    model = softmax.fit_optimum(separable, reg=0.1)
    g = softmax.gradient(separable, model).first()
    flat = np.array(g.g) / g.n
    dw = flat[: model.weights.size].reshape(model.weights.shape) + 0.1 * model.weights
    assert np.abs(dw).max() < 1e-4 and np.abs(flat[model.weights.size :]).max() < 1e-4
    assert accuracy(softmax.predict(separable, model)).first().accuracy == 1.0


def test_softmax_descent(separable):
    model, history = softmax.fit_full_batch(separable, lr=0.05, epochs=20, validation=separable, every=10)
    assert [h[0] for h in history] == [10, 20] and history[1][1] < history[0][1] and history[1][2] > 0.9
    assert len(model.classes) == 3


def test_families_on_separable_data(separable):
    for family in (selection.SVMFamily(), selection.SoftmaxFamily([{"lr": 0.1, "reg": 1e-4, "epochs": 30, "batch": 16}]), selection.KNNFamily()):
        scores = selection.scored(family.predict(separable, separable, ()), separable, ()).collect()
        assert len(scores) == len(family.settings) and min(r.accuracy for r in scores) >= 0.95, family.name


def test_compare_families(separable):
    families = [selection.KNNFamily([{"k": 3, "p": 2}]), selection.SVMFamily([{"kernel": "linear", "c": 1.0}])]
    table, score, name, setting = compare_families(separable, families, 3, 2)
    got = table.collect()
    assert {r.model for r in got} == {"knn", "svm"} and sum(r.is_best for r in got) == 1
    assert score.first().accuracy == 1.0 and name in ("knn", "svm") and setting


def test_commonest_setting_ties_go_to_the_first_chosen(spark):
    scores = spark.createDataFrame([("m", 0, 1, "2", 0.5), ("m", 0, 2, "1", 0.7), ("n", 1, 1, "0", 0.6), ("n", 1, 2, "0", 0.6)], "model string, model_idx int, outer int, config string, accuracy double")
    got = {r.model: r for r in selection.model_table(scores).collect()}
    assert got["m"].config == "2" and got["m"].is_best and not got["n"].is_best
    assert got["m"].variance == pytest.approx(0.01)


def test_outer_folds_are_fitted_with_their_chosen_setting_only(spark, monkeypatch):
    rng = np.random.default_rng(8)
    label = rng.integers(0, 2, 120)
    data = spark.createDataFrame([(i, (rng.normal(0, 1, 3) + label[i]).tolist(), int(label[i])) for i in range(120)], "id long, features array<double>, label int").persist()
    family = selection.SVMFamily([{"kernel": "rbf", "c": 0.1}, {"kernel": "rbf", "c": 5.0}, {"kernel": "linear", "c": 1.0}])
    chosen = {r.outer: r.config for r in selection.inner_search(data, family, 3, 2).where("is_best").collect()}
    train, test = selection.fold_scenarios(selection.kfold(data, 3, out="_own"), 3, "_own", "outer")
    want = {r.outer: r.accuracy for r in selection.scored(family.predict(train, test, ["outer"]), data, ["outer"]).collect() if chosen[r.outer] == r.config}
    fits, plain = [], selection.svm.fit_pairs
    monkeypatch.setattr(selection.svm, "fit_pairs", lambda df, configs, by: fits.append((tuple(by), configs.count(), df.select("outer").distinct().count(), {r.gamma for r in configs.collect()})) or plain(df, configs, by))
    got = selection.nested_scores(data, [family], 3, 2).collect()
    assert {r.outer: r.config for r in got} == chosen and all(abs(r.accuracy - want[r.outer]) < 1e-9 for r in got)
    outer = [f for f in fits if f[0] == ("outer",)]
    assert all(n == 1 for _, n, _, _ in outer) and sum(folds for _, _, folds, _ in outer) == 3
    assert {g for *_, gs in outer for g in gs} == {selection.svm.gamma_of(train, "scale")}
