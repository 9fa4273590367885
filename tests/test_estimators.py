"""Families as estimators and estimators as families: fitted, saved, loaded, compared."""

import json

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import NaiveBayes, RandomForestClassifier

from facetmill.jobs.compare import compare_families
from facetmill.operators import selection
from facetmill.operators.estimators import EstimatorFamily, FamilyClassifier, load_model

SETTINGS = {"knn": '{"k": 3, "p": 1}', "softmax": '{"lr": 0.1, "reg": 0.0001, "epochs": 30, "batch": 16}', "svm": '{"kernel": "rbf", "c": 5.0}'}


@pytest.fixture(scope="module")
def rings(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(150):
        at, far = rng.uniform(0, 2 * np.pi), (0.5, 2, 3.5)[i % 3] + rng.normal(0, 0.1)
        rows.append((i, [float(v) for v in (far * np.cos(at), far * np.sin(at), rng.normal())], (4, 9, 17)[i % 3]))
    return spark.createDataFrame(rows, "id long, features array<double>, label int").persist()


def found(df):
    return {r.id: r.prediction for r in df.collect()}


@pytest.mark.parametrize("name", ["knn", "softmax", "svm"])
def test_saved_family_predicts_the_same(spark, rings, tmp_path, name):
    train, test = rings.where("id % 5 > 0"), rings.where("id % 5 = 0")
    estimator = FamilyClassifier(family=name, setting=SETTINGS[name])
    estimator.save(f"file://{tmp_path}/estimator")
    model = FamilyClassifier.load(f"file://{tmp_path}/estimator").fit(train)
    got = model.transform(test)
    assert got.columns == [*test.columns, "prediction"]
    direct = {r.id: r.prediction for r in selection.FAMILIES[name]([json.loads(SETTINGS[name])]).predict(train, test, ()).collect()}
    model.save(f"file://{tmp_path}/model")
    assert found(got) == direct == found(load_model(spark, f"file://{tmp_path}/model").transform(test)) and len(direct) == 30


def test_in_a_pipeline(spark, rings, tmp_path):
    model = Pipeline(stages=[FamilyClassifier(family="knn", setting=SETTINGS["knn"])]).fit(rings)
    model.save(f"file://{tmp_path}/p")
    assert found(PipelineModel.load(f"file://{tmp_path}/p").transform(rings)) == found(model.transform(rings))


def test_forest_among_families(spark, rings, tmp_path):
    forest = EstimatorFamily(RandomForestClassifier(seed=3), [{"numTrees": 5, "maxDepth": 2}, {"numTrees": 20, "maxDepth": 6}], name="forest")
    families = [selection.SVMFamily([{"kernel": "linear", "c": 1.0}]), forest]
    table, score, name, setting = compare_families(rings, families, 3, 2, keep=f"file://{tmp_path}/best")
    rows = {r.model: r for r in table.collect()}
    assert name == "forest" and setting["numTrees"] == 20 and rows["forest"].is_best and rows["forest"].mean > rows["svm"].mean + 0.2
    assert score.first().accuracy > 0.8
    again = load_model(spark, f"file://{tmp_path}/best")
    assert again.labels == [4, 9, 17] and sum(r.label == r.prediction for r in again.transform(rings).collect()) > 120


def test_group_that_lacks_a_label(spark, rings):
    """Indices are made for each group, so a fold without one of the labels still gives true labels."""
    train = rings.selectExpr("*", "cast(id % 2 as int) as fold").where("not (fold = 1 and label = 4)")
    got = EstimatorFamily(NaiveBayes(modelType="gaussian")).predict(train, rings.selectExpr("id", "features", "cast(id % 2 as int) as fold"), ["fold"]).collect()
    assert len(got) == 150 and {r.prediction for r in got if r.fold == 1} <= {9, 17} and {r.prediction for r in got if r.fold == 0} == {4, 9, 17}
    with pytest.raises(ValueError, match="no labelled rows"):
        EstimatorFamily(NaiveBayes(modelType="gaussian")).fit_model(train.limit(0))
