"""Families of models and MLlib's estimators, each usable where the other is.

``FamilyClassifier`` makes an estimator of a family: its fit is kept as a table,
goes into pipelines, and is saved and loaded like MLlib's own models.
``EstimatorFamily`` makes a family of an MLlib classifier, so that it goes into
(nested) cross-validation. Rows are (id, features array<double>, label int).
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import written


class _FamilyParams(Params):
    family = Param(Params._dummy(), "family", "knn, softmax or svm", TypeConverters.toString)
    setting = Param(Params._dummy(), "setting", "the hyper-parameters as JSON", TypeConverters.toString)

    def chosen(self):
        """The family with the one setting."""
        from .selection import FAMILIES

        return FAMILIES[self.getOrDefault(self.family)]([json.loads(self.getOrDefault(self.setting))])


class FamilyClassifier(Estimator, _FamilyParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, family: str | None = None, setting: str | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> FamilyModel:
        return self._copyValues(FamilyModel(written(self.chosen().fit(dataset.select("id", "features", "label")), "model")))


class FamilyModel(Model, _FamilyParams, MLReadable, MLWritable):
    """The table that a family's fit gives; transform adds prediction, joined by id (null if the family gives a row none)."""

    def __init__(self, table: DataFrame | None = None):
        super().__init__()
        self.table = table

    def _transform(self, dataset: DataFrame) -> DataFrame:
        found = self.chosen().apply(self.table, dataset.select("id", "features"))
        return dataset.join(found.select("id", "prediction"), "id", "left").select(*dataset.columns, "prediction")

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader()


class _TableWriter(MLWriter):
    def __init__(self, instance: FamilyModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        self.instance.table.write.parquet(f"{path}/table")
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)


class _TableReader(MLReader):
    def load(self, path: str) -> FamilyModel:
        model = FamilyModel(self.sparkSession.read.parquet(f"{path}/table"))
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class LabelledModel(Model, MLReadable, MLWritable):
    """An MLlib classifier's model with the labels that its indices stand for."""

    def __init__(self, model: Model | None = None, labels: Sequence[int] = ()):
        super().__init__()
        self.model, self.labels = model, list(labels)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        found = self.model.transform(dataset.withColumn("_features", array_to_vector("features")))
        label = F.element_at(F.array(*map(F.lit, self.labels)), F.col("_prediction").cast("int") + 1)
        return found.select(*dataset.columns, label.alias("prediction"))

    def write(self) -> MLWriter:
        return _LabelledWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _LabelledReader()


class _LabelledWriter(MLWriter):
    def __init__(self, instance: LabelledModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        self.instance.model.save(f"{path}/model")
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"labels": self.instance.labels})


class _LabelledReader(MLReader):
    def load(self, path: str) -> LabelledModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = LabelledModel(DefaultParamsReader.loadParamsInstance(f"{path}/model", self.sparkSession), metadata["labels"])
        model._resetUid(metadata["uid"])
        return model


class EstimatorFamily:
    """An MLlib classifier with settings of its parameters, as a family.

    MLlib fits one model a job, so groups (folds, which are few) and settings
    are fitted side by side by ``parallelism`` threads of the driver; rows stay
    where they are. A group without labelled rows gives no predictions.
    """

    def __init__(self, estimator: Estimator, settings: Sequence[dict] = ({},), parallelism: int = 4, name: str | None = None):
        self.estimator, self.settings, self.parallelism = estimator, list(settings), parallelism
        self.name = name or type(estimator).__name__

    def fit_model(self, train: DataFrame, setting: dict | None = None) -> LabelledModel:
        rows = train.where("label is not null")
        labels = [r.label for r in rows.select("label").distinct().orderBy("label").collect()]  # of the model's size
        if not labels:
            raise ValueError("no labelled rows to fit on")
        index = F.array_position(F.array(*map(F.lit, labels)), F.col("label")) - 1
        ready = rows.select(array_to_vector("features").alias("_features"), index.cast("double").alias("_label"))
        columns = {"featuresCol": "_features", "labelCol": "_label", "predictionCol": "_prediction"}
        values = {self.estimator.getParam(k): v for k, v in {**(self.settings[0] if setting is None else setting), **columns}.items()}
        return LabelledModel(self.estimator.copy(values).fit(ready), labels)

    def predict(self, train: DataFrame, test: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        groups = [tuple(r) for r in train.where("label is not null").select(*by).distinct().collect()] if by else [()]
        of = lambda df, group: reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), zip(by, group, strict=True), df)

        def one(job: tuple[tuple, int]) -> DataFrame:
            group, i = job
            found = self.fit_model(of(train, group), self.settings[i]).transform(of(test, group).select(*by, "id", "features"))
            return found.select(*by, F.lit(str(i)).alias("config"), "id", "prediction")

        with ThreadPoolExecutor(self.parallelism) as pool:
            found = list(pool.map(one, [(g, i) for g in groups for i in range(len(self.settings))]))
        empty = test.limit(0).select(*by, F.lit("0").alias("config"), "id", F.lit(0).alias("prediction"))
        return reduce(DataFrame.unionByName, found) if found else empty


def load_model(spark: SparkSession, path: str) -> FamilyModel | LabelledModel:
    """A model of either kind from where it was saved."""
    return DefaultParamsReader.loadParamsInstance(path, spark)
