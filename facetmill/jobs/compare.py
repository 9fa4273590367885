"""Model comparison: holdout, nested cross-validation, the best model refitted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.metrics import accuracy
from ..operators.selection import Family, model_table, nested_scores, refit_best
from ..operators.splits import SEED, stratified_holdout


def compare_families(df: DataFrame, families: Sequence[Family], k_outer: int = 5, k_inner: int = 3, seed: int = SEED, keep: str | None = None) -> tuple[DataFrame, DataFrame, str, dict]:
    """The table of models, the holdout accuracy of the best one, its name and setting; the best model is saved at ``keep``, if that is given."""
    parts = stratified_holdout(df, seed=seed).persist()
    try:
        train, test = parts.where("not is_test").drop("is_test"), parts.where("is_test").drop("is_test")
        table = model_table(nested_scores(train, families, k_outer, k_inner, seed)).persist()
        name, setting, predicted = refit_best(train, test, table, families, keep)
        return table, accuracy(predicted.join(test.select("id", "label"), "id")), name, setting
    finally:
        parts.unpersist()
