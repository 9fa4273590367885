"""Registered queries against their SQL, on the smallest tables."""

import decimal

import duckdb
import pytest

import __spark_entry__
from facetmill.jobs.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
NAMES = ["stratified_split", "kfold_assign", "nested_fold_assign", "scaler_fit", "natural_sort_labels", "gray_bar_crop", "hog_features", "knn_predict_p2", "class_report_union", "kmeans_fit", "adjusted_rand", "mutual_information", "softmax_gd_step", "model_table", "submission_line", "shape_counts", "svm_votes", "knn_sweep", "knn_nested_cv", "best_of_families", "label_map_matched", "kmeans_held_fit", "image_source", "estimator_cross_validation"]


def plain(rows):
    return sorted(repr(tuple(float(v) if isinstance(v, decimal.Decimal) else v + 0.0 if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("embeddings", "labels", "documents"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SF)
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    at = [want.columns.index(c) for c in order]
    assert plain(tuple(r[c] for c in order) for r in got.collect()) == plain(tuple(r[i] for i in at) for r in want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(QUERIES) <= set(__spark_entry__.queries())
