"""Clusters that stand still: the rounds of separate jobs, in one."""

import numpy as np

from facetmill.jobs.queries import QUERIES
from facetmill.operators import kmeans
from facetmill.sources.vectors import read_embeddings


def test_converged_rounds_are_one_job(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (400, 8))
    spark.createDataFrame([(i, f.tolist(), i % 3) for i, f in enumerate(x)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    df = read_embeddings(spark, str(tmp_path))
    want = kmeans.fit_kmeans(df, 28, max_iter=300)
    spark.sparkContext.setJobGroup("converged", "")
    got = QUERIES["kmeans_converged"](spark, str(tmp_path)).first()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("converged")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got.n_iter == want.n_iter > 5 and got.inertia == round(kmeans.inertia(df, want.centroids).first().inertia, 6)
    assert len(jobs) < 15
