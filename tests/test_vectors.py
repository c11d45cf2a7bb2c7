"""The inverted file against comparing everything with everything."""

import re

import numpy as np

from factloom.operators import retrieval, vector_index


def test_recall_on_the_tables(spark, sf):
    """With the probes that the index measured, at least 0.95 of the true five neighbours are found, from fewer than all cells."""
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    index = vector_index.VectorIndex(vectors, "vec_id", "embedding", recall=0.97)
    assert index.rows.count() == vectors.count() and index.rows.select("id").distinct().count() == vectors.count()
    asked = vectors.where("vec_id % 7 = 0")
    pairs = lambda d: {(r["query_id"], r["vec_id"]) for r in d.collect()}
    true = pairs(retrieval.nearest_of_each(vectors, asked, 5, "vec_id", "embedding"))
    found = pairs(index.nearest(asked, "embedding", 5))
    assert len(true & found) >= 0.95 * len(true)
    assert pairs(index.nearest(asked, "embedding", 5, index.cells)) == true


def test_cells_that_are_not_asked_are_not_read(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16)) * 5
    data = [(i, (centres[i % 12] + rng.normal(size=16) * 0.2).tolist()) for i in range(600)] + [(900, None), (901, [0.0] * 16)]
    vectors = spark.createDataFrame(data, "id long, v array<double>").repartition(3)
    index = vector_index.VectorIndex(vectors, "id", "v", cells=12)
    assert index.probes <= 2 and index.rows.count() == 601
    one = index.nearest(vectors.where("id = 5"), "v", 4, 1)
    assert re.search(r"PartitionFilters: \[[^\]]*cell#\d+ (=|IN)", one._jdf.queryExecution().executedPlan().toString())
    assert {r["id"] % 12 for r in one.collect()} == {5} and one.count() == 4


def test_nothing(spark):
    none = spark.createDataFrame([], "id long, v array<double>")
    index = vector_index.VectorIndex(none, "id", "v")
    assert index.nearest(none, "v", 3).count() == 0
    some = spark.createDataFrame([(1, [1.0, 2.0])], "id long, v array<double>")
    assert index.nearest(some, "v", 3).count() == 0 and [tuple(r)[:3] for r in vector_index.VectorIndex(some, "id", "v").nearest(some, "v", 3).collect()] == [(1, 1, 1)]
