"""The inverted file of vectors: recall against exact search, what it reads, and when it is made anew."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrivia.operators import index as I
from scrivia.operators import vector_index as V


def recall(queries, vectors, index, k=10, **how):
    exact = {(r.query_id, r.vec_id) for r in I.dense_top(queries, vectors, k).collect()}
    return len(exact & {(r.query_id, r.vec_id) for r in V.ivf_top(queries, index, k, **how).collect()}) / len(exact)


def table_of(spark, rows, kind="long"):
    return spark.createDataFrame([(i if kind == "long" else f"v{i}", r.tolist()) for i, r in enumerate(rows)], f"vec_id {kind}, vector array<double>")


def test_unclustered_vectors(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    index = V.vector_index(v)
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    assert recall(q, v, index) >= 0.9
    assert 10 * V.READ < 0.2 * v.count()  # whole vectors that a question reads
    assert sum(index.sizes.values()) == v.count()


@pytest.mark.parametrize("kind", ["long", "string"])
def test_clustered_vectors_take_few_lists(spark, kind):
    rng = np.random.default_rng(1)
    rows = np.repeat(rng.normal(size=(40, 24)), 50, axis=0) + 0.15 * rng.normal(size=(2000, 24))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    v = table_of(spark, rows, kind)
    index = V.vector_index(v)
    q = v.limit(30).select(F.col("vec_id").alias("query_id"), "vector")
    assert index.share < 0.2 and recall(q, v, index) >= 0.9
    looked = V.probes(index, rows[:30], index.share)
    assert all(sum(index.sizes[i] for i in own if i >= 0) < 0.2 * 2000 for own in looked.tolist())
    plan = V.ivf_top(q.limit(1), index, 5)._jdf.queryExecution().executedPlan().toString()
    assert "list" in plan and "PartitionFilters" in plan


def test_a_search_leaves_the_index_and_a_change_makes_another(spark):
    rows = np.eye(32)
    v = table_of(spark, rows)
    first = V.index_of_version(spark, "test", v)
    files = sorted(f for _, _, fs in os.walk(first.path) for f in fs)
    found = V.ivf_top(v.limit(3).select(F.col("vec_id").alias("query_id"), "vector"), first, 1).collect()
    assert sorted((r.query_id, r.vec_id, r.score) for r in found) == [(0, 0, 1.0), (1, 1, 1.0), (2, 2, 1.0)]
    assert V.index_of_version(spark, "test", v) is first and sorted(f for _, _, fs in os.walk(first.path) for f in fs) == files
    assert V.index_of_version(spark, "test", table_of(spark, rows[::-1])).path != first.path  # as many rows


def test_odd_vectors(spark, monkeypatch):
    rows = [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(300)] + [(None, [0.0, 1.0, 0.0, 0.0]), (7, None), (1000, [0.0, 0.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    index = V.vector_index(v)
    q = spark.createDataFrame([(i, [1.0, 0.0, 0.0, 0.0]) for i in range(5)] + [(9, None)], "query_id long, vector array<double>")
    monkeypatch.setattr(V, "MAX_BROADCAST_QUERIES", 2)  # in blocks
    got = V.ivf_top(q, index, 4, 1.0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(i, j) for i in range(5) for j in range(4)]
    empty = v.where("false")
    assert V.ivf_top(q, V.vector_index(empty), 4).count() == 0 and V.ivf_top(q.where("false"), index, 4).count() == 0


def test_a_task_hands_on_few_candidates(spark, monkeypatch):
    """A question looks into 200 lists; a task that reads many of them hands on what is among the best of all it has seen."""
    rows = np.random.default_rng(2).normal(size=(3000, 16))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    index = V.vector_index(table_of(spark, rows), 200)
    near, top = [], V.top
    monkeypatch.setattr(V, "top", lambda df, *a, **how: near.append(df) or top(df, *a, **how))
    queries = table_of(spark, rows[:10]).withColumnRenamed("vec_id", "query_id")
    assert V.ivf_top(queries, index, 2, share=1.0, read=2).count() == 20
    assert near[0].count() < 2500  # 10 questions, 200 lists, 4 of each list: 8,000
