"""Approximate dense search."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivia.operators.index import MAX_BROADCAST_QUERIES, PRODUCTS, handed_on, top
from scrivia.operators.lineage import written

#: Projections, tables and width of a bucket of the hash; wider buckets find more.
TABLES, WIDTH, MAX_DISTANCE = 12, 1.2, 1.45


def lsh_top(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score, rank among the vectors that share a bucket with the query, by random projections of
    unit vectors: Euclidean order is cosine order there. Queries go to scans of the vectors in blocks of
    MAX_BROADCAST_QUERIES or so; a task compares buckets, and of what shares one it hands on what can be among the k best."""
    lsh = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", numHashTables=TABLES, bucketLength=WIDTH, seed=5)
    v = vectors.where("vector IS NOT NULL").select("vec_id", "vector", array_to_vector("vector").alias("v"))
    q = queries.where("vector IS NOT NULL").select("query_id", "vector", array_to_vector("vector").alias("v"))
    model = lsh.fit(v)
    buckets = F.array(*[F.element_at(vector_to_array(F.col("h")[i]), 1) for i in range(TABLES)]).alias("buckets")
    hashed = lambda d, name: model.transform(d).select(name, F.col("vector").cast("array<double>").alias("vector"), buckets)
    asked, rows = written(hashed(q, "query_id"), "lsh-queries"), hashed(v, "vec_id")
    n, parts = max(1, -(-asked.count() // MAX_BROADCAST_QUERIES)), []
    for i in range(n):
        parts.append(_lsh_pass(asked if n == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i), rows, k))
        if n > 1:
            parts[-1] = written(parts[-1], "lsh-pairs")
    scored = reduce(DataFrame.unionByName, parts).select("query_id", "vec_id", F.round("_score", 6).alias("score"))
    return top(scored, ["query_id"], k, F.desc("score"), "vec_id")


def _lsh_pass(asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, _score of what can be among the k best of each query of a block and shares a bucket with it."""
    own = asked.toArrow()  # MAX_BROADCAST_QUERIES or so
    matrix = lambda column, n: column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    ids = own["query_id"].combine_chunks()
    shared = asked.sparkSession.sparkContext.broadcast((ids, *(matrix(own[c].combine_chunks(), len(ids)) if len(ids) else None for c in ("vector", "buckets"))))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, buckets = shared.value
        if not len(ids):
            return
        known, step = np.full((len(ids), k), -np.inf), max(k, PRODUCTS // len(ids))
        squares = (vectors * vectors).sum(1)[:, None]
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                found, cells = (matrix(batch.column(c), batch.num_rows) for c in (1, 2))
                score = vectors @ found.T
                met = np.zeros(score.shape, bool)
                for mine, theirs in zip(buckets.T, cells.T):
                    met |= mine[:, None] == theirs
                met &= squares + (found * found).sum(1) - 2 * score < MAX_DISTANCE**2
                known, at, which = handed_on(np.where(met, score, -np.inf), known, batch.column(0), k)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), batch.column(0).take(pa.array(which)), pa.array(score[at, which])], ["query_id", "vec_id", "_score"])

    kinds = [d.schema[c].dataType.simpleString() for d, c in ((asked, "query_id"), (rows, "vec_id"))]
    return rows.mapInArrow(near, f"query_id {kinds[0]}, vec_id {kinds[1]}, _score double")
