"""Exact top-k search by inner product, with bounds from segment statistics.

A vector is cut into 1, 4 and 16 segments; a segment of n components with means a, b and deviations s, t adds at
most n * (a * b + s * t) to an inner product (equally, at least n * ((a - b)^2 + (s - t)^2) to a squared distance).
Every query comes with a threshold, its k-th best product within a bounded sample of the candidates, which no answer can
be below. Queries and candidates meet block by block: bounds run from coarse to fine over the candidates that are left
for any query of the block, and exact products are computed for the pairs that reach the threshold at every level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivia.llm.common import stash, table

SEGMENTS = (1, 4, 16)
TOP_K = 20
CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 512
#: Candidates that set the thresholds (512 bytes each at 64 components), those of the smallest checksums. The sample
#: bounds a broadcast and changes the cost alone.
SAMPLE = 4096
#: Pairs whose exact products are computed together.
TOGETHER = 100_000


def segment_statistics(vectors: np.ndarray, n_segments: int) -> np.ndarray:
    """Rows whose inner products bound those of `vectors` from above: scaled means, then scaled deviations."""
    dim = vectors.shape[1]
    edges = np.unique(np.linspace(0, dim, min(n_segments, max(dim, 1)) + 1).astype(int))
    parts = []
    for a, b in zip(edges[:-1], edges[1:]):
        own = vectors[:, a:b]
        parts.append((np.sqrt(b - a) * own.mean(axis=1), np.sqrt(b - a) * own.std(axis=1)))
    if not parts:
        return np.zeros((len(vectors), 1))
    return np.stack([p[0] for p in parts] + [p[1] for p in parts], axis=1)


def least_scores(query_ids, queries, ids, vectors, k: int) -> np.ndarray:
    """Of each query its k-th largest product among these candidates, its own id left out; -inf if they are fewer."""
    if len(ids) <= k:
        return np.full(len(query_ids), -np.inf)
    products = queries @ vectors.T
    products[query_ids[:, None] == ids[None, :]] = -np.inf
    return np.partition(products, -k, axis=1)[:, -k]


def search_block(query_ids, queries, least, ids, vectors, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, ids and products of the pairs of two blocks whose products reach the queries' thresholds, at most k of
    each query, the best ones; ties go to the smaller id."""
    columns = np.arange(len(ids))
    mask = query_ids[:, None] != ids[None, :]
    for n_segments in SEGMENTS:
        bound = segment_statistics(queries, n_segments) @ segment_statistics(vectors[columns], n_segments).T
        mask &= bound >= least[:, None] - 1e-6 * (1 + np.abs(bound))
        left = mask.any(axis=0)
        columns, mask = columns[left], mask[:, left]
    at, which = np.nonzero(mask)
    product = np.zeros(len(at))
    for start in range(0, len(at), TOGETHER):
        some = slice(start, start + TOGETHER)
        product[some] = np.einsum("ij,ij->i", queries[at[some]], vectors[columns[which[some]]])
    enough = product >= least[at]
    at, found, product = at[enough], ids[columns[which[enough]]], product[enough]
    order = np.lexsort((found, -product, at))
    at, found, product = at[order], found[order], product[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    best = place < k
    return query_ids[at[best]], found[best], product[best]


def _packed(df: DataFrame, block: str) -> DataFrame:
    """One row for each block and dimension: ids and vectors as bytes."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "dim": [rows.dim.iloc[0]],
                block: [rows[block].iloc[0]],
                "ids": [rows.id.to_numpy(np.int64).tobytes()],
                "vectors": [np.array(rows.vector.tolist(), np.float64).tobytes()],
            }
        )

    return df.groupBy("dim", block).applyInPandas(pack, f"dim int, {block} int, ids binary, vectors binary")


def _read(data: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(n, dim)


def _searched(k: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids, query_ids = np.frombuffer(row.ids, np.int64), np.frombuffer(row.query_ids, np.int64)
                vectors, queries = _read(row.vectors, len(ids), row.dim), _read(row.queries, len(query_ids), row.dim)
                own, found, product = search_block(query_ids, queries, np.frombuffer(row.least, np.float64), ids, vectors, k)
                yield pd.DataFrame({"query_id": own, "vec_id": found, "score": np.rint(product).astype(np.int64)})

    return search


def _with_thresholds(asked: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """Blocks of queries with the thresholds (least) that the sample of candidates gives them."""
    sample = candidates.orderBy(F.xxhash64("id", "vector"), "id").limit(SAMPLE).toPandas()  # SAMPLE rows
    of_dim = {
        dim: (rows["id"].to_numpy(np.int64), np.array(rows["vector"].tolist(), np.float64).reshape(len(rows), dim)) for dim, rows in sample.groupby("dim")
    }
    shared = asked.sparkSession.sparkContext.broadcast(of_dim)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                ids = np.frombuffer(row.ids, np.int64)
                least = np.full(len(ids), -np.inf)
                if row.dim in shared.value:
                    least = least_scores(ids, _read(row.vectors, len(ids), row.dim), *shared.value[row.dim], k)
                out.append(least.tobytes())
            yield batch.assign(least=out)

    return asked.mapInPandas(add, f"{asked.schema.simpleString()[7:-1].replace(':', ' ')}, least binary")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = TOP_K) -> DataFrame:
    """query_id, rank, vec_id, score: for every row of `queries` its k largest inner products among `candidates`.

    Both have id (long) and vector (array<double> of whole numbers). Candidates with the query's id are left out and
    ties go to the smaller id. Rows with a null id, a null vector or a null, NaN or infinite component take no part;
    vectors meet those of their own dimension; rows that repeat id and vector count once; fewer than k candidates
    give fewer rows; empty tables give none.
    """

    def usable(df: DataFrame) -> DataFrame:
        bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return df.select("id", "vector").where("id is not null and vector is not null").where(~bad).distinct().withColumn("dim", F.size("vector"))

    candidates, queries = usable(candidates), usable(queries)
    n_blocks = max(1, -(-candidates.count() // CANDIDATE_BLOCK))
    n_query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    by_hash = lambda n: F.pmod(F.xxhash64("id", "vector"), F.lit(n)).cast("int")
    blocks = stash(_packed(candidates.withColumn("block", by_hash(n_blocks)), "block"), "top-k-candidates")
    packed = _packed(queries.withColumn("query_block", by_hash(n_query_blocks)), "query_block")
    asked = stash(_with_thresholds(packed, candidates, k), "top-k-queries")
    spread = asked.select(
        "dim", "query_block", F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"), "least",
        F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"),
    )
    cells = blocks.repartition(n_blocks, "dim", "block").join(spread.repartition(n_blocks, "dim", "block").hint("merge"), ["dim", "block"])
    found = cells.select("dim", "ids", "vectors", "query_ids", "queries", "least").mapInPandas(_searched(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 64).cast("double")).alias("vector")
    )
    return top_k(vectors.where("id % 20 = 0"), vectors)


OP7_SQL = """
WITH whole AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 20
"""
