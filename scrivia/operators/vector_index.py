"""A stored inverted-file index of unit vectors with product-quantised residuals.

Vectors belong to the list of their nearest centroid, and what they differ from it by is stored as one byte for each of
SUBSPACES parts of the coordinates: the number of the nearest entry of that part's codebook. A search scores the codes of
the few lists whose centroids are nearest to a question, from one table of products a question, and reads whole vectors
of the best of those alone, for exact scores. Centroids and codebooks come from a bounded sample (SAMPLE rows); every
vector is indexed. The index is written once, by lists, and searched any number of times.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivia.operators.index import MAX_BROADCAST_QUERIES, PRODUCTS, handed_on, top
from scrivia.operators.lineage import shared_path

#: Rows from which centroids and codebooks are learned, rounds of learning, lists at most.
SAMPLE, ROUNDS, MAX_LISTS = 65_536, 12, 4096
#: Parts of the coordinates, and entries of each part's codebook.
SUBSPACES, ENTRIES = 16, 256
#: Rows of the sample whose neighbours are looked for, how many of each, and the share of these that lists must hold.
TRIED, NEIGHBOURS, FOUND = 256, 10, 0.97
#: How many whole vectors a question reads for each of the k it wants.
READ = 8


class VectorIndex(NamedTuple):
    """path holds list=n folders of vec_id, code (SUBSPACES bytes) and vector; sizes counts the rows of each list; share is
    that of all rows whose codes a question is compared with."""

    path: str
    id_type: str
    centroids: np.ndarray
    codebooks: np.ndarray
    sizes: dict[int, int]
    share: float

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"vec_id {self.id_type}, code binary, vector array<double>, list int").parquet(self.path)


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * (rows @ centres.T), axis=1)


def centres_of(rows: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of n groups by repeated means; a group that loses all its rows starts again at the row that is worst off."""
    centres = rows[rng.choice(len(rows), min(n, len(rows)), replace=False)].copy()
    for _ in range(ROUNDS):
        own = nearest(rows, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        counts = np.bincount(own, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        empty = np.flatnonzero(counts == 0)
        if len(empty):
            far = np.argsort(-((rows - centres[own]) ** 2).sum(1), kind="stable")[: len(empty)]
            centres[empty] = rows[far]
    return centres


def parts(rows: np.ndarray) -> list[np.ndarray]:
    return np.array_split(rows, SUBSPACES, axis=1)


def needed_share(rows: np.ndarray, centroids: np.ndarray) -> float:
    """The share of rows in the lists nearest to a row that hold FOUND of the rows' NEIGHBOURS best products."""
    own, tried = nearest(rows, centroids), rows[:TRIED]
    sizes = np.bincount(own, minlength=len(centroids))
    order = np.argsort(-(tried @ centroids.T), axis=1, kind="stable")
    reached = np.empty(order.shape)
    np.put_along_axis(reached, order, np.cumsum(sizes[order], axis=1) / max(len(rows), 1), axis=1)
    k = min(NEIGHBOURS, len(rows))
    best = np.argpartition(-(tried @ rows.T), k - 1, axis=1)[:, :k]
    return float(np.quantile(np.take_along_axis(reached, own[best], axis=1), FOUND))


def vector_index(vectors: DataFrame, lists: int | None = None, seed: int = 7) -> VectorIndex:
    """The index of vectors (vec_id, vector), all of one length. Null vectors are left out; repeated rows are all kept."""
    spark = vectors.sparkSession
    rows = vectors.where("vector IS NOT NULL").select("vec_id", F.col("vector").cast("array<double>").alias("vector"))
    sample = rows.orderBy(F.xxhash64("vector", F.lit(seed))).limit(SAMPLE).select("vector").toArrow()  # SAMPLE rows
    own = np.stack(sample["vector"].to_numpy()) if len(sample) else np.zeros((1, SUBSPACES))
    rng = np.random.default_rng(seed)
    centroids = centres_of(own, lists or min(MAX_LISTS, max(1, round(2 * np.sqrt(len(own))))), rng)
    residuals = own - centroids[nearest(own, centroids)]
    width = max(p.shape[1] for p in parts(own))
    codebooks = np.zeros((SUBSPACES, ENTRIES, width))
    for i, part in enumerate(parts(residuals)):
        found = centres_of(part, ENTRIES, rng)
        codebooks[i, : len(found), : part.shape[1]] = found
        codebooks[i, len(found) :, : part.shape[1]] = found[:1]
    shared = spark.sparkContext.broadcast((centroids, codebooks))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, codebooks = shared.value
        for batch in batches:
            if batch.num_rows:
                found = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                at = nearest(found, centroids)
                codes = np.stack([nearest(p, codebooks[i, :, : p.shape[1]]) for i, p in enumerate(parts(found - centroids[at]))], 1).astype(np.uint8)
                code = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), code, batch.column(1), pa.array(at.astype(np.int32))], ["vec_id", "code", "vector", "list"])

    id_type, path = rows.schema["vec_id"].dataType.simpleString(), shared_path(spark, "vector-index")
    made = rows.mapInArrow(encode, f"vec_id {id_type}, code binary, vector array<double>, list int")
    # a list of many rows goes to several tasks
    shares = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // max(1, len(centroids) // 4))
    dealt = made.repartition("list", F.pmod(F.xxhash64("vec_id"), F.lit(shares))).sortWithinPartitions("list", "vec_id")
    dealt.write.partitionBy("list").parquet(path)
    index = VectorIndex(path, id_type, centroids, codebooks, {}, needed_share(own, centroids))
    return index._replace(sizes=dict(index.read(spark).groupBy("list").count().collect()))  # one row a list


def probes(index: VectorIndex, asked: np.ndarray, share: float) -> np.ndarray:
    """The lists that each question looks into, nearest first: as many as hold `share` of all vectors, at least one."""
    sizes = np.array([index.sizes.get(i, 0) for i in range(len(index.centroids))])
    order = np.argsort(-(asked @ index.centroids.T), axis=1, kind="stable")
    reached = np.cumsum(sizes[order], axis=1)
    chosen = reached <= share * sizes.sum() + 0.5
    chosen[np.arange(len(asked)), (sizes[order] > 0).argmax(1)] = True  # the first list with a row
    return np.where(chosen & (sizes[order] > 0), order, -1)


def ivf_top(queries: DataFrame, index: VectorIndex, k: int, share: float | None = None, read: int = READ) -> DataFrame:
    """query_id, vec_id, score, rank: the k best inner products among the lists that a question (query_id, vector) looks
    into. Questions come in blocks of MAX_BROADCAST_QUERIES; a block reads the folders of its lists alone."""
    spark = queries.sparkSession
    asked = queries.where("vector IS NOT NULL").select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    asked_type = asked.schema["query_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"query_id {asked_type}, vec_id {index.id_type}, score double, rank int")
    blocks = -(-asked.count() // MAX_BROADCAST_QUERIES) if index.sizes else 0
    for n in range(blocks):
        some = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n)
        out = out.unionByName(_ivf_block(some, index, k, index.share if share is None else share, read, asked_type))
    return out


def _ivf_block(asked: DataFrame, index: VectorIndex, k: int, share: float, read: int, asked_type: str) -> DataFrame:
    spark, rows = asked.sparkSession, asked.toArrow()  # MAX_BROADCAST_QUERIES or so
    vectors = np.stack(rows["vector"].to_numpy()) if len(rows) else np.zeros((0, index.centroids.shape[1]))
    looked = probes(index, vectors, share) if len(rows) else np.zeros((0, 1), int)
    by_list: dict[int, list[int]] = {}
    for q, own in enumerate(looked):
        for at in own[own >= 0].tolist():
            by_list.setdefault(at, []).append(q)
    # products of every question's parts with every entry
    tables = np.stack([p @ index.codebooks[i, :, : p.shape[1]].T for i, p in enumerate(parts(vectors))], 1) if len(rows) else np.zeros((0, SUBSPACES, ENTRIES))
    shared, keep = spark.sparkContext.broadcast((by_list, tables, vectors @ index.centroids.T)), k * read

    def by_code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_list, tables, base = shared.value
        known = np.full((len(tables), keep), -np.inf)  # a task hands on what is among the best that it has seen
        for batch in batches:
            lists = batch.column(2).to_numpy()
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, SUBSPACES)
            for at in np.unique(lists).tolist():
                asked, rows = np.array(by_list.get(at, ()), int), np.flatnonzero(lists == at)
                step = max(keep, PRODUCTS // max(len(asked), 1))
                for own in np.split(rows, range(step, len(rows), step)) if len(asked) else ():
                    scores = base[asked, at][:, None] + sum(tables[asked, i][:, codes[own, i]] for i in range(SUBSPACES))
                    known[asked], mine, which = handed_on(scores, known[asked], batch.column(0).take(pa.array(own)), keep)
                    place = own[which]
                    columns = [pa.array(asked[mine].astype(np.int32)), batch.column(0).take(pa.array(place)), pa.array(lists[place]), pa.array(scores[mine, which])]
                    yield pa.RecordBatch.from_arrays(columns, ["q", "vec_id", "list", "near"])

    stored = index.read(spark).where(F.col("list").isin(sorted(by_list)))
    near = stored.select("vec_id", "code", "list").mapInArrow(by_code, f"q int, vec_id {index.id_type}, list int, near double")
    chosen = top(near, ["q"], keep, F.desc("near"), "vec_id", rank="_place").select("q", "vec_id", "list").distinct()
    names = spark.createDataFrame(pa.table({"q": pa.array(range(len(rows)), pa.int32()), "query_id": rows["query_id"], "_q": rows["vector"]}))
    met = stored.select("vec_id", "list", "vector").join(F.broadcast(chosen), ["vec_id", "list"]).join(F.broadcast(names), "q")  # keep rows a question
    exact = F.aggregate(F.zip_with("_q", "vector", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = met.select(F.col("query_id").cast(asked_type), "vec_id", F.round(exact, 6).alias("score"))
    return top(scored, ["query_id"], k, F.desc("score"), "vec_id")


_stored: dict[tuple[str, str], tuple[object, VectorIndex]] = {}


def index_of_version(spark: SparkSession, name: str, vectors: DataFrame) -> VectorIndex:
    """The index of a table of vectors, stored until their content changes."""
    h = F.xxhash64("vec_id", "vector")
    version = tuple(vectors.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first())
    key = (spark.sparkContext.applicationId, name)
    if key not in _stored or _stored[key][0] != version:
        _stored[key] = (version, vector_index(vectors))
    return _stored[key][1]
