"""Ranked lexical search: the best documents of every item, exactly, by buckets of vector lengths.

A document is a vector of impacts of the terms that items have; an item is a vector of how often it has each term; the
score is their inner product, weighted by term. Half of a term's weight (its square root) goes to either side. Documents
of a block are sorted by the lengths of their vectors and cut into buckets. With the score of an item's k-th best so far,
the Cauchy-Schwarz inequality rules out whole buckets; within a bucket it says which of the item's heaviest coordinates
any document must share, and the products on these with what the rest of both vectors can add rule out documents. The
survivors are scored in integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivia.llm.common import stash, table

#: Parts of a tf's impact: 1000000000 tf / (1000 tf + 8 m), m = 25 + 75 n N / L.
SCALE, TF_STEP, M_STEP, M_LEAST, M_SHARE = 1_000_000_000, 1000, 8, 25, 75
WEIGHT = 1000
K = 10
#: Coordinates of items that are searched for in one pass over the documents (an item is never cut).
BLOCK_COORDINATES = 500_000
#: Coordinates of documents that are worked on at once, and of vectors in a bucket at most; shortest to longest of a bucket.
AT_ONCE, BUCKET, NEAR = 2_000_000, 4096, 0.85
#: What rounding may take from a bound.
SLACK = 1 + 1e-9
VECTOR_SCHEMA = "doc_id long, n long, terms array<int>, tfs array<int>"
HIT_SCHEMA = "item int, doc_id long, score long"

#: ASCII letters and digits and all other characters beyond ASCII stand for themselves (A-Z lower-cased), the rest parts.
_PARTS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_PARTS).split()


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int | None, Counter]]]:
    """(item id, terms) of items with terms, as many as hold BLOCK_COORDINATES."""
    held, size = [], 0
    for item_id, text in items.select(F.col(id_col).cast("long"), text_col).toLocalIterator():
        terms = Counter(terms_of((text or "").encode()))
        if held and size + len(terms) > BLOCK_COORDINATES:
            yield held
            held, size = [], 0
        if terms:
            held.append((item_id, terms))
            size += len(terms)
    if held:
        yield held


def term_vectors(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """VECTOR_SCHEMA of every document with a term: how many it has, and how often those of the vocabulary (sorted)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(shared.value)}
        known, of = number.__contains__, number.__getitem__
        for batch in batches:
            ids, counts, sizes, terms, tfs = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                found = terms_of(text.as_py() or b"")
                if found:
                    held = Counter(filter(known, found))
                    ids.append(doc_id)
                    counts.append(len(found))
                    sizes.append(len(held))
                    terms.extend(map(of, held))
                    tfs.extend(held.values())
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(v, pa.int32())) for v in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(vectors, VECTOR_SCHEMA)


def weight(documents: int, holding: int) -> int:
    return math.floor(WEIGHT * math.log((2 * documents + 2) / (2 * holding + 1)))


class Item:
    """One item's coordinates from the heaviest, and its best documents so far."""

    def __init__(self, terms: np.ndarray, times: np.ndarray, weights: np.ndarray, k: int):
        order = np.argsort(-times * np.sqrt(weights[terms]), kind="stable")
        self.terms, self.times = terms[order], times[order]
        self.exact = self.times * weights[self.terms]
        self.scaled = self.times * np.sqrt(weights[self.terms])
        #: The length of the vector behind its first coordinates, and of all of it.
        self.rest = np.sqrt(np.append(np.cumsum((self.scaled**2)[::-1])[::-1], 0.0))
        self.k, self.best = k, np.zeros((0, 3), np.int64)

    @property
    def least(self) -> int:
        """What a score must reach."""
        return int(self.best[-1, 0]) if len(self.best) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        ok = scores > 0
        rows = np.concatenate([self.best, np.stack([scores[ok], nulls[ok], ids[ok]], 1)])
        self.best = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))[: self.k]]


class Block:
    """Vectors of documents by falling length, their coordinates by document and by term."""

    def __init__(self, batch: pa.Table, weights: np.ndarray, documents: int, tokens: int):
        lists = batch["terms"].combine_chunks(), batch["tfs"].combine_chunks()
        terms, tfs = (c.flatten().to_numpy().astype(np.int64) for c in lists)
        sizes = np.diff(lists[0].offsets.to_numpy())
        doc = np.repeat(np.arange(len(sizes)), sizes)
        lengths = batch["n"].to_numpy()
        if M_SHARE * int(lengths.max()) * documents < 1 << 63:
            m = M_LEAST + M_SHARE * lengths * documents // tokens
        else:
            m = np.array([M_LEAST + M_SHARE * n * documents // tokens for n in lengths.tolist()], np.int64)
        impacts = SCALE * tfs // (TF_STEP * tfs + M_STEP * m[doc])
        scaled = impacts * np.sqrt(weights[terms])
        squares = np.bincount(doc, scaled * scaled, len(sizes))
        order = np.argsort(-squares, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.squares = squares[order]
        ids = batch["doc_id"]
        self.nulls, self.ids = ids.is_null().to_numpy().astype(np.int64)[order], ids.fill_null(0).to_numpy()[order]
        # by document
        by_doc = np.argsort(rank[doc], kind="stable")
        self.terms, self.impacts = terms[by_doc], impacts[by_doc]
        self.starts = np.concatenate([[0], np.cumsum(sizes[order])])
        # by term, and within it by length
        by_term = np.argsort(self.terms, kind="stable")
        self.ranks = np.repeat(np.arange(len(order)), sizes[order])[by_term]
        self.scaled = scaled[by_doc][by_term]
        self.term_starts = np.searchsorted(self.terms[by_term], np.arange(len(weights) + 1))
        self.buckets = self._buckets()

    def _buckets(self) -> list[tuple[int, int]]:
        out, at, end = [], 0, int((self.squares > 0).sum())
        while at < end:
            near = int(np.searchsorted(-self.squares, -self.squares[at] * NEAR * NEAR, side="right"))
            out.append((at, max(at + 1, min(near, at + BUCKET, end))))
            at = out[-1][1]
        return out

    def search(self, item: Item, exact: np.ndarray) -> None:
        """Put this block's documents among the item's best; `exact` has its weights by term."""
        for a, b in self.buckets:
            length = math.sqrt(self.squares[a])
            # coordinates that a document can't all miss
            focus = int(np.searchsorted(-item.rest, -item.least / (length * SLACK), side="right"))
            if not focus:  # the whole vector is too short, and all that follow
                return
            focus = min(focus, len(item.terms))
            dots, shared = np.zeros(b - a), np.zeros(b - a)
            for term, scaled in zip(item.terms[:focus].tolist(), item.scaled[:focus].tolist()):
                i, j = self.term_starts[term], self.term_starts[term + 1]
                if i < j:
                    i, j = i + np.searchsorted(self.ranks[i:j], (a, b))
                    at, x = self.ranks[i:j] - a, self.scaled[i:j]  # a document has a term once
                    dots[at] += scaled * x
                    shared[at] += x * x
            most = dots + item.rest[focus] * np.sqrt(np.maximum(self.squares[a:b] - shared, 0) + self.squares[a:b] * 1e-12)
            left = a + np.flatnonzero((dots > 0) & (most * SLACK >= item.least))
            if len(left):
                sizes = self.starts[left + 1] - self.starts[left]
                ends = np.cumsum(sizes)
                at = np.arange(ends[-1]) + np.repeat(self.starts[left] - ends + sizes, sizes)
                products = np.concatenate([[0], np.cumsum(exact[self.terms[at]] * self.impacts[at])])
                item.add(products[ends] - products[ends - sizes], self.ids[left], self.nulls[left])


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        at = 0
        ends = batch.column("terms").offsets.to_numpy()
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, ends[at] + max(AT_ONCE - size, 0), side="right")) - 1)
            end = min(end, batch.num_rows)
            held.append(batch.slice(at, end - at))
            size += int(ends[end] - ends[at])
            at = end
            if size >= AT_ONCE:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held and size:
        yield pa.Table.from_batches(held)


def _search_block(docs: DataFrame, block: list[tuple[int | None, Counter]], k: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = sorted(set().union(*(terms for _, terms in block)))
    number = {t: i for i, t in enumerate(vocabulary)}
    vectors = stash(term_vectors(docs, vocabulary, id_col, text_col), "term-vectors")
    documents, tokens = vectors.agg(F.count("*"), F.sum("n")).first()
    holding = np.zeros(len(vocabulary), np.int64)
    for term, count in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row a term of the vocabulary
        holding[term] = count
    weights = np.array([weight(documents, n) for n in holding.tolist()], np.int64)
    coordinates = [(np.array([number[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for _, c in block]
    shared = spark.sparkContext.broadcast((coordinates, weights))

    def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coordinates, weights = shared.value
        items, exact = [Item(t, n, weights, k) for t, n in coordinates], np.zeros(len(weights), np.int64)
        for some in _blocks(batches):
            held = Block(some, weights, documents, tokens)
            for item in items:
                exact[item.terms] = item.exact
                held.search(item, exact)
                exact[item.terms] = 0
        rows = np.concatenate([np.zeros((0, 4), np.int64), *(np.insert(x.best, 0, i, axis=1) for i, x in enumerate(items))])
        columns = [pa.array(rows[:, 0].astype(np.int32)), pa.array(rows[:, 3], mask=rows[:, 2] > 0), pa.array(rows[:, 1])]
        yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = vectors.select("doc_id", "n", "terms", "tfs").mapInArrow(best, HIT_SCHEMA).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item int, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(
    docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the k best documents with a score above 0 of every row of `items`.

    Terms are runs of ASCII letters and digits and characters beyond ASCII; A-Z are lower-cased. Equal scores come by
    ascending doc_id, nulls last. Every row of `docs` is a document of its own, whatever its id; rows with null, empty or
    term-less texts are none, and such items find nothing. Other columns are not read. Items are worked on in blocks
    whose coordinates are bounded, so what is broadcast is; each block reads the documents once.
    """
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in item_blocks(items, item_col, item_text_col):
        out = out.unionByName(_search_block(docs, block, k, id_col, text_col))
    return out


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH documents_terms AS (
  SELECT row_number() OVER () AS d, doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
items AS (SELECT row_number() OVER () AS i, item_id, text FROM benchmark),
item_terms AS (
  SELECT i, term, count(*) AS times FROM (
    SELECT i, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM items) GROUP BY i, term),
totals AS (SELECT count(DISTINCT d)::BIGINT AS docs, count(*)::BIGINT AS tokens FROM documents_terms),
sizes AS (SELECT d, doc_id, 100 - 75 + (75 * count(*) * docs) // tokens AS m FROM documents_terms, totals GROUP BY d, doc_id, docs, tokens),
postings AS (
  SELECT d, term, count(*)::BIGINT AS tf FROM documents_terms WHERE term IN (SELECT term FROM item_terms) GROUP BY d, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM postings, totals GROUP BY term, docs),
scores AS (
  SELECT i, d, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM postings JOIN item_terms USING (term) JOIN weights USING (term) JOIN sizes USING (d) GROUP BY i, d, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked JOIN items USING (i) WHERE rank <= 10
"""
