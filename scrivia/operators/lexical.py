"""The lexical index: postings in blocks, kept in segments, and BM25 searches that skip blocks by their maxima.

Rows are numbered in spans of at most SPAN rows. A block holds a term's postings in one span, with the largest tf and the
least length a tf, from which the most that the term can add to any score follows whatever the average length is. Blocks
are stored by buckets of terms, so a search reads the buckets of its questions' terms alone, and meets them span by span.

An index is a row of segments. The first is the base; a refresh writes one more with the rows that came or changed and
with the places of older rows that are dead, and never touches what is stored. Statistics are kept by addition: what dead
rows had is taken off. A version is the checksum of all ids and texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivia.functions import text as T
from scrivia.functions.words import Vocabulary
from scrivia.operators.lineage import shared_path, spread, written

# Fixed values of the BM25 formula.
K1, B, EPSILON = 1.5, 0.75, 0.25
POOL = 24
#: Rows of a span: 2 to this power. Buckets of terms. Segments that an index has before they are made one.
SPAN_BITS, BUCKETS, MAX_SEGMENTS = 12, 32, 12
#: Rows of a span that are inverted at once.
INVERTED = 1024
#: Terms of questions (with their question, 40 bytes or so) that one pass over the blocks is given.
MAX_BROADCAST_TERMS = 200_000
#: Ids of changed rows that are broadcast to the older segments; more meet them in a shuffle.
MAX_BROADCAST_CHANGES = 200_000
#: Scores are compared once they are rounded; what rounding may add.
DIGITS, MARGIN = 6, 2e-6
BLOCK, NAMES, DEAD, ALLOWED = range(4)
#: The folder of the names among those of the buckets.
NO_BUCKET = -1
ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}


class Segment(NamedTuple):
    """A folder with blocks (bucket, term, span, docs, tfs, max_tf, least_ratio), names of spans (span, docs, ids, hashes,
    lengths), and dead places of older segments (segment, span, docs)."""

    number: int
    path: str
    id_type: str

    @property
    def made(self) -> str:
        return (
            "term string, span long, docs array<int>, tfs array<int>, max_tf int, least_ratio double, "
            f"ids array<{self.id_type}>, hashes array<long>, lengths array<int>, bucket int"
        )

    def read(self, spark: SparkSession, part: str) -> DataFrame:
        if part == "dead":
            return spark.read.schema("segment int, span long, docs array<int>").parquet(f"{self.path}/dead")
        found = spark.read.schema(self.made).parquet(f"{self.path}/made").withColumn("segment", F.lit(self.number))
        if part == "blocks":
            return found.where(F.col("bucket") != NO_BUCKET).drop("ids", "hashes", "lengths")
        return found.where(F.col("bucket") == NO_BUCKET).select("segment", "span", "docs", "ids", "hashes", "lengths")


class LexicalIndex(NamedTuple):
    """Segments, weights (term, df, idf, avg_length), and totals (rows, their lengths added up)."""

    segments: tuple[Segment, ...]
    weights: DataFrame
    rows: int
    total_length: int

    def read(self, part: str) -> DataFrame:
        spark = self.weights.sparkSession
        return reduce(DataFrame.unionByName, [s.read(spark, part) for s in self.segments])


def bucket(term) -> F.Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _inverted(id_type: pa.DataType):
    """Rows (place, id, hash, text) of a span -> its blocks and names. A text without terms has the term `_`."""
    fields = [("term", pa.string()), ("span", pa.int64()), ("docs", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())), ("max_tf", pa.int32()), ("least_ratio", pa.float64())]
    fields += [("ids", pa.list_(id_type)), ("hashes", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32()))]

    def batch_of(n: int, span: int, **columns: pa.Array) -> pa.RecordBatch:
        columns["span"] = pa.array(np.full(n, span, np.int64))
        return pa.RecordBatch.from_arrays([columns.get(k, pa.nulls(n, t)) for k, t in fields], [k for k, _ in fields])

    def lists(values: pa.Array, bounds: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)

    def invert(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for whole in batches:
            spans = whole.column("place").to_numpy() >> SPAN_BITS
            ends = [0, *(np.flatnonzero(spans[1:] != spans[:-1]) + 1).tolist(), len(spans)]
            cuts = [(at, min(at + INVERTED, b)) for a, b in zip(ends, ends[1:]) for at in range(a, b, INVERTED)]
            for a, b in cuts:
                part, span, n = whole.slice(a, b - a), int(spans[a]), b - a
                # a span is spread over slices and batches; places within it stay apart
                places = (part.column("place").to_numpy() & ((1 << SPAN_BITS) - 1)).astype(np.int32)
                (words, lengths), terms = vocabulary.coded(part.column("text").to_pylist()), vocabulary.tokens
                if len(none := np.flatnonzero(lengths == 0)):
                    words, terms = np.insert(words, (np.cumsum(lengths) - lengths)[none], len(terms)), [*terms, "_"]
                    lengths[none] = 1
                pairs, tf = np.unique(words * n + np.repeat(np.arange(n), lengths), return_counts=True)
                code, row = pairs // n, pairs % n
                starts = np.flatnonzero(np.diff(code, prepend=-1))
                bounds, tf = np.append(starts, len(code)), tf.astype(np.int32)
                yield batch_of(
                    len(starts), span, term=pa.array([terms[c] for c in code[starts].tolist()], pa.string()), docs=lists(pa.array(places[row]), bounds), tfs=lists(pa.array(tf), bounds),
                    max_tf=pa.array(np.maximum.reduceat(tf, starts)), least_ratio=pa.array(np.minimum.reduceat(lengths[row] / tf, starts)),
                )
                one = np.array([0, n])
                yield batch_of(1, span, docs=lists(pa.array(places), one), ids=lists(part.column("id"), one), hashes=lists(part.column("hash"), one), lengths=lists(pa.array(lengths.astype(np.int32)), one))

    return invert


def _segment(number: int, corpus: DataFrame, id_col: str, text_col: str) -> Segment:
    """Rows of a corpus, cut into terms once, where they are read; blocks are shuffled to their buckets and written."""
    spark, corpus = corpus.sparkSession, spread(corpus.select(id_col, text_col))
    rows = corpus.select(F.monotonically_increasing_id().alias("place"), F.col(id_col).alias("id"), text_hash(text_col).alias("hash"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    segment = Segment(number, shared_path(spark, "segment"), kind)
    blocks = rows.mapInArrow(_inverted(ARROW.get(kind, pa.int64())), segment.made.removesuffix(", bucket int"))
    dealt = blocks.withColumn("bucket", F.when(F.col("term").isNull(), NO_BUCKET).otherwise(bucket("term")))
    # a bucket's blocks go to several tasks where there are more tasks than buckets
    shares = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
    sorted_blocks = dealt.repartition("bucket", F.pmod(F.xxhash64("span"), F.lit(shares))).sortWithinPartitions("bucket", "term", "span")
    sorted_blocks.write.partitionBy("bucket").parquet(f"{segment.path}/made")
    return segment


def text_hash(text_col: str) -> F.Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _weights(counts: DataFrame, rows: int, total_length: int) -> DataFrame:
    """term, df, idf of signed counts (term, df); an idf below zero is lifted to EPSILON times the mean."""
    df = counts.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    raw = written(df.withColumn("raw", F.log(F.lit(rows) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)), "weights")
    mean = raw.agg(F.avg("raw")).first()[0] or 0.0
    lifted = F.when(F.col("raw") < 0, F.lit(EPSILON * mean)).otherwise(F.col("raw"))
    return raw.select("term", "df", lifted.alias("idf"), F.lit(total_length / max(rows, 1)).alias("avg_length"))


def lexical_index(corpus: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> LexicalIndex:
    """An index of one segment. Ids are unique; a null text has no terms; other columns are not read."""
    spark = corpus.sparkSession
    base = _segment(0, corpus, id_col, text_col)
    rows, length = _totals(base.read(spark, "names").select(F.explode("lengths").alias("length")))
    return LexicalIndex((base,), _weights(_counts(base, spark), rows, length), rows, length)


def _totals(rows: DataFrame) -> tuple[int, int]:
    return tuple(rows.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first())


def _counts(segment: Segment, spark: SparkSession) -> DataFrame:
    return segment.read(spark, "blocks").select("term", F.size("docs").cast("long").alias("df"))


def dead_places(index: LexicalIndex) -> DataFrame:
    """segment, span, docs: places of rows that a later segment replaced or took away."""
    spark = index.weights.sparkSession
    none = spark.createDataFrame([], "segment int, span long, docs array<int>")
    return reduce(DataFrame.unionByName, [s.read(spark, "dead") for s in index.segments[1:]], none)


def live_rows(index: LexicalIndex) -> DataFrame:
    """segment, span, pos, id, hash, length of the rows that are not dead."""
    lists = F.arrays_zip(F.col("docs").alias("pos"), F.col("ids").alias("id"), F.col("hashes").alias("hash"), F.col("lengths").alias("length"))
    rows = index.read("names").select("segment", "span", F.inline(lists))
    if len(index.segments) == 1:
        return rows
    dead = dead_places(index).select("segment", "span", F.explode("docs").alias("pos"))
    return rows.join(dead, ["segment", "span", "pos"], "left_anti")


def refreshed_index(index: LexicalIndex, changed: DataFrame, gone: DataFrame | None = None, id_col: str = "chunk_id", text_col: str = "text") -> LexicalIndex:
    """The index after rows of `changed` came or changed and those of `gone` (ids) went.

    What is stored stays as it is; one segment is written with the new rows' blocks and the dead rows' places, and
    statistics are those of before and what came, less what went: blocks of the spans that hold dead rows tell that.
    """
    spark = changed.sparkSession
    ids = changed.select(F.col(id_col).alias("id"))
    ids = written((ids if gone is None else ids.unionByName(gone.select(F.col(id_col).alias("id")))).distinct(), "changed-ids")
    known = F.broadcast(ids) if ids.count() <= MAX_BROADCAST_CHANGES else ids
    old = written(live_rows(index).join(known, "id", "left_semi").select("segment", "span", "pos", "length"), "dead-rows")
    new = _segment(index.segments[-1].number + 1, changed, id_col, text_col)
    # a span has at most 2 ** SPAN_BITS rows
    old.groupBy("segment", "span").agg(F.collect_list("pos").alias("docs")).write.parquet(f"{new.path}/dead")
    came, went = _totals(new.read(spark, "names").select(F.explode("lengths").alias("length"))), _totals(old)
    taken = _taken(index.read("blocks").select("segment", "span", "term", "docs"), new.read(spark, "dead"))
    rows, length = index.rows + came[0] - went[0], index.total_length + came[1] - went[1]
    weights = _weights(index.weights.select("term", "df").unionByName(_counts(new, spark)).unionByName(taken), rows, length)
    return LexicalIndex((*index.segments, new), weights, rows, length)


def _taken(blocks: DataFrame, dead: DataFrame) -> DataFrame:
    """term, df below zero: how many of a block's postings are dead. Blocks of spans with dead places meet these, which
    come first and are marked once a span."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, key = np.zeros(1 << SPAN_BITS, bool), None
        for batch in batches:
            segments, spans, kinds = (batch.column(c).to_numpy() for c in ("segment", "span", "kind"))
            docs, terms = batch.column("docs"), batch.column("term")
            at, places = docs.offsets.to_numpy(), docs.values.to_numpy()
            changes = (np.diff(segments) != 0) | (np.diff(spans) != 0) | (np.diff(kinds) != 0)
            cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                own = places[at[a] : at[b]]
                if (segments[a], spans[a]) != key:
                    marked[:], key = False, (segments[a], spans[a])
                if kinds[a] == DEAD:
                    marked[own] = True
                    continue
                n = np.diff(np.append(0, np.cumsum(marked[own]))[at[a : b + 1] - at[a]])
                met = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([terms.take(pa.array(a + met)), pa.array(-n[met].astype(np.int64))], ["term", "df"])

    met = blocks.join(dead.select("segment", "span"), ["segment", "span"], "left_semi").withColumn("kind", F.lit(BLOCK))
    both = met.unionByName(dead.withColumn("kind", F.lit(DEAD)), allowMissingColumns=True)
    dealt = both.select("segment", "span", "kind", "term", "docs").repartition("segment", "span").sortWithinPartitions("segment", "span", F.desc("kind"))
    return dealt.mapInArrow(count, "term string, df long")


def content_version(corpus: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> tuple:
    """Number of rows and two checksums of all ids and texts, in any order."""
    return _version(corpus.select(F.col(id_col).alias("id"), text_hash(text_col).alias("hash")))


def _version(rows: DataFrame) -> tuple:
    h = F.xxhash64("id", "hash")
    return tuple(rows.agg(F.count("*"), F.coalesce(F.bit_xor(h), F.lit(0)), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first())


def synchronized(index: LexicalIndex, corpus: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> LexicalIndex:
    """The index after what `corpus` has now: rows that differ by id or text are found by their checksums and refreshed."""
    now = corpus.select(F.col(id_col).alias("id"), text_hash(text_col).alias("now"))
    both = written(live_rows(index).select("id", "hash").join(now, "id", "full").where("NOT (hash <=> now)").select("id", "now"), "differing-ids")
    if both.isEmpty():
        return index
    changed = corpus.join(both.where("now IS NOT NULL").select(F.col("id").alias(id_col)), id_col, "left_semi")
    out = refreshed_index(index, changed, both.where("now IS NULL").select(F.col("id").alias(id_col)), id_col, text_col)
    return out if len(out.segments) <= MAX_SEGMENTS else lexical_index(corpus, id_col, text_col)


_stored: dict[tuple[str, str], tuple[tuple, LexicalIndex]] = {}


def index_of_version(spark: SparkSession, name: str, corpus: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> LexicalIndex:
    """The index of a collection, stored in the shared folder and refreshed when the collection's content has changed."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _stored:
        index = lexical_index(corpus, id_col, text_col)
        _stored[key] = (_version(live_rows(index)), index)
        return index
    version = content_version(corpus, id_col, text_col)
    if _stored[key][0] != version:
        _stored[key] = (version, synchronized(_stored[key][1], corpus, id_col, text_col))
    return _stored[key][1]


def holding(index: LexicalIndex, asked: DataFrame) -> DataFrame:
    """question_id, id of the rows that hold a question's term (question_id, term). Only blocks of these terms are read; rows
    that have died since may be among them, and rows come once a segment."""
    places = index.read("blocks").join(asked, "term").select("question_id", "segment", "span", F.explode("docs").alias("pos"))
    names = index.read("names").select("segment", "span", F.inline(F.arrays_zip(F.col("docs").alias("pos"), F.col("ids").alias("id"))))
    return places.join(names, ["segment", "span", "pos"]).select("question_id", "id")


def question_terms(questions: DataFrame, id_col: str = "question_id", text_col: str = "question") -> DataFrame:
    """question, term, times."""
    return questions.select(id_col, F.explode(T.tokenize(F.col(text_col))).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("times"))


# -- search


class Question(NamedTuple):
    number: int
    terms: list[int]
    weights: list[float]


class Span:
    """The blocks of a span that questions ask for, and its rows' names."""

    def __init__(self) -> None:
        self.blocks: dict[int, list[tuple[np.ndarray, np.ndarray, int, float]]] = {}
        self.ids: list = []
        self.places: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.dead: list[np.ndarray] = []
        self.allowed: np.ndarray | None = None

    def ready(self, average: float, everything: bool) -> None:
        size = 1 << SPAN_BITS
        self.length, self.name, self.live = np.ones(size), [None] * size, np.zeros(size, bool)
        for places, lengths, ids in zip(self.places, self.lengths, self.ids):
            self.length[places] = lengths
            for place, name in zip(places.tolist(), ids):
                self.name[place] = name
            self.live[places] = True
        if not everything:
            keep = np.zeros(size, bool)
            if self.allowed is not None:
                keep[self.allowed] = True
            self.live &= keep
        for dead in self.dead:
            self.live[dead] = False
        self.average, self.made = average, {}

    def most(self, term: int) -> float:
        """What the term can add to a score at weight 1, by its blocks' maxima."""
        bound = lambda tf, ratio: (K1 + 1) / (1 + K1 * (1 - B) / tf + K1 * B / self.average * ratio)
        return max(bound(tf, ratio) for _, _, tf, ratio in self.blocks[term])

    def impacts(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in ascending order, and what the term adds there at weight 1; worked out when first asked for."""
        if term not in self.made:
            docs = np.concatenate([d for d, _, _, _ in self.blocks[term]])
            tf = np.concatenate([t for _, t, _, _ in self.blocks[term]]).astype(float)
            order = np.argsort(docs, kind="stable")
            docs, tf = docs[order], tf[order]
            self.made[term] = docs, tf * (K1 + 1) / (tf + K1 * (1 - B + B * self.length[docs] / self.average))
        return self.made[term]


class Best:
    """The k best rows of a question so far: rounded score, name, score."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def least(self) -> float:
        return self.rows[-1][0] - MARGIN if len(self.rows) == self.k else 0.0

    def add(self, scores: list[float], names: list) -> None:
        self.rows = sorted(self.rows + [(round(s, DIGITS), n, s) for s, n in zip(scores, names)], key=lambda r: (-r[0], r[1]))[: self.k]


def score_span(span: Span, question: Question, best: Best) -> int:
    """Put the span's rows among the question's best. Returns how many postings were read.

    Terms come by what they can add; where all of them together can't reach the k-th best, the span is skipped. Terms
    behind which the rest can't reach it alone choose the candidates; the others are looked up for those.
    """
    held = sorted(((w * span.most(t) if w > 0 else 0.0, t, w) for t, w in zip(question.terms, question.weights) if t in span.blocks), reverse=True)
    rest = np.append(np.cumsum([h[0] for h in held][::-1])[::-1], 0.0)
    least = best.least
    if not held or rest[0] < least:
        return 0
    essential = next((i for i in range(len(held) + 1) if rest[i] < least), len(held))
    scores, read = np.zeros(1 << SPAN_BITS), 0
    for _, term, weight in held[:essential]:
        docs, impact = span.impacts(term)
        scores[docs] += weight * impact
        read += len(docs)
    left = np.flatnonzero(span.live & (scores != 0) & (scores + rest[essential] >= least))
    for i, (_, term, weight) in enumerate(held[essential:], essential):
        if not len(left):
            return read
        docs, impact = span.impacts(term)
        at = np.minimum(np.searchsorted(docs, left), len(docs) - 1)
        met = docs[at] == left
        scores[left[met]] += weight * impact[at[met]]
        read += len(left)
        left = left[scores[left] + rest[i + 1] >= least]
    left = left[scores[left] > 0]
    if len(left) > best.k:  # equal scores are told apart by name alone
        left = left[scores[left] >= np.partition(scores[left], -best.k)[-best.k] - MARGIN]
    best.add(scores[left].tolist(), [span.name[i] for i in left.tolist()])
    return read


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[Span]:
    """Spans one after another, from rows that are sorted by segment and span."""
    now, key = Span(), None
    for batch in batches:
        segments, spans, kinds, terms, max_tf, ratio = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("segment", "span", "kind", "code", "max_tf", "least_ratio"))
        docs, tfs, lengths = batch.column("docs"), batch.column("tfs"), batch.column("lengths")
        cut = lambda column: (column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False))
        (at, places), (at_tf, tf), (at_length, length) = cut(docs), cut(tfs), cut(lengths)
        for i in range(batch.num_rows):
            if (segments[i], spans[i]) != key:
                if key is not None:
                    yield now
                now, key = Span(), (segments[i], spans[i])
            own = places[at[i] : at[i + 1]]
            if kinds[i] == BLOCK:
                now.blocks.setdefault(int(terms[i]), []).append((own, tf[at_tf[i] : at_tf[i + 1]], int(max_tf[i]), float(ratio[i])))
            elif kinds[i] == NAMES:
                now.places.append(own)
                now.lengths.append(length[at_length[i] : at_length[i + 1]])
                now.ids.append(batch.column("ids")[i].as_py())
            elif kinds[i] == DEAD:
                now.dead.append(own)
            else:
                now.allowed = own
    if key is not None:
        yield now


def bm25(questions: DataFrame, index: LexicalIndex, k: int = POOL, id_col: str = "chunk_id", allowed: DataFrame | None = None) -> DataFrame:
    """question_id, id, score, rank: the k best rows of each question. `allowed` (id) narrows results, not statistics.

    Scores are rounded before they are ordered, ties by id. Only blocks of the questions' terms are read and shuffled, to
    their spans; a task hands on k rows a question. Many questions are asked in several passes.
    """
    spark = questions.sparkSession
    asked = question_terms(questions).join(index.weights.select("term", "idf"), "term")
    asked = asked.select("question_id", "term", (F.col("times") * F.col("idf")).alias("weight"), bucket("term").alias("bucket"))
    first = asked.limit(MAX_BROADCAST_TERMS + 1).collect()
    passes = [first]
    if len(first) > MAX_BROADCAST_TERMS:
        stored = written(asked, "question-terms")
        n = -(-stored.count() // MAX_BROADCAST_TERMS)
        passes = (stored.where(F.pmod(F.xxhash64("question_id"), F.lit(n)) == i).collect() for i in range(n))
    asked_type = questions.schema["question_id"].dataType.simpleString()
    found = [_bm25_pass(spark, rows, index, k, id_col, asked_type, allowed) for rows in passes]
    scored = reduce(DataFrame.unionByName, found).select("question_id", id_col, F.round("_score", DIGITS).alias("score")).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), id_col))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def _bm25_pass(spark: SparkSession, rows: list, index: LexicalIndex, k: int, id_col: str, asked_type: str, allowed: DataFrame | None) -> DataFrame:
    """question_id, id, _score for questions' terms (question_id, term, weight, bucket) that fit a broadcast."""
    id_type = index.segments[0].id_type
    codes: dict[str, int] = {}
    own: dict = {}
    for r in rows:
        terms, weights = own.setdefault(r.question_id, ([], []))
        terms.append(codes.setdefault(r.term, len(codes)))
        weights.append(r.weight)
    shared = spark.sparkContext.broadcast([Question(i, *tw) for i, tw in enumerate(own.values())])
    wanted = spark.createDataFrame(pa.table({"term": pa.array(codes, pa.string()), "code": pa.array(codes.values(), pa.int32())}))
    blocks = index.read("blocks").where(F.col("bucket").isin(sorted({r.bucket for r in rows})))
    met = blocks.join(F.broadcast(wanted), "term").select("segment", "span", F.lit(BLOCK).alias("kind"), "code", "docs", "tfs", "max_tf", "least_ratio")
    names = index.read("names").select("segment", "span", F.lit(NAMES).alias("kind"), "docs", "ids", "lengths")
    met = met.unionByName(names, allowMissingColumns=True)
    if len(index.segments) > 1:
        met = met.unionByName(dead_places(index).withColumn("kind", F.lit(DEAD)), allowMissingColumns=True)
    if allowed is not None:
        placed = index.read("names").select("segment", "span", F.inline(F.arrays_zip(F.col("docs").alias("pos"), F.col("ids").alias("id"))))
        kept = placed.join(allowed.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
        lists = kept.groupBy("segment", "span").agg(F.collect_list("pos").alias("docs"))  # a span's at most
        met = met.unionByName(lists.withColumn("kind", F.lit(ALLOWED)), allowMissingColumns=True)
    average, everything = index.total_length / max(index.rows, 1), allowed is None
    # blocks are few bytes, which would be put in few tasks; what many questions ask of them is not little work
    tasks = max(spark.sparkContext.defaultParallelism, min(int(spark.conf.get("spark.sql.shuffle.partitions")), index.rows >> SPAN_BITS))
    arrow = ARROW.get(id_type, pa.int64())

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        best = [Best(k) for _ in asked]
        for span in _gathered(batches):
            span.ready(average, everything)
            for q in asked:
                score_span(span, q, best[q.number])
        found = [(q.number, name, score) for q in asked for _, name, score in best[q.number].rows]
        columns = list(zip(*found)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), arrow, pa.float64()))], ["q", id_col, "_score"])

    dealt = met.select("segment", "span", "kind", "code", "docs", "tfs", "max_tf", "least_ratio", "ids", "lengths").repartition(tasks, "segment", "span").sortWithinPartitions("segment", "span")
    hits = dealt.mapInArrow(search, f"q int, {id_col} {id_type}, _score double")
    numbers = spark.createDataFrame(pa.table({"q": pa.array(range(len(own)), pa.int32()), "question_id": pa.array(own, ARROW.get(asked_type, pa.int64()))}))
    return hits.join(F.broadcast(numbers), "q").select("question_id", id_col, "_score")
