"""The block index against a full scan: rankings, segments, statistics, and what is read."""

import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrivia.functions import text as T
from scrivia.operators import lexical as L

WORDS = [f"w{i}" for i in range(80)]


def texts(rnd, n, key=int):
    cut = lambda: " ".join(WORDS[int(80 * rnd.random() ** 3)] for _ in range(rnd.choice([0, 3, 30, 200])))
    return {key(i): cut() for i in range(n)}


def frame(spark, rows, kind="long"):
    return spark.createDataFrame(list(rows.items()), f"chunk_id {kind}, text string").withColumn("term", F.lit("of the table"))


def full_scan(docs, asked, k, allowed=None):
    cut = {i: t.split() or ["_"] for i, t in docs.items()}
    n, average = len(cut), sum(map(len, cut.values())) / len(cut)
    df = Counter(w for ws in cut.values() for w in set(ws))
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: x if x >= 0 else 0.25 * mean for w, x in raw.items()}
    out = {}
    for q, text in asked.items():
        scores = {}
        for i, ws in cut.items():
            tf = Counter(ws)
            s = round(sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / average)) for w in text.split() if tf[w]), 6)
            if s > 0 and (allowed is None or i in allowed):
                scores[i] = s
        out[q] = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def ranked(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.question_id, []).append((r.rank, r.chunk_id, r.score))
    return {q: [(i, s) for _, i, s in sorted(rows)] for q, rows in out.items()}


def same(got, want):
    for q, rows in want.items():
        have = got.get(q, [])
        assert [i for i, _ in have] == [i for i, _ in rows], q
        assert all(abs(a - b) < 2e-6 for (_, a), (_, b) in zip(have, rows))


@pytest.fixture(scope="module")
def asked(spark):
    rnd = random.Random(2)
    q = {i: " ".join(rnd.choices(WORDS, k=rnd.choice([1, 4, 25]))) for i in range(25)}
    return q, spark.createDataFrame(list(q.items()), "question_id long, question string")


@pytest.mark.parametrize("kind", ["long", "string"])
def test_search_equals_full_scan(spark, asked, kind, monkeypatch):
    docs = texts(random.Random(1), 900, int if kind == "long" else "d{:04}".format)
    index = L.lexical_index(frame(spark, docs, kind))
    same(ranked(L.bm25(asked[1], index, 7)), full_scan(docs, asked[0], 7))
    some = sorted(docs)[::3]
    allowed = spark.createDataFrame([(i,) for i in some], f"chunk_id {kind}")
    same(ranked(L.bm25(asked[1], index, 7, allowed=allowed)), full_scan(docs, asked[0], 7, set(some)))
    monkeypatch.setattr(L, "MAX_BROADCAST_TERMS", 40)  # in several passes
    same(ranked(L.bm25(asked[1], index, 7)), full_scan(docs, asked[0], 7))


def test_refresh_adds_segments_and_leaves_the_others(spark, asked):
    rnd = random.Random(4)
    docs = texts(rnd, 400)
    index = L.lexical_index(frame(spark, docs))
    files = {s.path: sorted((d, f) for d, _, fs in os.walk(s.path) for f in fs) for s in index.segments}
    for step in range(3):
        new = texts(rnd, 60)
        changed = {i * 7 + step: t for i, t in new.items()}  # some are there, some are not, some changed before
        gone = [i for i in docs if i % 11 == step and i not in changed]
        docs = {i: t for i, t in (docs | changed).items() if i not in gone}
        index = L.refreshed_index(index, frame(spark, changed), spark.createDataFrame([(i,) for i in gone], "chunk_id long"))
        assert {p: sorted((d, f) for d, _, fs in os.walk(p) for f in fs) for p in files} == files
        same(ranked(L.bm25(asked[1], index, 9)), full_scan(docs, asked[0], 9))
    fresh = L.lexical_index(frame(spark, docs))
    told = lambda x: sorted((r.term, r.df, round(r.idf, 9), round(r.avg_length, 9)) for r in x.weights.collect())
    assert told(index) == told(fresh) and (index.rows, index.total_length) == (fresh.rows, fresh.total_length)


def test_version_follows_content(spark, asked):
    docs = texts(random.Random(6), 200)
    first = L.index_of_version(spark, "versions", frame(spark, docs))
    assert L.index_of_version(spark, "versions", frame(spark, docs).orderBy(F.desc("chunk_id"))) is first
    docs[5], docs[6] = "w1 w2 w3 changed", docs[5]  # as many rows as before
    second = L.index_of_version(spark, "versions", frame(spark, docs))
    assert len(second.segments) == 2 and second.segments[0] == first.segments[0]
    same(ranked(L.bm25(asked[1], second, 5)), full_scan(docs, asked[0], 5))
    del docs[9]
    third = L.index_of_version(spark, "versions", frame(spark, docs))
    assert third.rows == 199 and len(third.segments) == 3
    same(ranked(L.bm25(asked[1], third, 5)), full_scan(docs, asked[0], 5))


def test_search_reads_the_buckets_of_its_terms(spark):
    index = L.lexical_index(frame(spark, texts(random.Random(1), 300)))
    one = spark.createDataFrame([(1, "w3")], "question_id long, question string")
    plan = L.bm25(one, index)._jdf.queryExecution().executedPlan().toString()
    own = spark.range(1).select(L.bucket(F.lit("w3"))).first()[0]
    assert f"bucket IN ({own})" in plan.replace("#", " ") or f"= {own})" in plan
    assert sum(name.startswith("bucket=") for name in os.listdir(f"{index.segments[0].path}/made")) > 10


def test_bounds_skip_postings():
    """One rare term decides: the postings of frequent ones are looked up for candidates alone."""
    span, n = L.Span(), 4000
    everywhere = np.arange(n, dtype=np.int32)
    for term in range(5):
        span.blocks[term] = [(everywhere, np.ones(n, np.int32), 1, 50.0)]
    rare = np.arange(0, n, 200, dtype=np.int32)
    span.blocks[9] = [(rare, np.full(len(rare), 3, np.int32), 3, 17.0)]
    span.places, span.lengths, span.ids = [everywhere], [np.full(n, 50)], [list(range(n))]
    span.ready(50.0, True)
    best = L.Best(10)
    question = L.Question(0, [0, 1, 2, 3, 4, 9], [0.1, 0.1, 0.1, 0.1, 0.1, 6.0])
    assert L.score_span(span, question, best) > n  # nothing is known yet
    first = [r[1] for r in best.rows]
    assert L.score_span(span, question, L.Best(10)) > n and first == rare[:10].tolist()
    assert L.score_span(span, question, best) < 300  # the threshold of the first pass
    best.rows = [(100.0, 0, 100.0)] * 10
    assert L.score_span(span, question, best) == 0  # the whole span is skipped


def test_empty_and_odd(spark):
    none = L.lexical_index(spark.createDataFrame([], "chunk_id long, text string"))
    q = spark.createDataFrame([(1, "w1 w2"), (2, ""), (3, None)], "question_id long, question string")
    assert L.bm25(q, none).count() == 0 and none.rows == 0
    odd = {1: None, 2: "", 3: "the of", 4: "w1 " * 5000, 5: "w1 é w2", 6: "x" * 50_000}
    index = L.lexical_index(frame(spark, odd))
    assert index.rows == 6 and [r.chunk_id for r in L.bm25(q, index).where("question_id = 1").orderBy("rank").collect()] == [5, 4]
    assert L.bm25(q.where("false"), index).count() == 0
    assert sorted(r[0] for r in spark.range(1).select(F.explode(T.tokenize(F.lit("_ a_b")))).collect()) == ["b"]


def test_dead_postings_are_counted_once_a_span(spark):
    """Counts of dead postings a term, for blocks of spans with and without dead places; blocks of a span may be many."""
    rnd = random.Random(5)
    blocks = [(g, s, f"t{t}", sorted(rnd.sample(range(4096), rnd.choice([1, 9, 300])))) for g in (0, 1) for s in range(3) for t in range(120)]
    dead = [(0, 0, rnd.sample(range(4096), 2000)), (0, 2, [7]), (1, 1, list(range(4096)))]
    marked = {(g, s): set(d) for g, s, d in dead}
    wanted = Counter()
    for g, s, t, docs in blocks:
        wanted[t] -= len(marked.get((g, s), set()) & set(docs))
    taken = L._taken(
        spark.createDataFrame(blocks, "segment int, span long, term string, docs array<int>").repartition(5),
        spark.createDataFrame(dead, "segment int, span long, docs array<int>"),
    )
    assert "array_intersect" not in taken._jdf.queryExecution().toString()
    got = Counter()
    for r in taken.collect():
        got[r.term] += r.df
    assert got == wanted and all(n < 0 for n in got.values())
