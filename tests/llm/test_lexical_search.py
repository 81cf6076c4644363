"""Ranked search against scores of all documents, worked out one by one."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scrivia.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(docs, items, k=10):
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df, out = Counter(t for _, c in held for t in c), []
    for item_id, text in items:
        scored = []
        for doc_id, c in held:
            m = 25 + 75 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items):
    got = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("coordinates", [500_000, 30])
def test_search_equals_brute_force(spark, monkeypatch, coordinates):
    monkeypatch.setattr(lexical_search, "BLOCK_COORDINATES", coordinates)
    rnd = random.Random(3)
    words = [f"{rnd.choice('abcdÉéZz')}{i}" for i in range(60)]
    text = lambda most: " ".join(words[int(60 * rnd.random() ** 3)] for _ in range(rnd.randint(0, most)))
    docs = [(i // 2 if i % 9 else None, text(rnd.choice([3, 40, 400]))) for i in range(500)]
    items = [(i // 3, text(30)) for i in range(12)]
    assert found(spark, docs, items) == brute_force(docs, items)


def test_odd_texts(spark):
    docs = [(1, None), (2, ""), (3, "  \n"), (4, "Ünï 日本 a_b A"), (4, "ünï a"), (5, "a " * 50_000), (6, "x" * 100_000), (None, "a b"), (8, "É a"), (8, "É a")]
    items = [(1, None), (None, "a"), (3, "?!"), (4, "a a É b Ünï " + "x" * 100_000), (4, "nothing here"), (6, "日本")]
    assert found(spark, docs, items) == brute_force(docs, items)
    assert found(spark, docs, []) == found(spark, [], items) == []
    clashing = spark.createDataFrame(docs, "doc_id long, text string").withColumns({n: F.lit(1) for n in ("n", "terms", "tfs", "item", "score", "rank", "item_id")})
    assert lexical_search.search(clashing, spark.createDataFrame(items, "item_id long, text string")).count() == len(brute_force(docs, items))


def test_bounds_rule_documents_out(spark, sf_dir, monkeypatch):
    """Blocks searched in this process: few buckets are read whole, few documents are scored."""
    monkeypatch.setattr(lexical_search, "BUCKET", 32)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [Counter(lexical_search.terms_of(r.text.encode())) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    vocabulary = sorted(set().union(*items))
    vectors = lexical_search.term_vectors(docs, vocabulary, "doc_id", "text").toArrow()
    holding = Counter(t for row in vectors["terms"].to_pylist() for t in row)
    weights = lexical_search.np.array([lexical_search.weight(len(vectors), holding[i]) for i in range(len(vocabulary))])
    block = lexical_search.Block(vectors, weights, len(vectors), sum(vectors["n"].to_pylist()))
    assert len(block.buckets) > 5
    scored = 0
    for terms_held in items:
        at = lexical_search.np.array([vocabulary.index(t) for t in terms_held])
        item, exact = lexical_search.Item(at, lexical_search.np.array(list(terms_held.values())), weights, 10), lexical_search.np.zeros(len(weights), int)
        exact[item.terms] = item.exact
        add = item.add

        def counted(scores, ids, nulls, add=add):
            nonlocal scored
            scored += len(scores)
            add(scores, ids, nulls)

        item.add = counted
        block.search(item, exact)
    assert scored < 0.5 * len(items) * len(vectors)
