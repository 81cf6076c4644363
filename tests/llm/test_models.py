"""Jaccard join, toxicity, language identification, pipeline."""

import itertools
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scrivia.llm import jaccard_join, langid, shingles, toxicity
from scrivia.llm.components import connected_components


def word_shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[ \t\n\x0b\f\r]", lower) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_components(rows):
    sets = [word_shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=repr)


def near_copies(seed=5):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = rng.choice(vocabulary, 120).tolist()
    passage = rng.choice(vocabulary, 60).tolist()
    rows = []
    for i in range(90):  # copies with more and more edits
        words = list(base)
        for _ in range(i // 12):
            words[rng.integers(120)] = f"e{rng.integers(10**6)}"
        rows.append((i, " ".join(words)))
    for i in range(90, 150):  # a passage that many share
        rows.append((i, " ".join(passage + rng.choice(vocabulary, int(rng.integers(0, 60))).tolist())))
    for i in range(150, 300):
        rows.append((i, " ".join(rng.choice(vocabulary, int(rng.integers(1, 90))).tolist())))
    return rows + [(i + 1000, t) for i, t in rows[:40]] + [(5, rows[200][1]), (None, rows[0][1]), (2000, None), (2001, ""), (2002, "A b"), (2003, "a B"), (2004, " \t")]


@pytest.mark.parametrize(("rounds", "known"), [(4, 400_000), (0, 400_000), (2, 10), (4, 0)])
def test_components_equal_brute_force(spark, monkeypatch, rounds, known):
    for name, value in [("SHORT_LIST", 3), ("CHUNK", 8), ("CELL_ROWS", 4), ("CELL_COLUMNS", 8), ("ROUNDS", rounds), ("FREQUENT_FROM", 6), ("MAX_FREQUENT", known)]:
        monkeypatch.setattr(jaccard_join, name, value)
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash"))
    got = sorted((tuple(r) for r in jaccard_join.similar_documents(df).collect()), key=repr)
    want = brute_components([(d, t) for d, t in rows])
    empty = {2000, 2001, 2004}
    assert got == sorted([(d, n, d if d in empty else c) for d, n, c in want], key=repr)
    assert jaccard_join.similar_documents(df.where("false")).count() == 0


def test_shingles_tell_words_apart():
    texts = [None, "", " \t", "A b", "a B", "a b c d e", "a b c d e\x85", "a\x0bb\x0cc\rd\ne", "é É 日本 a A z", "ab cd", "abc d", "x" * 3_000_000 + " a b c d e", "a b " * 9]
    texts += [f"w{i} w{i + 1} w{i + 2} w{i + 3} w{i + 4} w{i % 7}" for i in range(500)]
    sets = [s for at in (0, 5, 200) for s in shingles.shingle_sets(pa.array(texts[at : {0: 5, 5: 200, 200: None}[at]]))]
    of_hash, of_words = {}, {}
    for text, own in zip(texts, sets, strict=True):
        words = word_shingles(text)
        assert len(words) == len(own)
        for w, h in zip([tuple(sorted(words))], [tuple(own.tolist())]):
            assert of_hash.setdefault(h, w) == w and of_words.setdefault(w, h) == h


def test_levels_follow_the_cost():
    assert jaccard_join.choose_level(np.zeros(30, int), 6) == 1
    assert jaccard_join.choose_level(np.array([0] * 5 + [40] * 12), 6) > 1
    assert jaccard_join.choose_level(np.array([0] * 5 + [40] + [4000] * 9), 6) == 1
    assert jaccard_join.choose_level(np.array([50]), 1) == 1


def test_deduplicated_keeps_one_of_each(spark):
    rows = near_copies(6)
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows if d is not None], "doc_id long, text string, lang string, source string, n_chars long")
    kept = jaccard_join.deduplicated(df)
    components = {r.component_id for r in jaccard_join.similar_documents(df).where("n_shingles > 0").collect()}
    assert kept.columns == df.columns
    assert kept.where("trim(text) <> '' and text <> ' \t'").select("doc_id").distinct().count() == len(components)


def test_connected_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1001), (1001, 1000), (7, 7)]
    got = {r.id: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(201)} == {0} and got[1001] == 1000


def test_channel_restores_obfuscated_words():
    n = np.full((28, 28, 28), -6.0, np.float32)
    for word in ("idiot", "moron", "stupid"):
        k = [0, 0, *[ord(c) - 96 for c in word], 0]
        for a, b, c in zip(k, k[1:], k[2:]):
            n[a, b, c] = -0.5
    restorer = toxicity.Restorer(n.tobytes())
    for written in ("1d10t", "i.d.i.o.t", "id!ot", "idiiiot", "IDIOT.", "(idiot)", "idi*ot"):
        assert "idiot" in restorer.readings(written), written
    assert "idiot" in restorer.spaced("you i d i o t !") and "stupid" in restorer.readings("$tup1d")
    assert restorer.readings("plain,") == ["plain"] and restorer.readings("12345") == [] and restorer.readings("") == []


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = toxicity.op3_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scored)
    clean = [r for r in scored if r.toxic == 0]
    toxic = [r for r in scored if r.toxic == 1]
    assert sum(r.predicted for r in clean) <= 0.03 * len(clean)
    assert sum(r.predicted for r in toxic) >= 0.6 * len(toxic)


def test_toxicity_without_labels_and_odd_texts(spark, odd_documents):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(odd_documents, labels)
    assert not model.lexicon
    rows = toxicity.score_documents(odd_documents, model).collect()
    assert len(rows) == 10 and all(0 <= r.score < 0.5 for r in rows)
    assert toxicity.clean_documents(odd_documents, labels).columns == odd_documents.columns


def test_language_on_held_out_documents(spark, sf_dir, documents):
    rows = langid.op10_language_id(spark, sf_dir).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_texts(spark, documents, odd_documents):
    rows = langid.identify(odd_documents, langid.train(documents)).collect()
    assert len(rows) == 10
    for r in rows:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")), r.text
    assert {r.lang_pred for r in langid.identify(odd_documents, langid.train(documents.where("false"))).collect()} == {"und"}


def test_mixture_finds_two_languages():
    model = langid.Mixture(["a", "b"], np.zeros((2, langid.BUCKETS), np.float32).tobytes())
    logs = np.array([[-1.0, -30.0]] * 6 + [[-30.0, -1.0]] * 4)
    found = model.infer(logs, np.ones(10))
    assert found.lang == "a" and found.score == pytest.approx(0.6, abs=0.01)
    assert found.langs == ["a", "b"] and found.shares == pytest.approx([0.6, 0.4], abs=0.01)


def best_set(logs, times, langs):
    """By plain loops: proportions of every set of languages, and the set with the best penalised likelihood."""
    every = []
    for size in range(1, len(langs) + 1):
        for members in itertools.combinations(range(len(langs)), size):
            share = {m: 1 / size for m in members}
            for _ in range(300):
                new = dict.fromkeys(members, 0.0)
                for row, n in zip(logs, times):
                    total = sum(share[m] * math.exp(row[m]) for m in members)
                    for m in members:
                        new[m] += n * share[m] * math.exp(row[m]) / total / sum(times)
                share = new
            value = sum(n * math.log(sum(share[m] * math.exp(row[m]) for m in members)) for row, n in zip(logs, times))
            every.append((value - langid.PENALTY * math.log(sum(times) + 1) * (size - 1), {langs[m]: s for m, s in share.items()}))
    return max(every, key=lambda e: e[0])


def test_mixture_equals_the_best_of_all_sets():
    rng, langs = np.random.default_rng(11), ["a", "b", "c"]
    model = langid.Mixture(langs, np.zeros((3, langid.BUCKETS), np.float32).tobytes())
    sizes = set()
    for true in ([1, 0, 0], [0.7, 0.3, 0], [0.4, 0.3, 0.3], [0, 0.05, 0.95], [0.5, 0, 0.5]) * 3:
        own = rng.choice(3, 60, p=true)
        logs = rng.normal(-14, 2, (60, 3))
        logs[np.arange(60), own] += 7
        times = rng.integers(1, 4, 60).astype(float)
        found = model.infer(logs, times)
        want = best_set(logs.tolist(), times.tolist(), langs)[1]
        assert set(found.langs) == set(want)
        assert found.shares == pytest.approx([want[x] for x in found.langs], abs=0.02) and found.lang == max(want, key=want.get)
        sizes.add(len(want))
    assert sizes == {1, 2, 3}


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    rows = [(i, "some words here", f"l{i % 3}") for i in range(30)]
    with pytest.raises(ValueError, match="more than 2"):
        langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
