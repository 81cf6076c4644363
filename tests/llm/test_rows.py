"""URL filters, mixing, search, quality rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrivia.llm import mixing, quality, top_k_search, url_filter
from scrivia.llm.common import stash
from scrivia.operators.lineage import scratch


def test_url_filter_rules_and_odd_urls(spark):
    urls = [
        (1, "http://A.Example.NET/en/x?q#f"), (2, "https://example.net"), (3, "http://net/"), (4, "ftp://x.org/fr/#"), (5, None), (6, "nothing"), (7, "http://"),
        (8, "http://www.example.com/de/1"), (9, "http://notexample.com/de/1"), (10, "http://a.net?/en/"), (11, "x://y://z.net/"), (3, "http://net/"),
    ]
    df = spark.createDataFrame([(i, u, "own") for i, u in urls], "page_id long, url string, verdict string")
    got = url_filter.filter_urls(df, url_filter.rule_table(spark)).collect()
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert len(got) == 12 and "verdict" in got[0].asDict()
    assert by[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert by[2] == ("example.net", "", None, "allow")
    assert by[3] == ("net", "/", "net/", "block")
    assert by[4] == ("x.org", "/fr/", "org/fr/", "allow")
    assert by[5] == by[6] == by[7] == ("", "", None, "allow")
    assert by[8][2:] == ("example.com/de/", "block") and by[9][2:] == (None, "allow")
    assert by[10] == ("a.net", "", None, "allow")
    assert by[11][0] == "y:"
    none = url_filter.filter_urls(df, url_filter.rule_table(spark).where("false"))
    assert {r.verdict for r in none.collect()} == {"allow"}
    assert url_filter.filter_urls(df.where("false"), url_filter.rule_table(spark)).count() == 0


def test_targets_stop_at_three_times_the_size(spark):
    sizes = [("a", 1000), ("b", 10), ("c", 5), (None, 985)]
    rows = {r.source: r for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    assert rows[None].source_no == 4 and rows[None].weight == 1
    assert abs(sum(r.target for r in rows.values()) - 2000) < 1e-6
    assert rows["b"].target == 30 and rows["c"].target == 15
    assert abs(rows["a"].target - rows[None].target) < 1e-6  # equal weights, neither full


def test_indices_are_permuted(spark):
    for n in (1, 2, 7, 128, 1000):
        own = F.lit(3).cast("long"), F.lit(n).cast("long")
        rows = spark.range(n).crossJoin(spark.range(2).withColumnRenamed("id", "epoch"))
        x = mixing._permuted(F.col("id"), own[1], own[0], F.col("epoch"), mixing._round_keys(*own))
        got = [[r.x for r in rows.where(f"epoch = {e}").select("id", x.alias("x")).orderBy("id").collect()] for e in (0, 1)]
        assert sorted(got[0]) == sorted(got[1]) == list(range(n))
        if n == 1000:
            steps = {(b - a) % n for a, b in zip(got[0], got[0][1:])}
            assert len(steps) > 300 and sum(a == b for a, b in zip(*got)) < 20


def test_mixing_counts(spark, documents, odd_documents):
    mix = mixing.mix_sources(documents)
    rows = mix.documents.collect()
    assert len(rows) == documents.count()
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    targets = {(r.target, r.source_size): 0 for r in rows}
    for r in rows:
        targets[(r.target, r.source_size)] += r.taken
    for (target, size), taken in targets.items():
        assert abs(taken - target) <= 4 * mixing.BLOCK_WORDS + 0.05 * target
    again = mixing.mix_sources(documents.repartition(7)).documents.collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    odd = mixing.mix_sources(odd_documents).documents.collect()
    assert len(odd) == 10 and all(r.taken <= 3 * r.size for r in odd)
    assert mixing.mix_sources(odd_documents.where("false")).documents.count() == 0


def test_mixed_documents_hold_the_words_taken(spark, documents):
    want = sum(r.taken for r in mixing.mix_sources(documents).documents.collect())
    mixed = mixing.mixed_documents(documents)
    assert mixed.columns == documents.columns
    assert mixed.select(mixing.word_count(mixed.text).alias("n")).agg({"n": "sum"}).first()[0] == want


@pytest.mark.parametrize(("block", "sample"), [(8192, 4096), (64, 90), (64, 5)])
def test_search_equals_brute_force(spark, monkeypatch, block, sample):
    monkeypatch.setattr(top_k_search, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(top_k_search, "QUERY_BLOCK", 8)
    monkeypatch.setattr(top_k_search, "SAMPLE", sample)
    rng = np.random.default_rng(3)
    vectors = np.floor(20 * rng.standard_normal((700, 12)))
    vectors[200:260] = vectors[0]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, None), (901, [1.0, None]), (902, [float("nan")] * 12), (None, [1.0] * 12), (903, [1.0, 2.0]), (904, [])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = top_k_search.top_k(df.where("id % 50 = 0 or id >= 900"), df, 7).collect()
    for q in range(0, 700, 50):
        score = vectors @ vectors[q]
        want = sorted(((-s, i) for i, s in enumerate(score) if i != q))[:7]
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [(i, -s) for s, i in want]
    assert not [r for r in got if r.query_id >= 900]
    assert top_k_search.top_k(df.where("false"), df).count() == 0


def test_stashes_of_a_scope_go_when_it_is_entered_again(spark):
    with scratch(spark, "t") as folder:
        first = stash(spark.range(3), "first")
        assert first.count() == 3 and all(f.split("://")[-1].removeprefix("file:").startswith(folder) for f in first.inputFiles())
    other = stash(spark.range(4), "other")
    assert other.count() == 4


def test_base_counts():
    text = "a b c d\na b c d\n\nx # $ y\nx # $ y\n"
    n_words, word_chars, n_symbols, n_lines, n_dup, n_repeat = quality.base_counts(text)
    assert (n_words, word_chars, n_symbols, n_lines, n_dup) == (16, 16, 4, 4, 2)
    words = text.split()
    windows = [tuple(words[i : i + 3]) for i in range(14)]
    assert n_repeat == len({j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)})
    assert quality.base_counts("") == (0, 0, 0, 0, 0, 0)
    assert quality.repeated_words(["a"] * 5) == 5


def counted_rows(spark, rows):
    schema = "lang string, source string, symbol_ratio int, word_length int"
    rooms = ["12 room_symbol_ratio", "300 room_dup_line_ratio", "150 room_repeat_ratio"]
    return spark.createDataFrame(rows, schema).selectExpr("*", "0 dup_line_ratio", "0 repeat_ratio", *rooms, "false base_failed")


def test_thresholds_follow_groups_and_ignore_a_third_of_junk(spark):
    words = lambda mean, n: [mean - 20 + i % 41 for i in range(n)]
    rows = [("en", "s", 0, w) for w in words(500, 200)] + [("en", "s", 330, 800)] * 99 + [("en", "t", 330, 800)] * 3 + [("de", "s", 0, w) for w in words(600, 200)]
    df = counted_rows(spark, rows)
    limits = {(r.lang, r.source): r for r in quality.group_thresholds(quality.sketches(df)).collect()}
    # halfway to those with symbols, t by its language; where none has any, the room of a short text
    assert limits["en", "s"].most_symbol_ratio == limits["en", "t"].most_symbol_ratio == 165 and limits["de", "s"].most_symbol_ratio == 12
    assert limits["en", "s"].most_word_length < 790 and limits["de", "s"].most_word_length > limits["en", "s"].most_word_length
    kept = quality.judge(df, quality.group_thresholds(quality.sketches(df)))
    assert kept.where("kept").count() == 400 and kept.where("kept and symbol_ratio > 0").count() == 0
    base = df.withColumn("base_failed", F.lit(True))
    assert quality.judge(base, quality.group_thresholds(quality.sketches(base))).where("kept").count() == 0


def test_small_groups_borrow_from_language_then_source(spark):
    rows = [("en", "s", 0, 500)] * 120 + [("en", "t", 0, 900)] * 5 + [("fr", "s", 0, 900)] * 5 + [("de", "u", 0, 900)] * 5 + [(None, None, 0, 900)]
    limits = {(r.lang, r.source): r for r in quality.group_thresholds(quality.sketches(counted_rows(spark, rows))).collect()}
    levels = {k: r.level for k, r in limits.items()}
    assert levels == {("en", "s"): "own", ("en", "t"): "of_lang", ("fr", "s"): "of_source", ("de", "u"): "of_all", (None, None): "of_all"}
    assert len({r.most_word_length for r in limits.values()}) == 1  # all of them have the 120 in their sketch


def test_varying_limits_decide_on_the_large_table(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    counted = quality.with_counts(docs).drop("text").where("not base_failed").persist()
    limits = quality.group_thresholds(quality.sketches(counted)).collect()
    for m in quality.METRICS:  # no limit is one value for all groups
        assert len({r[f"most_{m}"] for r in limits}) >= 5, m
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    judged = quality.judge(counted, spark.createDataFrame(limits)).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in judged}
    assert kept[1] >= 0.995 and kept[0] <= 0.01
    counted.unpersist()


def test_limits_differ_between_groups_and_keep_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    limits = quality.group_thresholds(quality.sketches(quality.with_counts(docs))).collect()
    assert len({(r.least_word_length, r.most_word_length, r.most_repeat_ratio) for r in limits}) >= 4
    labelled = quality.op8_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed")
    kept = {r.quality: (r.kept, r.n) for r in labelled.groupBy("quality").agg(F.count_if("kept").alias("kept"), F.count("*").alias("n")).collect()}
    assert kept[1][0] >= 0.99 * kept[1][1] and kept[0][0] <= 0.2 * kept[0][1]


def test_quality_of_odd_texts(spark, odd_documents):
    kept = quality.kept_documents(odd_documents)
    assert kept.columns == odd_documents.columns
    assert kept.where("text is null or length(text) < 100").count() == 0
    assert quality.kept_documents(odd_documents.where("false")).count() == 0
