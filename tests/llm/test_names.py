"""Columns of the input with the names that operators use inside stay as they are."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scrivia.llm import langid, quality, url_filter

NAMES = ["_row", "_digest", "_short", "_best", "_own", "_judged", "_base", "_counts", "_rule", "_verdict", "_host_length", "_rule_digest", "a.b"]


def clashing(df):
    return df.withColumns({n: F.lit(f"{n} of the table") for n in NAMES})


def stay(df, n):
    rows = df.select(*[F.col(f"`{c}`") for c in NAMES]).collect()
    assert len(rows) == n and all(tuple(r) == tuple(f"{c} of the table" for c in NAMES) for r in rows)


def test_url_filters(spark):
    urls = clashing(spark.createDataFrame([(1, "http://a.net/x"), (1, "http://a.net/x"), (2, None), (3, "http://b.org/fr/y")], "page_id long, url string"))
    got = url_filter.filter_urls(urls, url_filter.rule_table(spark))
    stay(got, 4)
    assert sorted((r.page_id, r.rule or "") for r in got.collect()) == [(1, "net/"), (1, "net/"), (2, ""), (3, "org/fr/")]
    stay(url_filter.filter_urls(urls, url_filter.rule_table(spark, []) if False else url_filter.rule_table(spark).where("false")), 4)
    assert url_filter.filter_urls(urls.where("false"), url_filter.rule_table(spark)).count() == 0


def test_language(spark):
    docs = spark.createDataFrame([(i, "the cat sat on the mat " * 9 if i % 2 else "la casa de la playa es " * 9, "en" if i % 2 else "es") for i in range(60)], "doc_id long, text string, lang string")
    got = langid.identify(clashing(docs.drop("lang")), langid.train(docs))
    stay(got, 60)
    assert langid.identify(clashing(docs.where("false")), langid.train(docs)).count() == 0


def test_quality(spark, odd_documents):
    stay(quality.with_counts(clashing(odd_documents)), odd_documents.count())
    assert quality.kept_documents(clashing(odd_documents).where("false")).count() == 0


@pytest.mark.parametrize("n", [0, 1])
def test_a_stage_called_twice_before_it_is_written(spark, sf_dir, n):
    """Neither call loses what it put by; the next stage clears up behind both."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = corpus_pipeline.STAGES[n][1]
    first, second = stage(spark, docs, sf_dir), stage(spark, docs, sf_dir)
    assert first.count() == second.count() > 0


def test_a_run_of_null_and_repeated_ids(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    again = docs.where("doc_id < 40").withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.lit(None).cast("long")).otherwise(F.lit(3).cast("long")))
    docs.unionByName(again).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    one, two = corpus_pipeline.run(spark, str(tmp_path)), corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())) != []
