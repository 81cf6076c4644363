"""The evaluation matrix: one job for all presets equals a job for each, summaries equal SQL over the stored results."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from scrivia.operators import answering as A
from scrivia.operators import chunking as C
from scrivia.operators import evaluation as E
from scrivia.operators.agent import ask
from scrivia.operators.lineage import scratch, shared_path, written


@pytest.fixture(scope="module")
def library(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(60)
    docs = d.select(F.concat(F.lit("doc_"), F.col("doc_id")).alias("document_id"), F.concat(F.col("doc_id"), F.lit(".txt")).alias("filename"), "text")
    cut = F.split("text", r"(?<=[.!?])\s+")
    items = d.orderBy(F.desc(F.length("text"))).limit(6).select(F.col("doc_id").alias("question_id"), F.get(cut, 1).alias("question"), F.array(F.concat(F.lit("doc_"), F.col("doc_id"))).alias("expected"))
    other = spark.createDataFrame([(-1, "Which quarterly zebra revenue was never reported?", None), (-2, "", None)], "question_id long, question string, expected array<string>")
    return written(docs, "docs"), written(items.unionByName(other).withColumn("reference_answer", F.col("question")), "items")


@pytest.fixture(scope="module")
def results(spark, library):
    docs, items = library
    rows, copies = E.run_rechunked(items, docs, {"recursive": C.recursive_chunks, "semantic": C.semantic_chunks}, "own")
    return rows, copies


def test_matrix_equals_one_run_a_preset(spark, library, results):
    docs, items = library
    within = E.rechunked(docs, C.recursive_chunks)
    for name in ("dense", "hybrid+rerank", "agentic"):
        preset = E.PRESETS[name]
        alone = {r.question_id: r.answer for r in ask(items.select("question_id", "question"), within, preset.options, preset.mode).collect()}
        assert alone == {r.question_id: r.answer for r in results[0].where(F.col("config") == f"recursive / {name}").collect()}
    assert results[0].count() == 8 * 8 and results[0].select("config", "question_id").distinct().count() == 64


def test_summaries_equal_sql(results):
    stored = results[0].toPandas()  # noqa: F841
    sql = """SELECT config, round_even(avg(hit::INT), 4), round_even(avg(rr), 4), round_even(avg(faithfulness), 4), round_even(avg(relevance), 4),
             round_even(avg(correctness), 4), round_even(sum(cost_usd), 5), count(*) FILTER (failed) FROM stored GROUP BY 1"""
    plain = lambda rows: sorted(tuple(None if x is None else round(x, 4) if isinstance(x, float) else x for x in r) for r in rows)
    summary = A.summarize(results[0])
    assert plain(map(tuple, summary.drop("latency_ms").collect())) == plain(duckdb.sql(sql).fetchall())
    best = {r.metric: r.best for r in A.best_values(summary, {"rr": True, "faithfulness": True, "cost_usd": False}).collect()}
    values = [r.rr for r in summary.collect()]
    assert best["rr"] == (max(values) if min(values) < max(values) else None) and best["cost_usd"] is None
    cost = E.run_cost(summary, results[0].select(F.lit(0.001).alias("cost_usd"))).first()[0]
    assert cost == pytest.approx(64 * 0.001)
    assert all(r.line.startswith(f"| {r.config} | ") for r in A.report_lines(summary).collect())


def test_copies_are_hidden_and_dropped(spark, results):
    rows = results[1].collect()
    assert [(r.collection_id, r.hidden, r.status) for r in rows] == [("own--eval-recursive", True, "dropped"), ("own--eval-semantic", True, "dropped")]
    top = os.path.dirname(shared_path(spark, "x"))
    assert not any(name.startswith("evaluation-copies") for name in os.listdir(top))


def test_scratch_folders_stand_alone(spark):
    with scratch(spark, "outer") as outer:
        kept = written(spark.range(5), "kept")
        with scratch(spark, "inner") as inner:
            written(spark.range(3), "gone")
            assert inner.startswith(outer) and os.path.isdir(inner)
        assert not os.path.exists(inner) and kept.count() == 5
    assert not os.path.exists(outer)
