"""Streams write their rows to the shared folder and not to the driver."""

import tempfile
import time

from pyspark.sql import functions as F

from scrivia.plans import q_chunks
from scrivia.streaming import streams


def test_run_returns_written_rows(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    for start in (0, 50):  # two batches
        spark.range(start, start + 100).coalesce(1).write.mode("append").parquet(folder)
    read = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(folder)
    counts = q_chunks._run(read().groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")), "t_complete", "complete")
    assert counts.inputFiles() and counts.columns == ["k", "n"]
    assert counts.count() == 7 and counts.agg(F.sum("n")).first()[0] == 200
    rows = q_chunks._run(read(), "t_append", "append")
    assert rows.inputFiles() and rows.count() == 200
    assert q_chunks._run(read().where("false"), "t_none", "append").count() == 0


def test_budget_counts_late_events_when_they_arrive(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    batches = [[(1, 5, 4.0), (1, 7, 4.0), (2, 1, 1.0)], [(1, 2, 4.0), (1, 3, 1.0), (2, 0, 1.0)]]  # the second is older
    for rows in batches:
        spark.createDataFrame(rows, "key long, event_id long, cost_usd double").coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are read in the order of their times
    stream = spark.readStream.schema("key long, event_id long, cost_usd double").option("maxFilesPerTrigger", 1).parquet(folder)
    got = {(r.key, r.event_id): r.over for r in q_chunks._run(streams.budget_guard(stream, 10.0), "t_budget", "append").collect()}
    assert got == {(1, 5): False, (1, 7): False, (1, 2): True, (2, 1): False, (2, 0): False}


def test_windows_are_told_once_and_late_rows_go(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    batches = [["2026-01-01 10:00", "2026-01-02 12:00"], ["2026-01-03 00:30"], ["2026-01-01 11:00", "2026-01-04 00:30"]]  # 11:00 is late
    for rows in batches:
        df = spark.createDataFrame([(t, 0.5, 10) for t in rows], "t string, cost_usd double, latency_ms long")
        df.select(F.to_timestamp("t").alias("created_at"), "cost_usd", "latency_ms").coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    stream = spark.readStream.schema("created_at timestamp, cost_usd double, latency_ms long").option("maxFilesPerTrigger", 1).parquet(folder)
    got = q_chunks._run(streams.usage_windows(stream), "t_usage", "append").collect()
    assert sorted((str(r.start.date()), r.queries) for r in got) == [("2026-01-01", 1), ("2026-01-02", 1)]


def test_streams_read_tables_of_one_file_and_of_many(spark, sf_dir):
    folder = tempfile.mkdtemp(prefix="spark-")
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    documents.repartition(3).write.parquet(f"{folder}/documents.parquet")
    wanted = documents.select(F.sha2(F.col("text").cast("binary"), 256)).distinct().count()
    for sf in (sf_dir, folder):
        assert q_chunks.stream_ingest(spark, sf).count() == wanted
        assert q_chunks.stream_entities(spark, sf).count() > 0
