"""Files, golden sets and sinks."""

import json

from pyspark.sql import functions as F

from scrivia.sources import corpus, sinks


def test_inventory_and_text_documents(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "a" / "guide.md").write_text("intro\r\n# The guide  \n\n\n\ntext")
    (tmp_path / "a" / "x.exe").write_text("no")
    (tmp_path / ".hidden" / "b.md").write_text("no")
    assert [r.name for r in corpus.inventory(spark, f"file://{tmp_path}").collect()] == ["guide.md"]
    rows = corpus.text_documents(spark, f"file://{tmp_path}/a/guide.md").collect()
    assert [(r.title, r.page) for r in rows] == [("The guide", 1)]
    assert "\r" not in rows[0].text and "\n\n\n" not in rows[0].text


def test_golden_set(spark, tmp_path):
    items = [{"question": "What is it?", "expected_page": 2}, {"question": "?"}, {"question": "Who?", "expected_page": 0}]
    (tmp_path / "g.json").write_text(json.dumps(items))
    (tmp_path / "g.jsonl").write_text("\n".join(map(json.dumps, items)))
    for name, lines in (("g.json", False), ("g.jsonl", True)):
        ok, bad = corpus.golden_set(spark, f"file://{tmp_path}/{name}", lines)
        assert [r.question for r in ok.collect()] == ["What is it?"] and bad.count() == 2


def test_content_is_replaced_by_bucket(spark, tmp_path):
    path = f"file://{tmp_path}/content"
    df = spark.createDataFrame([(f"d{i}", i) for i in range(50)], "document_id string, v int")
    sinks.write_content(df, path, buckets=8)
    bucket = F.pmod(F.xxhash64("document_id"), F.lit(8))
    one = df.where(bucket == 3).withColumn("v", F.col("v") + 100)
    sinks.write_content(one, path, buckets=8)
    got = {r.document_id: r.v for r in spark.read.parquet(path).collect()}
    changed = {r.document_id for r in one.collect()}
    assert len(got) == 50 and changed and all(got[f"d{i}"] == i + 100 * (f"d{i}" in changed) for i in range(50))
    # one document of a bucket: its rows are replaced, those of the others stay
    sinks.write_content(spark.createDataFrame([("d7", -1), ("d7", -2), ("new", 5)], "document_id string, v int"), path, buckets=8)
    after = sorted((r.document_id, r.v) for r in spark.read.parquet(path).collect())
    assert after == sorted([(d, v) for d, v in got.items() if d != "d7"] + [("d7", -1), ("d7", -2), ("new", 5)])


def test_failed_ingest_keeps_no_content(spark):
    content = spark.createDataFrame([("a", 1), ("b", 2)], "document_id string, v int")
    outcome = spark.createDataFrame([("a", "ready"), ("b", "failed")], "document_id string, status string")
    assert [r.document_id for r in sinks.succeeded_content(content, outcome).collect()] == ["a"]


def test_log_and_report(spark, tmp_path):
    log = spark.createDataFrame([("2026-01-02 10:00:00", 1)], "t string, n int").select(F.to_timestamp("t").alias("created_at"), "n")
    sinks.append_log(log, f"file://{tmp_path}/log")
    sinks.append_log(log, f"file://{tmp_path}/log")
    assert spark.read.parquet(f"file://{tmp_path}/log").count() == 2
    lines = spark.createDataFrame([("a", "| a |")], "config string, line string")
    sinks.write_report(lines, log, f"file://{tmp_path}/report")
    assert spark.read.text(f"file://{tmp_path}/report/table").first().value == "| a |"
