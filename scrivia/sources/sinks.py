"""Sinks: content by document bucket, query log by day, reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivia.operators.lineage import written
from scrivia.operators.registry import replace_content

BUCKETS = 64


def write_content(df: DataFrame, path: str, key: str = "document_id", buckets: int = BUCKETS) -> None:
    """Replace the stored content of the documents of `df`, and keep that of all others.

    Only the buckets that hold these documents are rewritten: their other documents are read and written with the new
    rows, first to the shared folder, since a bucket cannot be overwritten while it is read.
    """
    spark = df.sparkSession
    fresh = df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    if _exists(spark, path):
        stored = spark.read.parquet(path).withColumn("bucket", F.col("bucket").cast("int"))
        touched = stored.join(F.broadcast(fresh.select("bucket").distinct()), "bucket", "left_semi")  # `buckets` rows at most
        fresh = replace_content(touched.select(*fresh.columns), fresh, key)
    fresh = written(fresh, "content")
    fresh.repartition("bucket", key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        return bool(spark.read.parquet(path).columns)
    except AnalysisException:
        return False


def succeeded_content(content: DataFrame, outcome: DataFrame) -> DataFrame:
    """Content of the documents whose ingest succeeded; the others keep their status row alone."""
    return content.join(outcome.where("status = 'ready'").select("document_id"), "document_id", "left_semi")


def append_log(df: DataFrame, path: str, at: str = "created_at") -> None:
    df.withColumn("day", F.to_date(at)).write.mode("append").partitionBy("day").parquet(path)


def write_report(lines: DataFrame, results: DataFrame, path: str) -> None:
    lines.orderBy("config").select("line").coalesce(1).write.mode("overwrite").text(f"{path}/table")
    results.write.mode("overwrite").json(f"{path}/results")
