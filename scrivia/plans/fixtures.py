"""Model tables derived from the driver's tables; every derivation is also plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivia.functions.text import STOPWORDS, TOKEN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One registered document for each row of `documents`; the collection is the language."""
    d = table(spark, sf_dir, "documents")
    status = (
        F.when(F.col("doc_id") % 17 == 0, "failed").when(F.col("doc_id") % 13 == 0, "staged")
        .when(F.col("doc_id") % 19 == 0, "processing").when(F.col("doc_id") % 23 == 0, "queued").otherwise("ready")
    )
    return d.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("document_id"),
        F.col("lang").alias("collection_id"),
        F.concat_ws("_", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("filename"),
        status.alias("status"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
        F.octet_length("text").alias("size"),
        (F.floor(F.col("n_chars") / 3500) + 1).cast("int").alias("pages"),
        (F.col("n_chars") * 0.001).alias("cost_usd"),
        "doc_id",
        "text",
    )


SQL_REGISTRY = """
registry AS (
  SELECT 'doc_' || doc_id AS document_id, lang AS collection_id, source || '_' || doc_id || '.txt' AS filename,
         CASE WHEN doc_id % 17 = 0 THEN 'failed' WHEN doc_id % 13 = 0 THEN 'staged' WHEN doc_id % 19 = 0 THEN 'processing'
              WHEN doc_id % 23 = 0 THEN 'queued' ELSE 'ready' END AS status,
         sha256(text) AS sha256, strlen(text) AS size, CAST(floor(n_chars / 3500) + 1 AS INTEGER) AS pages,
         n_chars * CAST(0.001 AS DOUBLE) AS cost_usd, doc_id, text
  FROM documents
)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of one page; every fifth a table, every other fifth an image."""
    modality = F.when(F.col("doc_id") % 5 == 3, "table").when(F.col("doc_id") % 5 == 4, "image").otherwise("text")
    return registry(spark, sf_dir).select(
        F.concat("document_id", F.lit(":0")).alias("chunk_id"), "document_id", "collection_id", "doc_id",
        modality.alias("modality"), F.lit(1).alias("page"), F.lit(0).alias("ordinal"), "filename", "status", "text",
    )


SQL_CHUNKS = (
    SQL_REGISTRY
    + """, chunks AS (
  SELECT document_id || ':0' AS chunk_id, document_id, collection_id, doc_id,
         CASE doc_id % 5 WHEN 3 THEN 'table' WHEN 4 THEN 'image' ELSE 'text' END AS modality, 1 AS page, 0 AS ordinal, filename, status, text
  FROM registry
)"""
)


def queries_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answered questions from `events`."""
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.col("ts").alias("created_at"), F.concat(F.lit("c"), (F.col("user_id") % 7).cast("string")).alias("collection_id"),
        F.round(F.col("value") * 10).cast("long").alias("latency_ms"),
        F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("status"),
        (F.col("event_id") % 7 == 0).alias("used_web"), (F.floor(F.col("value") * 100) / 1_000_000).alias("cost_usd"),
    )


SQL_QUERIES_LOG = """
queries AS (
  SELECT event_id, user_id, ts AS created_at, 'c' || (user_id % 7) AS collection_id, CAST(round(value * 10) AS BIGINT) AS latency_ms,
         CASE WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS status, event_id % 7 = 0 AS used_web,
         floor(value * 100) / 1000000 AS cost_usd
  FROM events
)"""


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model calls from `events`: known, prefixed, suffixed and unknown names."""
    names = F.array(*[F.lit(x) for x in ("atlas-2", "models/atlas-2-mini", "atlas-2-mini-2026-03-17", "borealis-embed", "unlisted")])
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", F.get(names, (F.col("event_id") % 5).cast("int")).alias("model"),
        F.floor(F.col("value") * 10).cast("long").alias("input_tokens"), (F.col("event_id") % 97).alias("output_tokens"),
    )


SQL_USAGE = """
usage_events AS (
  SELECT event_id, user_id, ts, ['atlas-2', 'models/atlas-2-mini', 'atlas-2-mini-2026-03-17', 'borealis-embed', 'unlisted'][CAST(event_id % 5 AS INT) + 1] AS model,
         CAST(floor(value * 10) AS BIGINT) AS input_tokens, event_id % 97 AS output_tokens
  FROM events
)"""


def sql_tokens(text: str, stopwords: bool = False) -> str:
    words = f"regexp_extract_all(lower({text}), '{TOKEN.replace(chr(39), chr(39) * 2)}')"
    if not stopwords:
        kept = ", ".join(f"'{w}'" for w in STOPWORDS)
        words = f"list_filter({words}, lambda w: w NOT IN ({kept}))"
    return (
        f"list_transform({words}, lambda w: CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN w[:-4] || 'y' "
        "WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END)"
    )


def sql_keywords(text: str) -> str:
    return f"list_filter({sql_tokens(text)}, lambda k: length(k) > 1)"


def sql_sentences(text: str) -> str:
    marked = f"""regexp_replace(regexp_replace({text}, '\\n+', chr(1), 'g'), '([.!?])\\s+(["''(\\[]?[A-Z0-9])', '\\1' || chr(1) || '\\2', 'g')"""
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '')"
