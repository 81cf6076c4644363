"""Queries over sources, sections, chunks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrivia.functions import text as T
from scrivia.operators import chunking as C
from scrivia.operators import cost
from scrivia.operators.lineage import shared_path
from scrivia.plans.fixtures import SQL_CHUNKS, SQL_QUERIES_LOG, chunks, table, usage_events
from scrivia.plans.q_registry import SQL_COSTED
from scrivia.sources import corpus
from scrivia.streaming import streams


def _docs(spark, sf):
    return table(spark, sf, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("document_id"), "doc_id", "text")


def sections(spark, sf):
    s = C.sections(_docs(spark, sf))
    return s.select("document_id", "page", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("md5"))


def section_of(spark, sf):
    d = _docs(spark, sf)
    offsets = d.select("document_id", F.explode(F.array(F.lit(0), F.length("text") - 1, F.lit(4000))).alias("offset")).distinct()
    pages = d.select("document_id", F.posexplode(F.split("text", "\n")).alias("_i", "text")).select("document_id", (F.col("_i") + 1).alias("page"), "text")
    return C.section_of(offsets, pages)


def _pages(spark, sf):
    return C.sections(_docs(spark, sf).select("document_id", "text"))


def recursive(spark, sf):
    c = C.recursive_chunks(_pages(spark, sf), 800, 100)
    return c.select("document_id", "page", "seq", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("md5"))


def semantic(spark, sf):
    c = C.semantic_chunks(_pages(spark, sf), 800)
    return c.select("document_id", "seq", "page", F.length("text").cast("long").alias("n_chars"))


def dispatched(spark, sf):
    p = _pages(spark, sf).withColumn("strategy", F.when(F.crc32(F.col("document_id").cast("binary")) % 3 == 0, "semantic").when(F.crc32(F.col("document_id").cast("binary")) % 3 == 1, "agentic"))
    return C.chunk(p, 800, 100).groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"))


def outlined(spark, sf):
    p = _pages(spark, sf)
    groups = F.array(*[F.struct(F.lit(t).alias("title"), F.lit(a).alias("start"), F.lit(b).alias("end")) for t, a, b in (("one", 1, 3), ("two", 2, 5), ("three", 8, 20))])
    outline = p.where("page = 1").select("document_id", "page", F.inline(groups))
    return C.outline_chunks(p, outline, 600, 100).select("document_id", "page", "seq", "title", F.length("text").cast("long").alias("n_chars"))


def propositions(spark, sf):
    s = _docs(spark, sf).select("document_id", F.posexplode(T.sentences(F.col("text"))).alias("seq", "proposition"))
    p = s.withColumn("page", F.lit(1)).withColumn("choice", F.when(F.col("seq") % 4 == 0, F.lit(-1)).otherwise((F.col("seq") % 3 + 1).cast("int")))
    return C.proposition_chunks(p, 600).select("document_id", "page", "seq", F.length("text").cast("long").alias("n_chars"))


def records(spark, sf):
    c = chunks(spark, sf).select("document_id", "page", F.col("doc_id").alias("seq"), "text")
    tables = c.where("seq % 2 = 0").withColumn("text", F.lit("t"))
    images = c.where("seq % 3 = 0").withColumn("text", F.lit("i"))
    return C.chunk_records(c, tables, images).select("chunk_id", "parent_id", "modality", "ordinal")


def blocks(spark, sf):
    p = table(spark, sf, "part")
    return corpus.row_blocks(p, "part", ["p_partkey", "p_name", "p_brand"], "p_partkey").select("block", "page", "caption", F.md5(F.col("markdown").cast("binary")).alias("md5"))


def row_text(spark, sf):
    t = corpus.row_text(table(spark, sf, "part"), "part.csv", ["p_partkey", "p_name", "p_brand"], "p_partkey")
    return t.select("document_id", "page", F.md5(F.col("text").cast("binary")).alias("md5"))


def web(spark, sf):
    p = corpus.web_pages(table(spark, sf, "pages"))
    return p.select("page_id", "title", F.length("text").cast("long").alias("n_chars"), F.size("tables").cast("long").alias("n_tables"), F.md5(F.col("text").cast("binary")).alias("md5"))


def web_sections(spark, sf):
    s = corpus.web_sections(corpus.web_pages(table(spark, sf, "pages")))
    return s.select("document_id", "page", "title", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("md5"))


def checked_vectors(spark, sf):
    return corpus.vectors(table(spark, sf, "embeddings"), 64).select("vec_id", "label")


def pipe_tables(spark, sf):
    made = F.concat(F.lit("Intro\n\n| a | b |\n|---|---|\n| "), F.col("n_name"), F.lit(" | "), F.col("n_nationkey").cast("string"), F.lit(" |\n\nEnd | here"))
    return table(spark, sf, "nation").select("n_nationkey", F.explode(T.pipe_tables(made)).alias("table_text"))


# -- streams: each runs over its table to the end and returns what it has written


def _run(stream, name, mode):
    """What the stream has written to the shared folder, a folder a batch; in complete mode a batch replaces the last."""
    spark, columns = stream.sparkSession, stream.columns
    out, checkpoint = shared_path(spark, name), shared_path(spark, f"{name}-progress")
    spark.createDataFrame([], stream.schema).write.parquet(f"{out}/batch=-1")  # a stream may have no batch

    def each(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={0 if mode == 'complete' else number}")

    stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).select(*columns)


def _stream(spark, sf, name):
    """A table of one file or of a folder of files: a stream takes a pattern for either, but no path of a file."""
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")


def _log_stream(spark, sf):
    return _stream(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("created_at"), (F.floor(F.col("value") * 100) / 1_000_000).alias("cost_usd"), F.round(F.col("value") * 10).cast("long").alias("latency_ms")
    )


def stream_usage(spark, sf):
    """Days of the stream, each told once when the watermark has passed its end; days that are open still are not told."""
    rows = _run(streams.usage_windows(_log_stream(spark, sf)), "ss02_usage", "append")
    return rows.select(F.to_date("start").alias("day"), "queries", "cost_usd", "avg_latency_ms")


def stream_sessions(spark, sf):
    """Sessions that the watermark has closed, by user."""
    e = _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = _run(streams.sessions(e, "6 hours"), "ss05_sessions", "append")
    return rows.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_events"))


def stream_entities(spark, sf):
    return _run(streams.entity_counts(_stream(spark, sf, "documents")), "ss06_entities", "complete")


def stream_jobs(spark, sf):
    e = _stream(spark, sf, "events").select(F.col("user_id").alias("job_id"), "event_id", F.col("event_type").alias("stage"), F.col("value").alias("progress"))
    rows = _run(streams.job_states(e, None), "ss03_jobs", "update")
    return rows.where("status = 'running'").select("job_id", "stage", "progress")


def stream_budget(spark, sf):
    prices = spark.createDataFrame([("atlas-2", 2.5, 15.0), ("atlas-2-mini", 0.75, 4.5), ("borealis-embed", 0.02, 0.0)], "name string, price_in double, price_out double")
    costed = cost.priced(usage_events(spark, sf), prices).select(F.col("user_id").alias("key"), "event_id", "cost_usd")
    path = shared_path(spark, "costed")
    costed.write.parquet(path)
    stream = spark.readStream.schema(costed.schema).parquet(path)
    return _run(streams.budget_guard(stream, 0.02), "ss04_budget", "append")


def stream_ingest(spark, sf):
    """Documents that a stream has not had before, by the hash of their text."""
    out, seen, checkpoint = (shared_path(spark, n) for n in ("ingested", "registry", "progress"))
    d = _stream(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    each = streams.ingest_new(seen, lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out))
    d.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("sha256")


def _next_cut(a: str) -> str:
    """Where the section that starts at offset `a` ends, in SQL."""
    ahead = f"list_filter(ends, lambda x: x >= {a})"
    blank = f"strpos(reverse(substr(text, CAST({a} + 1 AS BIGINT), 3500)), chr(10) || chr(10))"
    return f"""CASE WHEN list_min({ahead}) - {a} > 5250 THEN {a} + CASE WHEN {blank} > 0 AND 3499 - {blank} > 1166 THEN 3499 - {blank} ELSE 3500 END
      ELSE greatest(list_min({ahead}), coalesce(list_max(list_filter({ahead}, lambda x: x <= {a} + 3501)), 0)) + 1 END"""


_SECTIONS = f"""WITH RECURSIVE l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
n AS (SELECT doc_id, text, ls, i, sum(length(ls[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS e FROM l, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i) t),
b AS (SELECT doc_id, any_value(text) AS text, list(CAST(e AS BIGINT) ORDER BY i) FILTER (i = len(ls) OR regexp_matches(ls[i + 1], '^#{{1,2}} ')) AS ends FROM n GROUP BY doc_id),
c AS (SELECT doc_id, text, ends, CAST(0 AS BIGINT) AS a, CAST({_next_cut('0')} AS BIGINT) AS z FROM b UNION ALL SELECT doc_id, text, ends, z, CAST({_next_cut('z')} AS BIGINT) FROM c WHERE z < length(text)),
t AS (SELECT doc_id, a, regexp_replace(substr(text, a + 1, z - a), '^\\s+|\\s+$', '', 'g') AS s FROM c),
p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS page, s FROM t WHERE s <> '' UNION ALL SELECT doc_id, 1, '' FROM t GROUP BY doc_id HAVING bool_and(s = ''))"""


QUERIES = {
    "t07_sections": (sections, _SECTIONS + " SELECT 'doc_' || doc_id AS document_id, CAST(page AS INTEGER) AS page, length(s) AS n_chars, md5(s) AS md5 FROM p"),
    "jn10_section_of": (
        section_of,
        """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), p AS (SELECT doc_id, i AS page, sum(length(ls[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM l, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i) t),
        o AS (SELECT DISTINCT doc_id, unnest([0, length(text) - 1, 4000]) AS o FROM documents)
        SELECT 'doc_' || doc_id AS document_id, CAST(o AS INTEGER) AS offset, CAST(coalesce(min(page) FILTER (o < upto), max(page)) AS INTEGER) AS page FROM o JOIN p USING (doc_id) GROUP BY doc_id, o""",
    ),
    "c01_c02_t05_recursive": (recursive, None),
    "c03_wn02_wn03_wn04_ag15_semantic": (semantic, None),
    "c06_dispatch": (dispatched, None),
    "c04_outline": (outlined, None),
    "c05_propositions": (propositions, None),
    "c07_wn08_st02_records": (
        records,
        f"""WITH {SQL_CHUNKS}, a AS (SELECT document_id, page, doc_id, 'text' AS modality, 0 AS k FROM chunks UNION ALL SELECT document_id, page, doc_id, 'table', 1 FROM chunks WHERE doc_id % 2 = 0 UNION ALL SELECT document_id, page, doc_id, 'image', 2 FROM chunks WHERE doc_id % 3 = 0),
        n AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY k) - 1 AS o FROM a) SELECT document_id || ':' || o AS chunk_id, document_id || ':p' || page AS parent_id, modality, CAST(o AS INTEGER) AS ordinal FROM n""",
    ),
    "src08_row_text": (
        row_text,
        """WITH n AS (SELECT *, row_number() OVER (ORDER BY p_partkey) AS n FROM part)
        SELECT 'part.csv' AS document_id, 1 AS page, md5('# part.csv' || chr(10) || chr(10) || '| p_partkey | p_name | p_brand |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || p_partkey || ' | ' || p_name || ' | ' || p_brand || ' |', chr(10) ORDER BY n)) AS md5 FROM n WHERE n <= 400""",
    ),
    "src08_row_blocks": (
        blocks,
        """WITH n AS (SELECT *, row_number() OVER (ORDER BY p_partkey) AS n FROM part), b AS (SELECT (n - 1) // 40 AS block, string_agg('| ' || p_partkey || ' | ' || p_name || ' | ' || p_brand || ' |', chr(10) ORDER BY n) AS r, count(*) AS c FROM n WHERE n < 2001 GROUP BY 1)
        SELECT block, CAST((block * 40 + 1) // 400 + 1 AS INTEGER) AS page, 'part rows ' || (block * 40 + 1) || '-' || (block * 40 + c) AS caption, md5('| p_partkey | p_name | p_brand |' || chr(10) || '|---|---|---|' || chr(10) || r) AS md5 FROM b""",
    ),
    "src09_web_pages": (web, None),
    "src09_web_sections": (web_sections, None),
    "src11_vectors": (checked_vectors, "SELECT vec_id, label FROM embeddings"),
    "t09_pipe_tables": (pipe_tables, "SELECT n_nationkey, '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| ' || n_name || ' | ' || n_nationkey || ' |' AS table_text FROM nation"),
    "ss01_stream_ingest": (stream_ingest, "SELECT DISTINCT sha256(text) AS sha256 FROM documents"),
    "ss02_stream_usage": (
        stream_usage,
        f"WITH {SQL_QUERIES_LOG} SELECT CAST(created_at AS DATE) AS day, count(*) AS queries, round(sum(cost_usd), 4) AS cost_usd, round(avg(latency_ms), 3) AS avg_latency_ms FROM queries GROUP BY 1 HAVING CAST(CAST(created_at AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(created_at) - INTERVAL 1 HOUR FROM queries)",
    ),
    "ss03_stream_jobs": (stream_jobs, "SELECT user_id AS job_id, arg_max(event_type, event_id) AS stage, arg_max(value, event_id) AS progress FROM events GROUP BY 1"),
    "ss04_stream_budget": (
        stream_budget,
        f"""WITH {SQL_COSTED}, s AS (SELECT *, coalesce(sum(cost_usd) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM costed)
        SELECT user_id AS key, event_id, b + cost_usd > 0.02 AS over FROM s WHERE b <= 0.02""",
    ),
    "ss05_stream_sessions": (
        stream_sessions,
        """WITH l AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
        s AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM l),
        c AS (SELECT user_id, s, max(ts) + INTERVAL 6 HOUR AS ends, count(*) AS n FROM s GROUP BY ALL)
        SELECT user_id, count(*) AS n_sessions, CAST(sum(n) AS BIGINT) AS n_events FROM c WHERE ends <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1""",
    ),
    "ss06_stream_entities": (stream_entities, None),
}
