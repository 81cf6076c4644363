"""Queries over the registry, statistics, usage and cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrivia.operators import cost as C
from scrivia.operators import registry as R
from scrivia.operators.lineage import shared_path
from scrivia.plans.fixtures import SQL_CHUNKS, SQL_QUERIES_LOG, SQL_REGISTRY, SQL_USAGE, chunks, queries_log, registry, table, usage_events
from scrivia.sources import sinks

PRICES = [("atlas-2", 2.5, 15.0), ("atlas-2-mini", 0.75, 4.5), ("borealis-embed", 0.02, 0.0)]
SQL_PRICES = "prices(name, price_in, price_out) AS (VALUES ('atlas-2', 2.5::DOUBLE, 15.0::DOUBLE), ('atlas-2-mini', 0.75, 4.5), ('borealis-embed', 0.02, 0.0))"
SQL_COSTED = (
    SQL_USAGE
    + ", "
    + SQL_PRICES
    + """, matched AS (
  SELECT u.*, p.price_in, p.price_out, row_number() OVER (PARTITION BY event_id ORDER BY length(p.name) DESC NULLS LAST) AS n
  FROM usage_events u LEFT JOIN prices p ON starts_with(regexp_replace(u.model, '^models/', ''), p.name)
), costed AS (
  SELECT event_id, user_id, ts, model, input_tokens, output_tokens, coalesce((input_tokens * price_in + output_tokens * price_out) / 1000000, 0) AS cost_usd,
         price_in IS NULL AS unpriced FROM matched WHERE n = 1
)"""
)


def _prices(spark):
    return spark.createDataFrame(PRICES, "name string, price_in double, price_out double")


def staged(spark, sf):
    d = registry(spark, sf)
    ext = F.when(F.col("doc_id") % 7 == 0, ".exe").when(F.col("doc_id") % 7 == 1, ".PDF").otherwise(".md")
    files = d.select(F.concat("filename", ext).alias("name"), F.when(F.col("doc_id") % 11 == 0, 0).otherwise(F.col("size") * 2000).alias("size"))
    ok, bad = R.stage_files(files, 1)
    return ok.select("name", "kind", F.lit(None).cast("string").alias("reason")).union(bad.select("name", "kind", "reason"))


def deduplicated(spark, sf):
    d = registry(spark, sf).withColumn("created_at", F.col("doc_id"))
    old = d.where("doc_id % 3 = 0").withColumn("status", F.when(F.col("doc_id") % 2 == 0, "failed").otherwise("ready"))
    old = old.withColumn("document_id", F.concat(F.lit("old_"), "document_id"))
    return R.new_documents(d, old).select("collection_id", "sha256", "document_id", "created_at")


def replaced(spark, sf):
    c = chunks(spark, sf).select("chunk_id", "document_id", "modality")
    fresh = c.where("modality = 'table'").select(F.concat("chunk_id", F.lit("b")).alias("chunk_id"), "document_id", F.lit("text").alias("modality"))
    return R.replace_content(c, fresh)


def upserted(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", "label", F.lit(1).alias("version"))
    fresh = v.where("vec_id % 4 = 0").select((F.col("vec_id") * 2).alias("vec_id"), (F.col("label") + 100).alias("label"), F.lit(2).alias("version"))
    return R.upsert(v, fresh, "vec_id", "version")


def cascaded(spark, sf):
    gone = registry(spark, sf).where("status = 'failed'")
    kept = R.delete_cascade(gone, "document_id", chunks(spark, sf).select("document_id", "chunk_id"), registry(spark, sf).select("document_id", "filename"))
    return kept[0].join(kept[1], "document_id").select("document_id", "chunk_id", "filename")


def patched(spark, sf):
    r = registry(spark, sf).select("document_id", "doc_id", "status", "pages", F.lit("2026-01-01").alias("updated_at"))
    changes = r.where("doc_id % 5 = 0").select("document_id", F.when(F.col("doc_id") % 10 == 0, "ready").alias("status"), F.lit(None).cast("int").alias("pages"))
    return R.patch(r, changes, "document_id", ["status", "pages"], F.lit("2026-02-02"))


def recovered(spark, sf):
    return R.recover(registry(spark, sf).select("document_id", "status"))


def startable(spark, sf):
    r = registry(spark, sf)
    return R.startable(r.where("doc_id % 2 = 0").select("document_id"), r.select("document_id", "status"))


def public_documents(spark, sf):
    r = registry(spark, sf).select("document_id", "filename", "status", "size", F.concat(F.lit("/data/"), "sha256").alias("path"))
    return R.public_documents(r)


def described(spark, sf):
    """Tables of every region with their descriptions, place by place."""
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("rows"))
    listed = n.select("n_regionkey", F.col("rows.n_nationkey").alias("key"), F.transform("rows.n_name", lambda x: F.concat(F.lit("Table of "), x)).alias("description"))
    return R.described(listed, "key", "description")


def query_log(spark, sf):
    """Answered questions appended to the log day by day, and read back."""
    log, path = queries_log(spark, sf), shared_path(spark, "query-log")
    for status in ("done", "failed"):
        sinks.append_log(log.where(F.col("status") == status), path)
    return spark.read.parquet(path).select("event_id", "collection_id", "status", "latency_ms", "used_web", F.round("cost_usd", 6).alias("cost_usd"))


def content_after_ingest(spark, sf):
    """Chunks of documents whose ingest succeeded; what others left behind goes."""
    c = chunks(spark, sf)
    return sinks.succeeded_content(c.select("document_id", "chunk_id"), c.select("document_id", "status").distinct())


def found_collections(spark, sf):
    r = registry(spark, sf).groupBy("collection_id").agg(F.min("doc_id").alias("created_at")).withColumn("name", F.concat(F.lit("Docs "), "collection_id"))
    wanted = spark.createDataFrame([("en",), ("DOCS fr",), ("EN",), ("nothing",)], "wanted string")
    return R.find_collections(wanted, r)


def versions(spark, sf):
    r = registry(spark, sf)
    return R.bump_versions(r.select("collection_id").distinct().withColumn("version", F.lit(3)), r.where("status = 'ready'"))


def slugs(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    return R.unique_slugs(d, "source", "doc_id").select("doc_id", "slug")


def job_state(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("stage"), F.col("value").alias("progress"))
    return R.current_state(e, "user_id", ["event_id", "stage", "progress"])


def fallbacks(spark, sf):
    c = chunks(spark, sf).where("modality <> 'text'")
    e = c.select(F.col("collection_id").alias("document_id"), F.when(F.col("doc_id") % 2 == 0, F.col("filename")).alias("description"), F.col("modality").alias("caption"))
    return R.description_fallback(e).select("document_id", "n", "n_fallback", "failed", F.md5(F.col("texts").cast("binary")).alias("texts_md5"))


def doc_stats(spark, sf):
    r = registry(spark, sf)
    return R.document_stats(r).withColumn("collection_id", F.lit(None).cast("string")).unionByName(R.document_stats(r, "collection_id"))


def modality_totals(spark, sf):
    return R.modality_counts(chunks(spark, sf), "collection_id")


def per_document_modalities(spark, sf):
    return R.modality_counts(chunks(spark, sf), "document_id")


def query_totals(spark, sf):
    return R.query_stats(queries_log(spark, sf))


def daily(spark, sf):
    return R.daily_rollup(queries_log(spark, sf))


def gap_filled(spark, sf):
    q = queries_log(spark, sf)
    per_day = R.daily_rollup(q.where(F.dayofmonth("created_at") % 3 != 0))
    return R.filled_days(per_day, "2024-01-20").select("day", "queries", "avg_latency_ms")


def percentiles(spark, sf):
    return R.latency_percentiles(queries_log(spark, sf), ["collection_id"])


def collection_overview(spark, sf):
    r = registry(spark, sf)
    c = r.select("collection_id").distinct().withColumn("hidden", F.col("collection_id") == "es")
    return R.collection_list(c, r, chunks(spark, sf).where("modality = 'text'")).select("collection_id", "documents", "ready", "chunks")


def conversation_overview(spark, sf):
    t = table(spark, sf, "conversations")
    c = t.groupBy("conv_id").agg(F.max(F.col("turn") * 1000 + F.col("conv_id") % 7).alias("updated_at"))
    return R.conversation_list(c, t.where("role = 'user'"), 40)


def done_turns(spark, sf):
    t = table(spark, sf, "conversations").withColumn("status", F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, "failed").otherwise("done"))
    return R.recent_done(t, 4).select("conv_id", "turn", "role")


def messages(spark, sf):
    return R.conversation_messages(table(spark, sf, "conversations").where("role <> 'system'")).select("conv_id", "turn", "role")


def transcripts(spark, sf):
    """Turns of every conversation in order; those of a conversation that no customer owns are not shown."""
    owners = table(spark, sf, "customer").select(F.col("c_custkey").alias("conv_id"), F.col("c_name").alias("owner"))
    return R.transcripts(table(spark, sf, "conversations"), owners)


def priced(spark, sf):
    return C.priced(usage_events(spark, sf), _prices(spark)).select("event_id", "model", F.round("cost_usd", 9).alias("cost_usd"), "unpriced")


def usage(spark, sf):
    return C.usage_totals(C.priced(usage_events(spark, sf), _prices(spark)).withColumn("user", F.col("user_id") % 50), "user")


def budget(spark, sf):
    costed = C.priced(usage_events(spark, sf), _prices(spark))
    return C.within_budget(costed, "user_id", ["ts", "event_id"], 0.02).select("event_id", "user_id", F.round("spent_before", 9).alias("spent_before"), "over")


def estimates(spark, sf):
    p = registry(spark, sf).select("document_id", "pages", F.length("text").alias("chars"), (F.col("doc_id") % 4).alias("images"), (F.col("doc_id") % 3).alias("tables"))
    return C.ingest_estimate(p, 0.75, 4.5, 0.02, True, 0.01)


def estimate_totals(spark, sf):
    return estimates(spark, sf).agg(
        F.sum("calls").alias("calls"), F.sum("embedding_tokens").alias("embedding_tokens"), F.round(F.sum("cost_usd"), 3).alias("cost_usd"), F.count_if("over_budget").alias("n_over")
    )


def newest(spark, sf):
    """The newest documents of a collection with an active status."""
    r = registry(spark, sf).where("collection_id = 'en' AND status IN ('queued', 'processing', 'staged')")
    return r.orderBy(F.desc("doc_id")).limit(25).select("document_id", "status")


def ready_chunks(spark, sf):
    c, r = chunks(spark, sf).drop("status", "filename"), registry(spark, sf).where("status = 'ready'")
    ready = c.join(r.select("document_id", "filename"), "document_id")
    return R.document_chunks(ready).select("chunk_id", "filename", "modality")


def jobs_with_names(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit("doc_"), F.col("event_id").cast("string")).alias("document_id"))
    return e.join(registry(spark, sf).select("document_id", "filename"), "document_id", "left")


def ingest_targets(spark, sf):
    """Named documents, or all staged ones if none is named."""
    r = registry(spark, sf)
    named = r.where("doc_id % 50 = 1").select("document_id")
    by_name = r.join(named, "document_id", "left_semi").select("document_id", F.lit("named").alias("why"))
    return by_name.union(r.where("status = 'staged'").select("document_id", F.lit("staged")))


_STATS = """count(*) AS total, count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status IN ('queued', 'processing')) AS processing,
  count(*) FILTER (status = 'staged') AS staged, CAST(coalesce(sum(pages), 0) AS BIGINT) AS pages, round(sum(cost_usd), 4) AS cost_usd"""
_MODALITIES = "count(*) FILTER (modality = 'text') AS text, count(*) FILTER (modality = 'table') AS \"table\", count(*) FILTER (modality = 'image') AS image, count(*) AS total"
_ESTIMATES = (
    f"WITH {SQL_REGISTRY}, p AS (SELECT document_id, length(text) AS chars, doc_id % 4 AS images, doc_id % 3 AS tables FROM registry),"
    """ e AS (SELECT document_id, images + tables AS calls, images * 1700 + tables * 900 AS input_tokens, images * 260 + tables * 120 AS output_tokens,
    CAST(floor(chars / 4::DOUBLE * 3.2::DOUBLE) AS BIGINT) + images * 260 + tables * 600 AS embedding_tokens FROM p),
    f AS (SELECT *, (input_tokens * 0.75::DOUBLE + output_tokens * 4.5::DOUBLE + embedding_tokens * 0.02::DOUBLE) / 1000000 AS c FROM e),
    est AS (SELECT document_id, calls, input_tokens, output_tokens, embedding_tokens, round_even(c, 4) AS cost_usd, round_even(c * 0.6::DOUBLE, 4) AS cost_low_usd, round_even(c * 1.5::DOUBLE, 4) AS cost_high_usd, c * 1.5::DOUBLE > 0.01 AS over_budget FROM f)"""
)

QUERIES = {
    "src02_src03_src04_staging": (
        staged,
        f"""WITH {SQL_REGISTRY}, f AS (SELECT filename || CASE doc_id % 7 WHEN 0 THEN '.exe' WHEN 1 THEN '.PDF' ELSE '.md' END AS name, doc_id, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE size * 2000 END AS size FROM registry)
        SELECT name, CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'pdf' ELSE 'text' END AS kind, CASE WHEN doc_id % 7 = 0 THEN 'unsupported' WHEN size = 0 THEN 'empty' WHEN size > 1048576 THEN 'too large' END AS reason FROM f""",
    ),
    "src05_src06_new_documents": (
        deduplicated,
        f"""WITH {SQL_REGISTRY}, u AS (SELECT *, row_number() OVER (PARTITION BY collection_id, sha256 ORDER BY doc_id) AS n FROM registry),
        o AS (SELECT collection_id, sha256, min(struct_pack(d := 'old_' || document_id, s := CASE WHEN doc_id % 2 = 0 THEN 'failed' ELSE 'ready' END)) AS o FROM registry WHERE doc_id % 3 = 0 GROUP BY ALL)
        SELECT u.collection_id, u.sha256, coalesce(o.o.d, u.document_id) AS document_id, u.doc_id AS created_at FROM u LEFT JOIN o USING (collection_id, sha256) WHERE n = 1 AND (o.o IS NULL OR o.o.s = 'failed')""",
    ),
    "snk01_replace_content": (
        replaced,
        f"WITH {SQL_CHUNKS} SELECT CASE WHEN modality = 'table' THEN chunk_id || 'b' ELSE chunk_id END AS chunk_id, document_id, CASE WHEN modality = 'table' THEN 'text' ELSE modality END AS modality FROM chunks",
    ),
    "snk02_vector_upsert": (
        upserted,
        """WITH a AS (SELECT vec_id, label, 1 AS version FROM embeddings UNION ALL SELECT vec_id * 2, label + 100, 2 FROM embeddings WHERE vec_id % 4 = 0)
        SELECT vec_id, label, version FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY version DESC) AS n FROM a) WHERE n = 1""",
    ),
    "snk05_delete_cascade": (cascaded, f"WITH {SQL_CHUNKS} SELECT document_id, chunk_id, filename FROM chunks WHERE status <> 'failed'"),
    "prj04_partial_update": (
        patched,
        f"""WITH {SQL_REGISTRY} SELECT document_id, doc_id, CASE WHEN doc_id % 10 = 0 THEN 'ready' ELSE status END AS status, pages, CASE WHEN doc_id % 10 = 0 THEN '2026-02-02' ELSE '2026-01-01' END AS updated_at FROM registry""",
    ),
    "reg01_recovery": (recovered, f"WITH {SQL_REGISTRY} SELECT document_id, CASE WHEN status IN ('queued', 'processing') THEN 'failed' ELSE status END AS status FROM registry"),
    "reg02_one_job": (startable, f"WITH {SQL_REGISTRY} SELECT document_id FROM registry WHERE doc_id % 2 = 0 AND status NOT IN ('queued', 'processing')"),
    "snk03_query_log": (query_log, f"WITH {SQL_QUERIES_LOG} SELECT event_id, collection_id, status, latency_ms, used_web, round(cost_usd, 6) AS cost_usd FROM queries"),
    "snk06_content_after_ingest": (content_after_ingest, f"WITH {SQL_CHUNKS} SELECT document_id, chunk_id FROM chunks WHERE status = 'ready'"),
    "prj01_public_documents": (public_documents, f"WITH {SQL_REGISTRY} SELECT document_id, filename, status, CAST(size AS INTEGER) AS size FROM registry"),
    "jn13_described": (
        described,
        "SELECT n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INTEGER) AS n, n_nationkey AS key, 'Table of ' || n_name AS description FROM nation",
    ),
    "reg03_find_collection": (
        found_collections,
        """SELECT * FROM (VALUES ('en', 'en'), ('DOCS fr', 'fr')) t(wanted, collection_id) UNION ALL SELECT w, (SELECT lang FROM documents GROUP BY lang ORDER BY min(doc_id), lang LIMIT 1) FROM (VALUES ('EN'), ('nothing')) o(w)""",
    ),
    "reg04_versions": (versions, f"WITH {SQL_REGISTRY} SELECT collection_id, 3 + count(*) FILTER (status = 'ready') AS version FROM registry GROUP BY 1"),
    "wn09_unique_slugs": (
        slugs,
        """WITH b AS (SELECT doc_id, lower(source) AS base, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) SELECT doc_id, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS slug FROM b""",
    ),
    "reg06_job_state": (
        job_state,
        """SELECT user_id, ts AS updated_at, event_id, event_type AS stage, value AS progress FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""",
    ),
    "reg05_description_fallback": (
        fallbacks,
        f"""WITH {SQL_CHUNKS}, e AS (SELECT collection_id AS document_id, CASE WHEN doc_id % 2 = 0 THEN filename END AS d, modality FROM chunks WHERE modality <> 'text'),
        g AS (SELECT document_id, count(*) AS n, count(*) FILTER (d IS NULL) AS n_fallback, string_agg(coalesce(d, modality), '|' ORDER BY coalesce(d, modality)) AS t FROM e GROUP BY 1)
        SELECT document_id, n, n_fallback, n >= 2 AND n_fallback = n AS failed, md5(t) AS texts_md5 FROM g""",
    ),
    "ag01_ag11_document_stats": (doc_stats, f"WITH {SQL_REGISTRY} SELECT collection_id, {_STATS} FROM registry GROUP BY GROUPING SETS ((collection_id), ())"),
    "ag02_modalities": (modality_totals, f"WITH {SQL_CHUNKS} SELECT collection_id, {_MODALITIES} FROM chunks GROUP BY 1"),
    "ag10_document_modalities": (per_document_modalities, f"WITH {SQL_CHUNKS} SELECT document_id, {_MODALITIES} FROM chunks GROUP BY 1"),
    "ag03_query_stats": (
        query_totals,
        f"""WITH {SQL_QUERIES_LOG} SELECT collection_id, count(*) AS total, round(sum(cost_usd), 4) AS cost_usd, round(avg(latency_ms), 3) AS avg_latency_ms, count(*) FILTER (used_web) AS web, count(*) FILTER (status = 'failed') AS failed FROM queries GROUP BY GROUPING SETS ((collection_id), ())""",
    ),
    "ag04_daily": (
        daily,
        f"""WITH {SQL_QUERIES_LOG} SELECT CAST(created_at AS DATE) AS day, count(*) AS queries, round(sum(cost_usd), 4) AS cost_usd, round(avg(latency_ms), 3) AS avg_latency_ms FROM queries GROUP BY 1 ORDER BY 1 DESC LIMIT 14""",
    ),
    "jn14_gap_fill": (
        gap_filled,
        f"""WITH {SQL_QUERIES_LOG}, d AS (SELECT CAST(created_at AS DATE) AS day, count(*) AS queries, round(avg(latency_ms), 3) AS a FROM queries WHERE day(created_at) % 3 <> 0 GROUP BY 1 ORDER BY 1 DESC LIMIT 14)
        SELECT CAST(g AS DATE) AS day, coalesce(queries, 0) AS queries, coalesce(a, 0) AS avg_latency_ms FROM range(DATE '2024-01-07', DATE '2024-01-21', INTERVAL 1 DAY) t(g) LEFT JOIN d ON d.day = CAST(g AS DATE)""",
    ),
    "ag05_latency_percentiles": (
        percentiles,
        f"""WITH {SQL_QUERIES_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY created_at DESC, event_id DESC) AS n FROM queries),
        l AS (SELECT collection_id, list_sort(list(latency_ms)) AS l FROM r WHERE n <= 200 GROUP BY 1)
        SELECT collection_id, l[CAST(round_even((len(l) - 1) * 0.5::DOUBLE, 0) AS INT) + 1] AS p50, l[CAST(round_even((len(l) - 1) * 0.95::DOUBLE, 0) AS INT) + 1] AS p95 FROM l""",
    ),
    "ag06_collections": (
        collection_overview,
        f"""WITH {SQL_CHUNKS} SELECT r.collection_id, count(*) AS documents, count(*) FILTER (r.status = 'ready') AS ready, (SELECT count(*) FROM chunks c WHERE c.collection_id = r.collection_id AND c.modality = 'text') AS chunks FROM registry r WHERE r.collection_id <> 'es' GROUP BY 1""",
    ),
    "ag07_conversations": (
        conversation_overview,
        """SELECT conv_id, max(turn * 1000 + conv_id % 7) AS updated_at, count(*) FILTER (role = 'user') AS turns FROM conversations GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40""",
    ),
    "wn06_recent_done": (
        done_turns,
        """SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4 AND (conv_id + turn) % 5 <> 0""",
    ),
    "q05_messages": (
        messages,
        """WITH r AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN role ELSE 'user' END AS role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role <> 'system'),
        k AS (SELECT * FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM r WHERE n <= 6) WHERE b IS NULL OR b <> role),
        e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 AS f, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL AS l FROM k)
        SELECT conv_id, turn, role FROM e WHERE NOT (f AND role = 'assistant') AND NOT (l AND role = 'user')""",
    ),
    "q06_turns": (transcripts, "SELECT conv_id, c_name AS owner, CASE WHEN c_name IS NOT NULL THEN string_agg(role, '>' ORDER BY turn, role) END AS roles FROM conversations LEFT JOIN customer ON c_custkey = conv_id GROUP BY conv_id, c_name"),
    "jn11_cst01_prices": (priced, f"WITH {SQL_COSTED} SELECT event_id, model, round(cost_usd, 9) AS cost_usd, unpriced FROM costed"),
    "ag12_cst02_usage": (
        usage,
        f"""WITH {SQL_COSTED} SELECT user_id % 50 AS user, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(cost_usd), 6) AS cost_usd,
        coalesce(string_agg(DISTINCT CASE WHEN unpriced THEN model END, ',' ORDER BY CASE WHEN unpriced THEN model END), '') AS unpriced_models FROM costed GROUP BY 1""",
    ),
    "wn07_budget": (
        budget,
        f"""WITH {SQL_COSTED}, s AS (SELECT *, coalesce(sum(cost_usd) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM costed)
        SELECT event_id, user_id, round(b, 9) AS spent_before, b + cost_usd > 0.02 AS over FROM s WHERE b <= 0.02""",
    ),
    "cst03_estimates": (estimates, _ESTIMATES + " SELECT * FROM est"),
    "ag18_estimate_totals": (
        estimate_totals,
        _ESTIMATES + " SELECT CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(embedding_tokens) AS BIGINT) AS embedding_tokens, round(sum(cost_usd), 3) AS cost_usd, count(*) FILTER (over_budget) AS n_over FROM est",
    ),
    "flt03_tk04_newest": (newest, f"WITH {SQL_REGISTRY} SELECT document_id, status FROM registry WHERE collection_id = 'en' AND status IN ('queued', 'processing', 'staged') ORDER BY doc_id DESC LIMIT 25"),
    "flt02_jn01_tk03_ready_chunks": (ready_chunks, f"WITH {SQL_CHUNKS} SELECT chunk_id, filename, modality FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page, ordinal) AS n FROM chunks WHERE status = 'ready') WHERE n <= 500"),
    "jn02_jobs": (jobs_with_names, f"WITH {SQL_REGISTRY} SELECT event_id, 'doc_' || event_id AS document_id, filename FROM events e LEFT JOIN registry r ON r.doc_id = e.event_id"),
    "flt04_jn04_targets": (ingest_targets, f"WITH {SQL_REGISTRY} SELECT document_id, 'named' AS why FROM registry WHERE doc_id % 50 = 1 UNION ALL SELECT document_id, 'staged' FROM registry WHERE status = 'staged'"),
}
