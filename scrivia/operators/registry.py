"""Document registry: staging, de-duplication, lifecycle, cascades, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivia.functions import text as T
from scrivia.operators.lineage import written

ACTIVE = ["queued", "processing"]
RESTAGE = ["failed", "cancelled"]
LATENCY_SAMPLE = 200
DAILY_ROWS = 14


def stage_files(files: DataFrame, max_mb: int = 100) -> tuple[DataFrame, DataFrame]:
    """Files (name, size, ...) that may be staged, with kind and safe_name, and rejects with a reason."""
    judged = files.withColumns({"kind": T.file_kind(F.col("name")), "safe_name": T.safe_filename(F.col("name"))}).withColumn(
        "reason",
        F.when(F.col("kind").isNull(), "unsupported").when(F.col("size") == 0, "empty").when(F.col("size") > max_mb * 2**20, "too large"),
    )
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


def new_documents(staged: DataFrame, registered: DataFrame, force: bool = False) -> DataFrame:
    """One row for each (collection_id, sha256) of `staged`, the earliest; one that is registered and alive is left
    out unless forced, and one that failed or was cancelled takes its old document_id again."""
    first = F.row_number().over(Window.partitionBy("collection_id", "sha256").orderBy("created_at", "document_id"))
    unique = staged.withColumn("_n", first).where("_n = 1").drop("_n")
    known = registered.groupBy("collection_id", "sha256").agg(F.min(F.struct("document_id", "status")).alias("_old"))
    met = unique.join(known, ["collection_id", "sha256"], "left")
    again = F.col("_old.status").isin(RESTAGE) | F.lit(force)
    return met.where(F.col("_old").isNull() | again).withColumn("document_id", F.coalesce("_old.document_id", "document_id")).drop("_old")


def public_documents(documents: DataFrame) -> DataFrame:
    """Documents as they are shown: without the path of their file."""
    return documents.drop("path")


def described(items: DataFrame, *columns: str) -> DataFrame:
    """The arrays in `columns`, which belong together place by place, as one row for each place, numbered from 1.

    Arrays of different lengths do not belong together: the job fails instead of filling up with nulls.
    """
    same = reduce(lambda a, b: a & b, [F.size(columns[0]) == F.size(c) for c in columns[1:]], F.lit(True))
    checked = F.when(same, F.arrays_zip(*columns)).otherwise(F.raise_error(F.lit(f"{', '.join(columns)} differ in length")))
    others = [c for c in items.columns if c not in columns]
    return items.select(*others, F.posexplode(checked).alias("_i", "_z")).select(*others, (F.col("_i") + 1).alias("n"), *[F.col(f"_z.{c}").alias(c) for c in columns])


def replace_content(stored: DataFrame, fresh: DataFrame, key: str = "document_id") -> DataFrame:
    """The stored rows of documents that did not change, and the fresh rows of those that did."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def upsert(stored: DataFrame, fresh: DataFrame, key: str, version: str) -> DataFrame:
    """One row for each key: the latest version, fresh rows before stored ones."""
    both = stored.withColumn("_fresh", F.lit(0)).unionByName(fresh.withColumn("_fresh", F.lit(1)))
    latest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version), F.desc("_fresh")))
    return both.withColumn("_n", latest).where("_n = 1").drop("_n", "_fresh")


def delete_cascade(deleted: DataFrame, key: str, *dependents: DataFrame) -> list[DataFrame]:
    """The dependents without rows of the deleted keys."""
    keys = deleted.select(key).distinct()
    return [d.join(keys, key, "left_anti") for d in dependents]


def patch(rows: DataFrame, changes: DataFrame, key: str, allowed: list[str], now: Column) -> DataFrame:
    """Rows with the non-null allowed values of `changes` put in and updated_at refreshed where there were any."""
    known = [c for c in allowed if c in changes.columns]
    new = changes.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in known])
    met = rows.join(new, rows[key] == new["_key"], "left")
    touched = F.coalesce(*[F.when(F.col(f"_{c}").isNotNull(), True) for c in known], F.lit(False))
    values = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in known}
    return met.withColumn("updated_at", F.when(touched, now).otherwise(F.col("updated_at"))).withColumns(values).select(*rows.columns)


def recover(rows: DataFrame) -> DataFrame:
    """After a restart nothing is active: such rows failed."""
    return rows.withColumn("status", F.when(F.col("status").isin(ACTIVE), "failed").otherwise(F.col("status")))


def startable(requested: DataFrame, jobs: DataFrame) -> DataFrame:
    """Requested documents without an active job."""
    return requested.join(jobs.where(F.col("status").isin(ACTIVE)).select("document_id").distinct(), "document_id", "left_anti")


def find_collections(wanted: DataFrame, collections: DataFrame) -> DataFrame:
    """wanted -> collection_id: by id as it is written, else by name whatever its case, else the oldest collection."""
    by = lambda how, rank: collections.select(how.alias("_k"), F.lit(rank).alias("_rank"), "collection_id", "created_at")
    keys = by(F.col("collection_id"), 1).unionByName(by(F.lower("name"), 2))
    asked = wanted.select("wanted", F.inline(F.array(F.struct(F.col("wanted").alias("_k"), F.lit(1).alias("_rank")), F.struct(F.lower("wanted").alias("_k"), F.lit(2).alias("_rank")))))
    met = asked.join(keys, ["_k", "_rank"], "left").withColumn("_rank", F.when(F.col("collection_id").isNotNull(), F.col("_rank")))
    order = F.row_number().over(Window.partitionBy("wanted").orderBy(F.col("_rank").asc_nulls_last(), "created_at", "collection_id"))
    found = met.withColumn("_n", order).where("_n = 1")
    oldest = collections.orderBy("created_at", "collection_id").limit(1).select(F.col("collection_id").alias("_default"))
    return found.select("wanted", "collection_id").join(oldest, F.lit(True), "left").select("wanted", F.coalesce("collection_id", "_default").alias("collection_id"))


def bump_versions(collections: DataFrame, changes: DataFrame) -> DataFrame:
    """version + 1 for every content change of a collection."""
    n = changes.groupBy("collection_id").agg(F.count("*").alias("_n"))
    return collections.join(n, "collection_id", "left").withColumn("version", F.col("version") + F.coalesce("_n", F.lit(0))).drop("_n")


def unique_slugs(names: DataFrame, name_col: str, order_col: str) -> DataFrame:
    """slug of every name in the order of arrival: base, or the first of base-2, base-3, ... that no earlier name has.

    All names claim a slug at once, the n-th name of a base its n-th; of those that claim the same, the first to arrive
    keeps it, and the others, with what follows in their bases, move on to the next. No name can have an earlier slug than
    it claims, so once no two claim the same the slugs are those of one name after another. Names of different bases
    meet by the slug alone; a base such as `doc-2` that arrived before the second `doc` takes one round more.
    """
    found = written(names.select(F.struct(*names.columns).alias("_own"), T.slug(F.col(name_col)).alias("_base"), F.struct(F.col(order_col), F.monotonically_increasing_id()).alias("_at")), "slug-names")
    within = Window.partitionBy("_base").orderBy("_nth").rowsBetween(Window.unboundedPreceding, 0)
    claims = found.select("_at", "_base", F.row_number().over(Window.partitionBy("_base").orderBy("_at")).alias("_nth")).withColumn("_n", F.col("_nth"))
    while True:
        slug = F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat_ws("-", "_base", F.col("_n").cast("string")))
        claims = written(claims.withColumn("slug", slug), "slug-claims")
        first = claims.groupBy("slug").agg(F.min("_at").alias("_first"), F.count("*").alias("_often")).where("_often > 1").drop("_often")
        lost = claims.join(first, "slug", "left").withColumn("_lost", F.coalesce(F.col("_at") != F.col("_first"), F.lit(False)))
        if lost.where("_lost").isEmpty():
            break
        behind = F.max(F.col("_n") + F.col("_lost").cast("int") - F.col("_nth")).over(within)
        claims = lost.select("_at", "_base", "_nth", (behind + F.col("_nth")).alias("_n"))
    return found.join(claims.select("_at", "slug"), "_at").select("_own.*", "slug")


#: Chunks of one document that are listed.
DOCUMENT_CHUNKS = 500


def document_chunks(chunks: DataFrame, limit: int = DOCUMENT_CHUNKS) -> DataFrame:
    """The first chunks of every document (document_id, page, ordinal), in its order."""
    n = F.row_number().over(Window.partitionBy("document_id").orderBy("page", "ordinal"))
    return chunks.withColumn("_n", n).where(F.col("_n") <= limit).drop("_n")


def transcripts(turns: DataFrame, owners: DataFrame) -> DataFrame:
    """conv_id, owner, roles: turns of every conversation in order; roles are null where `owners` (conv_id, owner) has none."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    roles = turns.groupBy("conv_id").agg(F.array_join(ordered, ">").alias("roles"))
    met = roles.join(owners, "conv_id", "left")
    return met.select("conv_id", "owner", F.when(F.col("owner").isNotNull(), F.col("roles")).alias("roles"))


def current_state(events: DataFrame, key: str, fields: list[str], at: str = "ts") -> DataFrame:
    """The latest values of every key; on equal times the larger values."""
    latest = F.max(F.struct(F.col(at), *[F.col(f) for f in fields]))
    return events.groupBy(key).agg(latest.alias("_s")).select(key, F.col(f"_s.{at}").alias("updated_at"), *[F.col(f"_s.{f}").alias(f) for f in fields])


def description_fallback(elements: DataFrame) -> DataFrame:
    """elements (document_id, description, caption) -> description or caption text; warnings and failure by document."""
    filled = elements.withColumn("text", F.coalesce("description", "caption", F.lit("")))
    return filled.groupBy("document_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("description").isNull()).alias("n_fallback"), F.array_join(F.sort_array(F.collect_list("text")), "|").alias("texts")
    ).withColumn("failed", (F.col("n") >= 2) & (F.col("n_fallback") == F.col("n")))


# -- statistics


def document_stats(docs: DataFrame, *keys: str) -> DataFrame:
    by = docs.groupBy(*keys) if keys else docs.groupBy()
    return by.agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "ready").alias("ready"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status").isin(ACTIVE)).alias("processing"), F.count_if(F.col("status") == "staged").alias("staged"),
        F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"), F.coalesce(F.round(F.sum("cost_usd"), 4), F.lit(0.0)).alias("cost_usd"),
    )


def modality_counts(chunks: DataFrame, *keys: str) -> DataFrame:
    by = chunks.groupBy(*keys) if keys else chunks.groupBy()
    return by.agg(*[F.count_if(F.col("modality") == m).alias(m) for m in ("text", "table", "image")], F.count("*").alias("total"))


def query_stats(queries: DataFrame) -> DataFrame:
    """By collection, and over all as collection null."""
    return queries.groupingSets([["collection_id"], []], "collection_id").agg(
        F.count("*").alias("total"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"), F.round(F.avg("latency_ms"), 3).alias("avg_latency_ms"),
        F.count_if("used_web").alias("web"), F.count_if(F.col("status") == "failed").alias("failed"),
    )


def daily_rollup(queries: DataFrame, days: int = DAILY_ROWS) -> DataFrame:
    """The newest days that have queries."""
    by_day = queries.groupBy(F.to_date("created_at").alias("day")).agg(
        F.count("*").alias("queries"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"), F.round(F.avg("latency_ms"), 3).alias("avg_latency_ms")
    )
    return by_day.orderBy(F.desc("day")).limit(days).orderBy("day")


def filled_days(daily: DataFrame, last_day: str, days: int = DAILY_ROWS) -> DataFrame:
    """The days up to last_day, zeros where there were no queries."""
    spark = daily.sparkSession
    day = spark.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(last_day).cast("date"), days - 1), F.lit(last_day).cast("date"))).alias("day"))
    return day.join(daily, "day", "left").na.fill(0)


def latency_percentiles(queries: DataFrame, keys: list[str]) -> DataFrame:
    """Nearest-rank p50 and p95 over each key's newest latencies; the rank is rounded half to even."""
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("created_at"), F.desc("event_id")))
    recent = queries.where("latency_ms IS NOT NULL").withColumn("_n", newest).where(F.col("_n") <= LATENCY_SAMPLE)
    lists = recent.groupBy(*keys).agg(F.sort_array(F.collect_list("latency_ms")).alias("_l"))
    rank = lambda p: F.element_at("_l", (F.bround((F.size("_l") - 1) * p, 0) + 1).cast("int"))
    return lists.select(*keys, rank(0.5).alias("p50"), rank(0.95).alias("p95"))


def collection_list(collections: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Visible collections with their numbers of documents, ready documents and chunks."""
    d = docs.groupBy("collection_id").agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "ready").alias("ready"))
    c = chunks.groupBy("collection_id").agg(F.count("*").alias("chunks"))
    met = collections.where("NOT hidden").join(d, "collection_id", "left").join(c, "collection_id", "left")
    return met.na.fill(0, ["documents", "ready", "chunks"])


def conversation_list(conversations: DataFrame, turns: DataFrame, limit: int) -> DataFrame:
    n = turns.groupBy("conv_id").agg(F.count("*").alias("turns"))
    return conversations.join(n, "conv_id", "left").na.fill(0, ["turns"]).orderBy(F.desc("updated_at"), "conv_id").limit(limit)


def recent_done(turns: DataFrame, n: int = 6) -> DataFrame:
    """The last n turns of each conversation, and of these the ones that are done."""
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.withColumn("_n", rank).where(F.col("_n") <= n).where("status = 'done'").drop("_n")


def conversation_messages(turns: DataFrame, n: int = 6) -> DataFrame:
    """Messages of the last n turns: a role that repeats the one kept before it goes, the first must be the user's and
    the last must not."""
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    by_turn = Window.partitionBy("conv_id").orderBy("turn")
    role = F.when(F.col("role") == "assistant", "assistant").otherwise("user")
    last = turns.withColumn("_n", rank).where(F.col("_n") <= n).withColumn("role", role)
    # of a run of equal roles the first stays, which is what dropping repeats leaves
    kept = last.withColumn("_before", F.lag("role").over(by_turn)).where("_before IS NULL OR _before <> role")
    edges = kept.withColumns({"_first": F.row_number().over(by_turn) == 1, "_last": F.lead("role").over(by_turn).isNull()})
    inner = edges.where("NOT (_first AND role = 'assistant') AND NOT (_last AND role = 'user')")
    return inner.select("conv_id", "turn", "role", F.substring("text", 1, 3000).alias("text"))
