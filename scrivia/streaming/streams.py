"""Incremental forms of the batch jobs with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scrivia.functions import text as T


def ingest_new(registry_path: str, write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: documents (sha256, ...) that no earlier batch had. The registry is exact over all history; a
    batch that is repeated after a failure finds its own rows by batch number and writes the same again."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["sha256"])
        try:
            known = spark.read.schema("sha256 string, batch long").parquet(registry_path).where(F.col("batch") < number)
            fresh = fresh.join(known.select("sha256"), "sha256", "left_anti")
        except Exception as e:  # the first batch has no registry yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        write(fresh, number)
        fresh.select("sha256").withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(registry_path)

    return each


def usage_windows(queries: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Windows of queries (created_at, cost_usd, latency_ms); rows later than `late` behind the watermark are dropped."""
    window = F.window("created_at", size, slide) if slide else F.window("created_at", size)
    return (
        queries.withWatermark("created_at", late).groupBy(window.alias("w"))
        .agg(F.count("*").alias("queries"), F.sum("cost_usd").alias("cost_usd"), F.avg("latency_ms").alias("avg_latency_ms"))
        .select(F.col("w.start").alias("start"), "queries", F.round("cost_usd", 4).alias("cost_usd"), F.round("avg_latency_ms", 3).alias("avg_latency_ms"))
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of activity of every user."""
    s = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def entity_counts(chunks: DataFrame) -> DataFrame:
    """Running counts of the entities of new chunks."""
    return chunks.select(F.explode(T.proper_phrases(F.col("text"))).alias("entity")).groupBy("entity").agg(F.count("*").alias("n"))


def job_states(events: DataFrame, idle_ms: int | None = 60_000) -> DataFrame:
    """The latest stage and progress of every job as it changes; a job that is idle for too long has failed (None: a
    job may be idle for ever)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            at, stage, progress = state.get
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "stage": [stage], "progress": [progress], "status": ["failed"]})
            return
        best = state.get if state.exists else (-1, "", 0.0)
        for batch in batches:
            for row in batch.itertuples():
                best = max(best, (row.event_id, row.stage, row.progress))
        state.update(best)
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"job_id": [key[0]], "stage": [best[1]], "progress": [best[2]], "status": ["running"]})

    return events.groupBy("job_id").applyInPandasWithState(
        step, "job_id long, stage string, progress double, status string", "event_id long, stage string, progress double", "update",
        GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout,
    )


def budget_guard(costed: DataFrame, budget: float) -> DataFrame:
    """Events (key, event_id, cost_usd) until the key's total is above the budget; `over` marks the last one.

    Events count in the order of their micro-batches, and by event_id within one: an event that arrives late is added
    to what was spent by then, and one that arrives after its key went over the budget is left out."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(batches)).sort_values("event_id")
        out = []
        for event_id, cost in zip(rows["event_id"], rows["cost_usd"]):
            if spent > budget:
                break
            spent += cost
            out.append((key[0], event_id, spent > budget))
        state.update((spent,))
        yield pd.DataFrame(out, columns=["key", "event_id", "over"])

    return costed.groupBy("key").applyInPandasWithState(step, "key long, event_id long, over boolean", "spent double", "append", GroupStateTimeout.NoTimeout)
