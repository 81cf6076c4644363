"""Streams with typed state: jobs with timers, budgets with a first state, and a bounded summary of frequent entities.

They need the RocksDB state store, which `typed_state` names in the session before a query starts. What a query knows is
read back from its checkpoint by `stored_state`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scrivia.functions import text as T

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
JOB_SCHEMA = "job_id long, stage string, progress double, status string"
BUDGET_SCHEMA = "key long, event_id long, over boolean"
ENTITY_SCHEMA = "entity string, n long, missed long"
#: Entities that a summary keeps in each of its parts, and its parts.
KEPT, PARTS = 1000, 64


def typed_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def stored_state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """Keys and values of a state variable, as of the last batch of a query."""
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)


class Jobs(StatefulProcessor):
    """The latest event of every job. A timer at `idle_ms` behind it in event time tells that the job has failed; an event
    that comes later than one with a higher number changes nothing, nor does one behind the watermark."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "event_id long, stage string, progress double, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.latest.get() if self.latest.exists() else (-1, "", 0.0, 0)
        due = known[3]
        for batch in rows:
            i = int(batch["event_id"].to_numpy().argmax())
            if batch["event_id"].iat[i] > known[0]:
                known = (int(batch["event_id"].iat[i]), batch["stage"].iat[i], float(batch["progress"].iat[i]), 0)
            due = max(due, int(batch["ts"].max().timestamp() * 1000) + self.idle_ms)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(due)
        self.latest.update((*known[:3], due))
        yield pd.DataFrame({"job_id": [key[0]], "stage": [known[1]], "progress": [known[2]], "status": ["running"]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, stage, progress, _ = self.latest.get()
        self.latest.clear()
        yield pd.DataFrame({"job_id": [key[0]], "stage": [stage], "progress": [progress], "status": ["failed"]})

    def close(self) -> None:
        pass


def job_states(events: DataFrame, idle_ms: int, late: str = "10 minutes") -> DataFrame:
    """JOB_SCHEMA of events (job_id, event_id, stage, progress, ts) in update mode: running whenever a job's events come,
    failed when the watermark is `idle_ms` behind its last; then the job is forgotten."""
    typed_state(events.sparkSession)
    keyed = events.select("job_id", "event_id", "stage", "progress", "ts").withWatermark("ts", late).groupBy("job_id")
    return keyed.transformWithStateInPandas(Jobs(idle_ms), JOB_SCHEMA, "update", "eventTime")


class Budget(StatefulProcessor):
    """What every key has spent, starting from a first state, forgotten after `ttl_ms` without events."""

    def __init__(self, budget: float, ttl_ms: int | None):
        self.budget, self.ttl_ms = budget, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spent = handle.getValueState("spent", "spent double", self.ttl_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.spent.update((float(initialState["spent"].sum()),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.spent.get()[0] if self.spent.exists() else 0.0
        own = pd.concat(list(rows)).sort_values("event_id")
        total = before + own["cost_usd"].cumsum()
        counted = (total - own["cost_usd"]) <= self.budget  # the one that goes over the budget counts, none behind it
        told = own[counted]
        self.spent.update((float(total[counted].iloc[-1]) if len(told) else before,))
        yield pd.DataFrame({"key": told["key"], "event_id": told["event_id"], "over": total[counted] > self.budget})

    def close(self) -> None:
        pass


def budget_guard(costed: DataFrame, budget: float, first: DataFrame | None = None, ttl_ms: int | None = None) -> DataFrame:
    """BUDGET_SCHEMA of events (key, event_id, cost_usd) until a key's total is above the budget, in append mode. `first`
    (key, spent) is what was spent before the stream began."""
    typed_state(costed.sparkSession)
    start = None if first is None else first.groupBy("key")
    return costed.select("key", "event_id", "cost_usd").groupBy("key").transformWithStateInPandas(
        Budget(budget, ttl_ms), BUDGET_SCHEMA, "append", "processingTime" if ttl_ms else "none", start
    )


class FrequentEntities(StatefulProcessor):
    """A part's summary of at most `kept` entities: counts, and how many occurrences each may have missed.

    New entities are counted with the batch; where there are more than `kept`, the most frequent stay, and the highest
    count that goes is what any entity may have missed by then. An entity that never went has its exact count, and one
    with more occurrences than the part's misses is always kept.
    """

    def __init__(self, kept: int):
        self.kept = kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "entity string", "n long, missed long")
        self.floor = handle.getValueState("floor", "missed long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        missed = self.floor.get()[0] if self.floor.exists() else 0
        new = pd.concat([b.groupby("entity")["n"].sum() for b in rows]).groupby(level=0).sum()
        held = {k[0]: (v[0], v[1]) for k, v in self.counts.iterator()}
        before = set(held)
        for entity, n in new.items():
            had = held.get(entity, (0, missed))
            held[entity] = (had[0] + int(n), had[1])
        order = sorted(held, key=lambda e: (-(held[e][0] + held[e][1]), e))
        for entity in order[self.kept :]:
            missed = max(missed, sum(held[entity]))
            if entity in before:
                self.counts.removeKey((entity,))
        told = [e for e in order[: self.kept] if e in new.index]
        for entity in told:
            self.counts.updateValue((entity,), held[entity])
        self.floor.update((missed,))
        yield pd.DataFrame({"entity": told, "n": [held[e][0] for e in told], "missed": [held[e][1] for e in told]})

    def close(self) -> None:
        pass


def frequent_entities(chunks: DataFrame, kept: int = KEPT, parts: int = PARTS) -> DataFrame:
    """ENTITY_SCHEMA of the entities of new chunks (text), in update mode, from state of at most kept × parts entities.

    n counts an entity's occurrences since it came in, and missed is how many it may have had before: 0 where it has been
    in from the start, so that its count is exact.
    """
    typed_state(chunks.sparkSession)
    named = chunks.select(F.explode(T.proper_phrases(F.col("text"))).alias("entity"), F.lit(1).cast("long").alias("n"))
    keyed = named.withColumn("part", F.pmod(F.xxhash64("entity"), F.lit(parts))).groupBy("part")
    return keyed.transformWithStateInPandas(FrequentEntities(kept), ENTITY_SCHEMA, "update", "none")
