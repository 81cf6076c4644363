"""Typed state: timers, first states, restarts from a checkpoint, what is stored, and a bounded summary."""

from collections import Counter
from datetime import datetime

import pytest

from scrivia.streaming import stateful as S

EVENTS = "job_id long, event_id long, stage string, progress double, ts timestamp"


def at(minute):
    return datetime(2026, 1, 1, minute // 60, minute % 60)


class Replay:
    """A stream over files that are added batch by batch; every `run` starts the query anew from its checkpoint."""

    def __init__(self, spark, tmp_path, schema, mode):
        self.spark, self.schema, self.mode = spark, schema, mode
        self.source, self.checkpoint, self.n = str(tmp_path / "in"), str(tmp_path / "progress"), 0
        (tmp_path / "in").mkdir()

    def run(self, rows, make):
        if rows:
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.source)
        out = []
        stream = make(self.spark.readStream.schema(self.schema).parquet(self.source))
        q = stream.writeStream.outputMode(self.mode).foreachBatch(lambda df, n: out.extend(map(tuple, df.collect()))).option("checkpointLocation", self.checkpoint)
        q.trigger(availableNow=True).start().awaitTermination()
        return sorted(out)


def test_jobs_over_restarts(spark, tmp_path):
    jobs = Replay(spark, tmp_path, EVENTS, "update")
    make = lambda e: S.job_states(e, 30 * 60_000, "0 minutes")
    assert jobs.run([(1, 10, "read", 0.1, at(0)), (1, 11, "cut", 0.5, at(1)), (2, 12, "read", 0.2, at(2))], make) == [(1, "cut", 0.5, "running"), (2, "read", 0.2, "running")]
    # a restart with an event of a lower number: the state stays
    got = jobs.run([(1, 9, "queued", 0.0, at(20)), (3, 13, "read", 0.3, at(21))], make)
    assert (1, "cut", 0.5, "running") in got and (3, "read", 0.3, "running") in got
    assert {r.asDict()["key"]["job_id"] for r in S.stored_state(spark, jobs.checkpoint, "latest").collect()} >= {1, 3}
    # time goes on: job 2 has been idle since minute 2, job 1 since 20
    got = jobs.run([(4, 20, "read", 0.0, at(40))], make) + jobs.run([(4, 21, "cut", 0.5, at(41))], make)
    assert (2, "read", 0.2, "failed") in got and (1, "cut", 0.5, "failed") not in got
    # an event behind the watermark is dropped
    assert not [r for r in jobs.run([(9, 30, "read", 0.0, at(3))], make) if r[0] == 9]


def test_budgets_start_from_what_was_spent(spark, tmp_path):
    costs = Replay(spark, tmp_path, "key long, event_id long, cost_usd double", "append")
    first = spark.createDataFrame([(1, 0.9)], "key long, spent double")
    make = lambda e: S.budget_guard(e, 1.0, first)
    assert costs.run([(1, 2, 0.05), (1, 3, 0.2), (1, 4, 0.1), (2, 5, 0.4)], make) == [(1, 2, False), (1, 3, True), (2, 5, False)]
    assert costs.run([(1, 6, 0.1), (2, 7, 0.7), (2, 8, 0.1)], make) == [(2, 7, True)]
    spent = {r["key"]["key"]: r["value"]["spent"] for r in S.stored_state(spark, costs.checkpoint, "spent").collect()}
    assert spent[1] == pytest.approx(1.15) and spent[2] == pytest.approx(1.1)


def test_entity_summary_is_bounded(spark, tmp_path):
    texts = Replay(spark, tmp_path, "text string", "update")
    make = lambda c: S.frequent_entities(c, kept=5, parts=2)
    exact, latest = Counter(), {}
    for batch in range(3):
        rows = [("; ".join(f"Often{i}a" for i in range(3) for _ in range(20 - i)),), ("; ".join(f"Rare{batch}x{i}a" for i in range(40)),)]
        exact.update(w.lower() for r in rows for w in r[0].split("; "))
        for entity, n, missed in texts.run(rows, make):
            latest[entity] = (n, missed)
    stored = S.stored_state(spark, texts.checkpoint, "counts").count()
    assert stored <= 5 * 2
    assert all(latest[f"often{i}a"] == (exact[f"often{i}a"], 0) for i in range(3))
    assert all(n <= exact[e] <= n + missed for e, (n, missed) in latest.items())
