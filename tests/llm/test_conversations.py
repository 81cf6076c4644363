"""Conversation repair against all edit scripts of short conversations, and against SQL where one conversation fills many parts."""

import hashlib
import heapq
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from scrivia.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("ua", "u"): "u", ("u", "a"): "ua"}


def cheapest(turns):
    """Dijkstra over (turns done, state), by (cost, audit)."""
    heap, seen, done = [(0, "", 0, "", ())], {}, set()
    for i, (role, text) in enumerate(turns):
        last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        seen[i] = "blank" if not last else "duplicate" if (role, text) in turns[:i] else "truncated" if last not in ".!?" else ""
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(turns) and state in ("", "ua"):
            return cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest(), seen
        if (i, state, audit) in done:
            continue
        done.add((i, state, audit))
        put = lambda c, letter, n, role, text: (r := NEXT.get((state, role[:1]))) and heapq.heappush(heap, (cost + c, audit + letter, n, r, (*out, f"{role}:{text}")))  # noqa: B023, E731
        if cost < 3 * len(turns) + 1:
            for role in ("user", "assistant"):
                put(2, "I", i, role, "")
        if i < len(turns):
            (role, text), fault = turns[i], seen[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                put(more, "K", i + 1, role, text)
                for other in ("user", "assistant"):
                    put(2 + more, "R", i + 1, other, text)


def test_edits_equal_the_least_of_all_scripts(spark):
    rnd, rows = random.Random(7), []
    for conv in range(150):
        for turn in range(rnd.randint(1, 6)):
            role = rnd.choice(["user", "assistant", "system", "tool", "User", "u"])
            rows.append((conv, turn, role, rnd.choice(["a.", "b!", "c", " \t", "", "d? \n", "e. f", "é?"])))
    got = {r.conv_id: r for r in repair.repair_conversations(spark.createDataFrame(rows, SCHEMA).withColumn("copies", F.lit(1).cast("long")), parts=3).collect()}
    for conv in range(150):
        turns = [(r, t) for c, _, r, t in rows if c == conv]
        cost, audit, sha, faults = cheapest(turns)
        row, count = got[conv], lambda f: list(faults.values()).count(f)  # noqa: B023
        assert (row.cost, row.audit, row.repaired_sha256) == (cost, audit, sha), turns
        assert (row.blank, row.duplicate, row.truncated) == (count("blank"), count("duplicate"), count("truncated"))
    assert len(got) == 150


def by_sql(spark, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    return sorted(con.execute(repair.OP11_SQL).fetchall(), key=str)


def turn_rows(rnd, conv, turns):
    return [(conv, t, rnd.choice(["user", "assistant", None, "system"]), f"{rnd.choice('abcdefgh')} {rnd.randint(0, len(turns))}{rnd.choice(['.', '!', '?', '', ' '])}") for t in turns]


@pytest.mark.parametrize("parts", [1, 5])
def test_one_conversation_over_many_parts(spark, parts):
    rnd = random.Random(parts)
    rows = turn_rows(rnd, 4, range(600)) + turn_rows(rnd, 5, range(90)) + [r for c in range(6, 40) for r in turn_rows(rnd, c, range(c % 7))]
    got = repair.repair_conversations(repair.damaged(spark.createDataFrame(rows, SCHEMA)), parts)
    assert sorted(map(tuple, got.collect()), key=str) == by_sql(spark, rows)


def test_odd_rows(spark):
    odd = [(None, None, None, None), (None, 1, "user", "a."), (1, None, "user", "x."), (1, None, "user", None), (1, 5, "", "no role."), (1, 5, "assistant", "y" * 100_000)]
    odd += [(2, 3, "user", "same.")] * 40 + [(3, t, None, None) for t in range(30)] + [(7, 7, "assistant", "one") for _ in range(2)]
    extra = spark.createDataFrame(odd, SCHEMA).withColumns({n: F.lit(1) for n in ("copies", "part", "pos", "n", "digest", "_damage", "fault", "side")})
    # an empty role matches no state in SQL either
    assert sorted(map(tuple, repair.repair_conversations(repair.damaged(extra), 3).collect()), key=str) == by_sql(spark, odd)
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.repair_conversations(repair.damaged(empty)).count() == 0 and repair.repaired_turns(repair.damaged(empty)).count() == 0


def test_repaired_turns_have_the_shape_and_the_checksum(spark, sf_dir):
    rows = repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    want = {r.conv_id: r.repaired_sha256 for r in repair.repair_conversations(rows).collect()}
    turns = {}
    for r in repair.repaired_turns(rows, 3).orderBy("conv_id", "pos", "nth").collect():
        turns.setdefault(r.conv_id, []).append(r)
    for conv, sha in want.items():
        left = turns.get(conv, [])
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in left).encode()).hexdigest() == sha
        initials = "".join(r.role[0] for r in left).removeprefix("s")
        assert initials == "ua" * (len(left) // 2)
