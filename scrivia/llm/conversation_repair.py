"""Repair of the turn structure of conversations by cheapest edits.

A repaired conversation has the role initials `(s?(ua)+)?`: perhaps a system turn, then pairs of user and assistant.
Turns are kept (0), given another role (2), deleted (3; blank and repeated turns must be) or inserted without text (2);
a truncated turn that stays costs 1 more. Of the cheapest edits those whose initials are ASCII-least are taken.

The turns of all conversations are sorted by ranges as narrow rows (no texts), so that a conversation of any length lies
in the parts of many tasks. A dynamic programme runs backward over them. It keeps cost vectors of the four states at
checkpoints only: at the cuts of every square root of a part's rows, and where a conversation goes on in the next part.
Between checkpoints costs are computed again while the walk goes forward and emits tight edits. What a block does to a
cost vector is a min-plus matrix, so blocks and parts are prepared side by side and chained afterwards.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivia.llm.common import stash, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
#: States: nothing yet, a system turn, a user turn that waits for its answer, whole pairs; one more for what can't be.
STATES, NEVER = 4, 4
#: The state behind an insertion or another role, and that role's initial, by state.
FILL, FILLED = np.array([2, 2, 3, 2]), "uuau"
#: The state behind a turn that is kept, by its kind (others, s, u, a) and the state before.
KEPT = np.array([[4, 4, 4, 4], [1, 4, 4, 4], [2, 2, 4, 2], [4, 4, 3, 4]])
#: Cost of ending in each state, and the roles that are inserted then.
END, ENDING = np.array([0, 2 * INSERT, INSERT, 0]), ["", "ua", "a", ""]
INFINITE = 1 << 40
#: Cells (blocks x turns of the longest) that are worked on at once.
CELLS = 1 << 17
EDITS_SCHEMA = "part long, pos long, letters string, roles string"


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of `conversations` with test damage: conv_id, turn, role, text, and copies (0 if dropped, 2 if repeated).

    A null role or text is one space; so is a null conv_id or turn in the checksum that picks the damage.
    """
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), as_text("role").alias("role"), as_text("text").alias("text"),
        (F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")).cast("binary")) % 20).alias("_damage"),
    )
    text = F.when(F.col("_damage") == 1, "").when(F.col("_damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_damage") == 0, 0).when(F.col("_damage") == 3, 2).otherwise(1)
    role = F.when(F.col("_damage") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.cast("long").alias("copies"))


def digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def turns_in_order(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """One narrow row for equal turns: conv_id, turn, role, digest, n (how many), fault of the first, part, pos.

    Within a conversation order is by turn (nulls first), role, and the checksum of the text. Equal turns are added up
    in their tasks first. A conversation whose rows are all dropped keeps a row with n = 0.
    """
    text, gone = F.col("text"), F.col("copies") == 0
    last = F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", "blank").when(~last.rlike("[.!?]"), "truncated").otherwise("")
    seen = rows.select(
        "conv_id",
        F.when(~gone, F.col("turn")).alias("turn"),
        F.when(~gone, F.col("role")).alias("role"),
        F.when(~gone, digest(text)).alias("digest"),
        F.when(~gone, fault).alias("fault"),
        "copies",
    )
    turns = seen.groupBy("conv_id", "turn", "role", "digest", "fault").agg(F.sum("copies").alias("n"))
    # the first turn with a role and text: nulls come first, which min() would skip
    by_turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = turns.where("n > 0").groupBy("conv_id", "role", "digest").agg(F.min(by_turn).alias("first"), F.count("*").alias("_often")).where("_often > 1")
    t, f = turns.alias("t"), firsts.alias("f")
    same = F.col("t.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("t.role") == F.col("f.role")) & (F.col("t.digest") == F.col("f.digest"))
    later = F.col("f.first").isNotNull() & ~F.col("t.turn").eqNullSafe(F.col("f.first.turn"))
    told = t.join(f, same, "left").select(
        "t.conv_id", "t.turn", "t.role", "t.digest", "t.n",
        F.when((F.col("t.fault") != "blank") & later, "duplicate").otherwise(F.col("t.fault")).alias("fault"),
    )
    keys = [F.col(k).asc_nulls_first() for k in ("conv_id", "turn", "role", "digest")]
    dealt = told.repartitionByRange(parts, *keys) if parts else told.repartitionByRange(*keys)
    ordered = dealt.sortWithinPartitions(*keys).select("*", F.spark_partition_id().cast("long").alias("part"), F.monotonically_increasing_id().alias("pos"))
    return stash(ordered, "conversation-turns")


class Part:
    """The turns of one part in order, as arrays; pieces are what it holds of each conversation."""

    def __init__(self, part: int, pos: np.ndarray, conv: list, kind: np.ndarray, forced: np.ndarray, truncated: np.ndarray, n: np.ndarray):
        self.part, self.pos, self.n = part, pos, n
        self.kind, self.forced, self.truncated = kind, forced, truncated
        new = [i for i in range(len(conv)) if i == 0 or conv[i] != conv[i - 1]]
        self.pieces = list(zip(new, [*new[1:], len(conv)]))
        self.first, self.last = conv[0], conv[-1]

    def blocks(self, piece: tuple[int, int]) -> list[tuple[int, int]]:
        a, b = piece
        step = max(16, math.isqrt(len(self.pos)))
        return [(i, min(i + step, b)) for i in range(a, b, step)]

    def groups(self, blocks: list[tuple[int, int]]) -> Iterator[list[int]]:
        """Indices of blocks of like length, so many as fill CELLS."""
        order = sorted(range(len(blocks)), key=lambda i: blocks[i][0] - blocks[i][1])
        at = 0
        while at < len(order):
            longest = blocks[order[at]][1] - blocks[order[at]][0]
            end = min(len(order), at + max(1, CELLS // longest))
            while blocks[order[end - 1]][1] - blocks[order[end - 1]][0] < longest // 2:
                end -= 1
            yield order[at:end]
            at = end

    def cells(self, blocks: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Index of each block's j-th turn, and whether there is one."""
        starts, ends = np.array(blocks).T
        index = starts[:, None] + np.arange((ends - starts).max())
        return np.minimum(index, ends[:, None] - 1), index < ends[:, None]

    def back(self, costs: np.ndarray, turn: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """Costs before a turn from the costs behind it: blocks x (states and NEVER) x columns."""
        add = self.truncated[turn][:, None, None]
        kept = np.take_along_axis(costs, KEPT[self.kind[turn]][:, :, None], 1) + (KEEP + add)
        rerole = costs[:, FILL] + (REROLE + add)
        stays = np.where(self.forced[turn][:, None, None], INFINITE, np.minimum(kept, rerole))
        used = np.minimum(stays, costs[:, :STATES] + DELETE)
        out = np.full_like(costs, INFINITE)
        out[:, 2] = np.minimum(used[:, 2], used[:, 3] + INSERT)
        out[:, 3] = np.minimum(used[:, 3], used[:, 2] + INSERT)
        out[:, :2] = np.minimum(used[:, :2], out[:, 2:3] + INSERT)
        return np.where(valid[:, None, None], out, costs)

    def matrices(self, blocks: list[tuple[int, int]]) -> np.ndarray:
        """What each block does: the cost of getting from each state before it to each state behind it."""
        out = np.empty((len(blocks), STATES, STATES), np.int64)
        for some in self.groups(blocks):
            index, valid = self.cells([blocks[i] for i in some])
            costs = np.full((len(some), STATES + 1, STATES), INFINITE)
            costs[:, range(STATES), range(STATES)] = 0
            for j in reversed(range(index.shape[1])):
                costs = self.back(costs, index[:, j], valid[:, j])
            out[some] = costs[:, :STATES]
        return out

    def matrix(self, piece: tuple[int, int]) -> np.ndarray:
        whole = None
        for m in reversed(self.matrices(self.blocks(piece))):
            whole = m if whole is None else (m[:, :, None] + whole[None]).min(1)
        return np.minimum(whole, INFINITE)

    def walk(self, blocks: list[tuple[int, int]], exits: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tight, ASCII-least edits of blocks whose costs behind them (exits) and states before them are known.

        Returns the states behind the blocks, and for every turn of the part (0 where no block has it) the state before
        it, the insertions before it and its edit's initial.
        """
        ends = np.empty(len(blocks), np.int64)
        before, inserts, edits = (np.zeros(len(self.pos), np.int8) for _ in range(3))
        for some in self.groups(blocks):
            index, valid = self.cells([blocks[i] for i in some])
            lanes, width = np.arange(len(some)), index.shape[1]
            costs = np.full((width + 1, len(some), STATES + 1), INFINITE)
            costs[width, :, :STATES] = exits[some]
            for j in reversed(range(width)):
                costs[j] = self.back(costs[j + 1][:, :, None], index[:, j], valid[:, j])[:, :, 0]
            state = entries[some].copy()
            for j in range(width):
                turn, here, there = index[:, j], costs[j], costs[j + 1]
                start, added = state.copy(), np.zeros(len(some), np.int8)
                delete = there[lanes, state] + DELETE == here[lanes, state]
                insert = valid[:, j] & ~delete & (here[lanes, FILL[state]] + INSERT == here[lanes, state])
                while insert.any():
                    added += insert
                    state = np.where(insert, FILL[state], state)
                    delete = there[lanes, state] + DELETE == here[lanes, state]
                    insert &= ~delete & (here[lanes, FILL[state]] + INSERT == here[lanes, state])
                kept = KEPT[self.kind[turn], state]
                keep = ~self.forced[turn] & (there[lanes, kept] + KEEP + self.truncated[turn] == here[lanes, state])
                ok = valid[:, j]
                before[turn[ok]], inserts[turn[ok]] = start[ok], added[ok]
                edits[turn[ok]] = np.where(delete, ord("D"), np.where(keep, ord("K"), ord("R")))[ok]
                state = np.where(~ok | delete, state, np.where(keep, kept, FILL[state]))
            ends[some] = state
        return ends, before, inserts, edits

    def edits(self, exit_costs: np.ndarray, goes_on: bool, entry: int) -> pa.RecordBatch:
        """EDITS_SCHEMA of the part. The last conversation may go on in the next part, the first start in one before."""
        blocks = [self.blocks(p) for p in self.pieces]
        flat, at = [b for some in blocks for b in some], 0
        exits, entries, many = np.tile(END, (len(flat), 1)), np.zeros(len(flat), np.int64), []
        exits[-1], entries[0] = exit_costs, entry
        for some in blocks:
            if len(some) > 1:
                many.append(range(at, at + len(some)))
            at += len(some)
        for lanes in many:  # checkpoints, from the last block to the first
            behind = self.matrices([flat[i] for i in lanes])
            for i in reversed(lanes[:-1]):
                exits[i] = (behind[i + 1 - lanes[0]] + exits[i + 1]).min(1)
        if many:  # the states in which blocks end, whatever they start with, then chained
            inner = [i for lanes in many for i in lanes[:-1]]
            ends = np.stack([self.walk([flat[i] for i in inner], exits[inner], np.full(len(inner), s))[0] for s in range(STATES)], 1)
            ends_of = dict(zip(inner, ends))
            for lanes in many:
                for i in lanes[:-1]:
                    entries[i + 1] = ends_of[i][entries[i]]
        ends, before, inserts, edits = self.walk(flat, exits, entries)
        letters, roles = [], []
        for s, k, e in zip(before.tolist(), inserts.tolist(), edits.tolist()):
            put = ""
            for _ in range(k):
                put += FILLED[s]
                s = int(FILL[s])
            letters.append("I" * k + chr(e))
            roles.append(put + (FILLED[s] if e == ord("R") else "-"))
        for i in np.flatnonzero(self.n != 1).tolist():
            more = int(self.n[i]) - 1
            letters[i], roles[i] = (letters[i] + "D" * more, roles[i] + "-" * more) if more > 0 else ("", "")
        at = 0
        for some in blocks[: len(blocks) - goes_on]:
            at += len(some)
            last, put = some[-1][1] - 1, ENDING[ends[at - 1]]
            letters[last], roles[last] = letters[last] + "I" * len(put), roles[last] + put
        part = pa.array(np.full(len(self.pos), self.part))
        return pa.RecordBatch.from_arrays([part, pa.array(self.pos), pa.array(letters, pa.string()), pa.array(roles, pa.string())], ["part", "pos", "letters", "roles"])


def _part(rows: list[pa.Table]) -> Part:
    t = pa.concat_tables(rows)
    fault, n = t["fault"].to_pylist(), t["n"].to_numpy()
    kind = np.array(["sua".find(i or " ") + 1 for i in t["initial"].to_pylist()], np.int64)
    # a turn that is not there is passed over like a deletion, which costs the same in every state
    forced = np.array([f in ("blank", "duplicate") for f in fault]) | (n == 0)
    return Part(t["part"][0].as_py(), t["pos"].to_numpy(), t["conv_id"].to_pylist(), kind, forced, np.array([int(f == "truncated") for f in fault]), n)


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[Part]:
    """Parts one after another; a task may get several, one after another."""
    held: list[pa.Table] = []
    for batch in batches:
        at, parts = 0, batch.column("part").to_numpy()
        for cut in [*(np.flatnonzero(parts[1:] != parts[:-1]) + 1), len(parts)]:
            if cut > at:
                if held and held[-1]["part"][0].as_py() != parts[at]:
                    yield _part(held)
                    held = []
                held.append(pa.Table.from_batches([batch.slice(at, cut - at)]))
            at = cut
    if held:
        yield _part(held)


def _summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for p in _parts(batches):
        first = p.matrix(p.pieces[0])
        row = {"part": p.part, "first": p.first, "last": p.last, "single": len(p.pieces) == 1, "matrix": first.ravel().tolist()}
        yield pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("single", pa.bool_()), ("matrix", pa.list_(pa.int64()))]))


def repair_edits(turns: DataFrame) -> DataFrame:
    """EDITS_SCHEMA for the rows of `turns_in_order`: edits' initials in order, and the roles that they give (`-`: none).

    The driver holds one row of 200 bytes a part, from which costs and states at the cuts between parts are chained.
    """
    narrow = turns.select("part", "pos", "conv_id", F.substring("role", 1, 1).alias("initial"), "fault", "n")
    dealt = narrow.repartition("part").sortWithinPartitions("part", "pos")
    found = sorted(dealt.mapInArrow(_summaries, "part long, first long, last long, single boolean, matrix array<long>").collect())
    goes_on = {p.part: p.last == q.first for p, q in zip(found, found[1:])}
    exits, before = {}, END
    for p in reversed(found):
        exits[p.part] = before if goes_on.get(p.part) else END
        before = (np.array(p.matrix).reshape(STATES, STATES) + (exits[p.part] if p.single else END)).min(1)
    sc, entries = turns.sparkSession.sparkContext, {}
    known = sc.broadcast({k: exits[k] for k, on in goes_on.items() if on})

    def ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state in which a part's last conversation goes on, for each in which its piece may start."""
        for p in _parts(batches):
            if p.part not in known.value:
                continue
            exits_of = [known.value[p.part]]
            blocks = p.blocks(p.pieces[-1])
            for m in reversed(p.matrices(blocks[1:]) if len(blocks) > 1 else []):
                exits_of.append((m + exits_of[-1]).min(1))
            reached = np.arange(STATES)
            step = np.stack([p.walk(blocks, np.stack(exits_of[::-1]), np.full(len(blocks), s))[0] for s in range(STATES)], 1)
            for to in step:
                reached = to[reached]
            yield pa.RecordBatch.from_pylist([{"part": p.part, "ends": reached.tolist()}], pa.schema([("part", pa.int64()), ("ends", pa.list_(pa.int64()))]))

    if known.value:
        reached, state = dict(dealt.mapInArrow(ends, "part long, ends array<long>").collect()), 0
        for p, q in zip(found, found[1:]):
            state = reached[p.part][entries.get(p.part, 0) if p.single else 0] if goes_on[p.part] else 0
            entries[q.part] = state
    starts = sc.broadcast(entries)

    def edits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in _parts(batches):
            yield p.edits(known.value.get(p.part, END), p.part in known.value, starts.value.get(p.part, 0))

    return dealt.mapInArrow(edits, EDITS_SCHEMA)


MERGED = ["conv_id", "turn", "role", "digest", "side", "pos", "letters", "roles", "fault", "n", "text"]


def _merged(rows: DataFrame, turns: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits, and behind each the row that it is about: two sides of one sort, in place of a join."""
    told = turns.join(edits.drop("part"), "pos").select("*", F.lit(0).alias("side"), F.lit(None).cast("string").alias("text"))
    texts = rows.where("copies > 0").withColumns({"digest": digest(F.col("text")), "side": F.lit(1)})
    return told.select(MERGED).unionByName(texts.select("conv_id", "turn", "role", "digest", "side", "text"), allowMissingColumns=True)


def _applied(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[dict, list[tuple[str, str]]]]:
    """Each edit with the turns that it leaves."""
    waiting = None
    for batch in batches:
        for row in batch.to_pylist():
            if row["side"] == 0:
                if "K" in row["letters"] or "R" in row["letters"]:
                    waiting = row
                    continue
                edit, text = row, ""
            elif waiting is not None:
                edit, text, waiting = waiting, row["text"], None
            else:
                continue  # deleted, or one more of equal turns
            given = {"K": lambda r: (edit["role"], text), "R": lambda r: (ROLES[r], text), "I": lambda r: (ROLES[r], "")}  # noqa: B023
            yield edit, [given[e](r) for e, r in zip(edit["letters"], edit["roles"]) if e != "D"]


def repaired_turns(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """The repaired conversations, one row a turn: conv_id, pos, nth, role, text; order is by pos and nth within it.

    `rows` has conv_id, turn, role, text, copies (how often the row counts), as `damaged` gives them; roles and texts are
    not null. Other columns are not read. Long conversations are dealt over several tasks.
    """
    turns = turns_in_order(rows, parts)
    keys = [F.col(k).asc_nulls_first() for k in ("conv_id", "turn", "role", "digest")]
    merged = _merged(rows, turns, repair_edits(turns)).repartitionByRange(*keys).sortWithinPartitions(*keys, "side")

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "pos", "nth", "role", "text"]
        for edit, left in _applied(batches):
            if left:
                rows = [(edit["conv_id"], edit["pos"], i, role, text) for i, (role, text) in enumerate(left)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()))], names)

    return merged.mapInArrow(apply, "conv_id long, pos long, nth int, role string, text string")


SUMMARY_SCHEMA = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


class Summary:
    """One conversation's faults, edits and checksum, added up turn by turn."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.audit, self.sha, self.told = conv_id, [], hashlib.sha256(), False
        self.low = self.high = self.initial = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0

    def add(self, edit: dict, left: list[tuple[str, str]]) -> None:
        for role, text in left:
            self.sha.update((("\n" if self.told else "") + role + ":" + text).encode())
            self.told = True
        n, fault, letters = edit["n"], edit["fault"], edit["letters"]
        self.audit.append(letters)
        self.cost += REROLE * letters.count("R") + DELETE * letters.count("D") + INSERT * letters.count("I")
        if not n:
            return
        if edit["turn"] is not None:
            if edit["turn"] != self.high:
                self.turns, self.high = self.turns + 1, edit["turn"]
            self.low = edit["turn"] if self.low is None else self.low
        self.illegal += n - 1
        initial = edit["role"][:1]
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        if fault == "blank":
            self.blank += n
        else:
            self.duplicate += n - 1 + (fault == "duplicate")
            self.truncated += fault == "truncated"
            self.cost += TRUNCATED * (fault == "truncated" and ("K" in letters or "R" in letters))

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SUMMARY_SCHEMA.split(", ")]
    types = [pa.string() if c.endswith("string") else pa.int64() for c in SUMMARY_SCHEMA.split(", ")]
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
    now, rows = None, []
    for edit, left in _applied(batches):
        if now is None or now.conv_id != edit["conv_id"]:
            if now is not None:
                rows.append(now.row())
            now = Summary(edit["conv_id"])
            if len(rows) == 1000:
                yield batch_of(rows)
                rows = []
        now.add(edit, left)
    if now is not None:
        yield batch_of([*rows, now.row()])


def repair_conversations(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """SUMMARY_SCHEMA of every conv_id of `rows` (as in `repaired_turns`), null ids too; empty tables give no rows.

    Faults: blank (no character but white space), duplicate (role and text seen earlier), truncated (the last such
    character is none of `.!?`); a turn's first fault counts. A role that is empty has no initial and can't be kept. A
    checksum needs its conversation's texts one after another, so they pass one task as a stream, never held.
    """
    turns = turns_in_order(rows, parts)
    keys = [F.col(k).asc_nulls_first() for k in ("conv_id", "turn", "role", "digest")]
    merged = _merged(rows, turns, repair_edits(turns)).repartition("conv_id").sortWithinPartitions(*keys, "side")
    return merged.mapInArrow(_summed, SUMMARY_SCHEMA)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")))


OP11_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations),
damage AS (  -- CRC-32, eight shifts a character
  SELECT *, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i::INT, 1))::BIGINT)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                                 lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)),
      4294967295) % 20 AS d
  FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role,
         CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM damage, range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS tail
  FROM damaged),
turns AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS initial,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS previous,
         CASE WHEN tail = '' THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(tail, '[.!?]') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
faults AS (
  SELECT conv_id, max(i) AS n,
         coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (previous IS NOT NULL AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv_id),
-- states: 0 nothing, 1 system, 2 user turn without answer, 3 whole pairs; an insertion may come before a turn's own edit
fills (s, f, filled) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
befores AS (
  SELECT s, s AS f, '' AS letter, '' AS put, 0 AS cost FROM fills
  UNION ALL SELECT s, f, 'I', filled || ':' || chr(10), 2 FROM fills),
keeps (s, initial, f) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
walks AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS s, 0::BIGINT AS cost, '' AS audit, '' AS put FROM faults
  UNION ALL
  SELECT conv_id, i, s, cost, audit, put FROM (
    SELECT w.conv_id, t.i, e.s, w.cost + b.cost + e.cost AS cost, w.audit || b.letter || e.letter AS audit, w.put || b.put || e.put AS put,
           row_number() OVER (PARTITION BY w.conv_id, e.s ORDER BY w.cost + b.cost + e.cost, w.audit || b.letter || e.letter) AS nth
    FROM walks w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1
    JOIN befores b ON b.s = w.s
    JOIN LATERAL (
      SELECT b.f AS s, 3 AS cost, 'D' AS letter, '' AS put
      UNION ALL SELECT k.f, (t.fault = 'truncated')::INT, 'K', t.role || ':' || t.text || chr(10)
        FROM keeps k WHERE k.s = b.f AND k.initial = t.initial AND t.fault NOT IN ('blank', 'duplicate')
      UNION ALL SELECT x.f, 2 + (t.fault = 'truncated')::INT, 'R', x.filled || ':' || t.text || chr(10)
        FROM fills x WHERE x.s = b.f AND t.fault NOT IN ('blank', 'duplicate')) e ON true)
  WHERE nth = 1),
ends (s, letters, put, cost) AS (VALUES
  (0, '', '', 0), (1, 'II', 'user:' || chr(10) || 'assistant:' || chr(10), 4), (2, 'I', 'assistant:' || chr(10), 2), (3, '', '', 0)),
best AS (
  SELECT w.conv_id, w.cost + e.cost AS cost, w.audit || e.letters AS audit, w.put || e.put AS put,
         row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + e.cost, w.audit || e.letters) AS nth
  FROM walks w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.i JOIN ends e ON e.s = w.s)
SELECT c.conv_id, coalesce(f.gaps, 0)::BIGINT AS gaps, coalesce(f.blank, 0)::BIGINT AS blank, coalesce(f.duplicate, 0)::BIGINT AS duplicate,
       coalesce(f.truncated, 0)::BIGINT AS truncated, coalesce(f.illegal, 0)::BIGINT AS illegal, coalesce(b.cost, 0)::BIGINT AS cost,
       coalesce(b.audit, '') AS audit, sha256(coalesce(left(b.put, length(b.put) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.nth = 1
"""
