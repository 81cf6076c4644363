"""Best-fit packing of documents' tokens into sequences of one size, with certified bounds.

Pieces are dealt over partitions, and each partition packs its own by best fit, longest first. Dual feasible functions
give a lower bound of the sequences that the partition's lengths need; where as many were opened, the partition is
certified. Partitions open their emptiest sequences again, the more the wider their gap (certified ones a few, since
rounding up costs each partition up to one), groups of partitions exchange these documents, pack them together, and keep
the result where it needs fewer sequences. Rounds go on over ever larger groups until the bound of the whole table is met
or few groups are left.
"""

from __future__ import annotations

import bisect
import itertools
import os
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructType

from scrivia.llm.common import hold_cache, input_partitions, stash, table

BYTE_MODEL = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
SIZE = 1024
#: Words that a worker keeps; longer ones are not kept. Texts whose new words are encoded together.
CACHED, LONGEST_KEPT, TOGETHER = 600_000, 64, 256
#: Rows of a partition at most (and at least, while there are more shuffle partitions to use).
PART_ROWS, LEAST_ROWS = 500_000, 20_000
#: Partitions whose open sequences are packed together; sequences that a partition opens, and again for each one above
#: its bound.
GROUP, OPENED = 8, 32
#: The functions u(k) that are tried beside those that drop small and round up large lengths.
ROUNDINGS = 24
#: A sequence's id: round, partition, number.
ROUND_BITS, PART_BITS = 56, 32
PIECE_SCHEMA = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


class ByteWords:
    """Words with a blank in front, and first words of lines -> their ids as the bytes of little-endian int32.

    The tokenizer cuts before each blank between two characters that are no white space, and around such a line break.
    Texts with other white space at a word's end, or with its special string, are encoded whole.
    """

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(model)
        self.model.no_truncation()
        self.model.no_padding()
        self.special, *more = [t.content for t in self.model.get_added_tokens_decoder().values()]
        if hasattr(self.model.model, "_resize_cache"):  # words are kept here
            self.model.model._resize_cache(0)
        vocabulary = self.model.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # a byte is one character of a token
            self.n_bytes[i] = len(token)
        self.spaced: dict[str, bytes | None] = {"": None}
        self.first: dict[str, bytes | None] = {"": None}
        self.line = self._bytes(self._ids("\n"))
        self.signs = {s: self._bytes(self._ids(s)) for s in ".,;:!?"}
        assert not more and self._ids("it's a\nb, c!\n1 2") == [i for w in ("it's", " a", "\n", "b,", " c!", "\n", "1", " 2") for i in self._ids(w)]

    def _ids(self, text: str) -> list[int]:
        return self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids

    @staticmethod
    def _bytes(ids: list) -> bytes:
        return np.array(ids, "<i4").tobytes()

    def learn(self, words: set[str], blank: str, known: dict[str, bytes | None]) -> dict[str, bytes | None]:
        """Encode new words; those that are too long to keep are returned."""
        if len(known) > CACHED:  # the first ones seen are the frequent ones
            for key in list(itertools.islice(reversed(known), CACHED // 2)):
                if key:
                    del known[key]
        new, passing, plain, signed = words.difference(known), {}, set(), []
        for w in new:
            if w[0].isspace() or w[-1].isspace():
                known[w] = None
            elif len(w) > LONGEST_KEPT:
                passing[w] = self._bytes(self._ids(blank + w))
            elif w[-1] in self.signs and w[-2:-1].isalpha():  # a sign behind a letter stands alone
                signed.append(w)
                if w[:-1] not in known:
                    plain.add(w[:-1])
            else:
                plain.add(w)
        several = list(plain)
        for at in range(0, len(several), 10_000):
            self._learn_together(several[at : at + 10_000], blank, known)
        for w in signed:
            known[w] = known[w[:-1]] + self.signs[w[-1]]
        return passing

    def _learn_together(self, words: list[str], blank: str, known: dict[str, bytes | None]) -> None:
        """Encode words in one text and part its ids where words end, by the bytes that each id stands for."""
        between = blank or "\n"
        ids = np.array(self._ids(blank + between.join(words)), "<i4")
        reached = np.concatenate([[0], np.cumsum(self.n_bytes[ids])])
        ends = np.cumsum([len(w.encode()) + 1 for w in words])  # each with one blank or line break
        starts = ends - np.array([ends[0], *np.diff(ends)])
        if not blank:  # the line break comes behind
            ends = ends - 1
        first, last = np.searchsorted(reached, starts), np.searchsorted(reached, ends)
        assert (reached[first] == starts).all() and (reached[last] == ends).all()
        data = ids.tobytes()
        known.update(zip(words, [data[a:b] for a, b in zip((4 * first).tolist(), (4 * last).tolist())]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts."""
        out: list[bytes] = []
        for at in range(0, len(texts), TOGETHER):
            some = texts[at : at + TOGETHER]
            lines = [[line.split(" ") for line in t.split("\n")] if t and self.special not in t else [[""]] for t in some]
            long_firsts = self.learn({words[0] for text in lines for words in text}, "", self.first)
            long_spaced = self.learn(set().union(*(words[1:] for text in lines for words in text)), " ", self.spaced)
            first = self.first if not long_firsts else self.first | long_firsts
            spaced = self.spaced if not long_spaced else self.spaced | long_spaced
            get, line = spaced.__getitem__, self.line
            for t, text in zip(some, lines):
                try:
                    out.append(line.join([b"".join([first[words[0]], *map(get, words[1:])]) for words in text]))
                except TypeError:  # a word that does not stand alone
                    out.append(self._bytes(self._ids(t)))
        return out


@lru_cache(maxsize=2)
def byte_words(model: str = BYTE_MODEL) -> ByteWords:
    return ByteWords(model)


def encode_pieces(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", model: str = BYTE_MODEL, with_ids: bool = False) -> DataFrame:
    """PIECE_SCHEMA (and ids) of every row of `docs`, written once: its text's ids and an end id, in pieces of `size`.

    Only documents of more than `size` ids are cut; their first piece takes what whole pieces leave. A null text is
    empty, and so a piece of the end id alone. Repeated rows are all encoded; `row` tells pieces apart. Other columns are
    not read.
    """
    schema = PIECE_SCHEMA.removeprefix("row long, ") + (", ids array<int>" if with_ids else "")

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_cache("packing", byte_words.cache_clear)
        words, end = byte_words(model), ByteWords._bytes([END_ID])
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                encoded = [b + end for b in words.encode([t or "" for t in part.column(1).to_pylist()])]
                lengths = np.array([len(b) // 4 for b in encoded])
                counts = -(-lengths // size)
                doc = np.repeat(np.arange(len(lengths)), counts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
                head = (lengths - (counts - 1) * size)[doc]
                start = np.where(piece == 0, 0, head + (piece - 1) * size)
                length = np.where(piece == 0, head, size)
                views = [memoryview(b) for b in encoded]
                sums = [zlib.crc32(views[d][4 * a : 4 * b]) for d, a, b in zip(doc.tolist(), start.tolist(), (start + length).tolist())]
                columns = [part.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    ends = pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(encoded), "<i4"))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    made = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(pieces, schema)
    return stash(made.select(F.monotonically_increasing_id().alias("row"), "*"), "packing-pieces")


def best_fit(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each length's sequence and offset, and the room left in each sequence, by best fit, longest first.

    Equal lengths are placed together: a sequence takes as many as its room holds before the next one is looked at.
    """
    order = np.argsort(-lengths, kind="stable")
    where, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    left = np.zeros(len(lengths), np.int64)
    rooms: dict[int, list[np.ndarray]] = {}
    keys: list[int] = []
    opened = at = 0

    def put(bins: np.ndarray, room: int, each: int, length: int) -> None:
        nonlocal at
        items = order[at : at + each * len(bins)]
        where[items] = np.repeat(bins, each)
        offsets[items] = np.tile(size - room + length * np.arange(each), len(bins))
        at += len(items)
        room -= each * length
        left[bins] = room
        if room:
            if room not in rooms:
                rooms[room] = []
                bisect.insort(keys, room)
            rooms[room].append(bins)

    values, counts = np.unique(lengths, return_counts=True)
    for length, count in zip(values[::-1].tolist(), counts[::-1].tolist()):
        while count:
            i = bisect.bisect_left(keys, length)
            room = keys[i] if i < len(keys) else size
            each = room // length
            want = max(1, count // each)
            if i < len(keys):
                bins = rooms[room].pop()
                if len(bins) > want:
                    rooms[room].append(bins[want:])
                    bins = bins[:want]
                if not rooms[room]:
                    del rooms[room], keys[i]
            else:
                bins = np.arange(opened, opened + want)
                opened += want
            each = min(each, count)
            put(bins, room, each, length)
            count -= each * len(bins)
    return where, offsets, left[:opened]


def least_sequences(counts: np.ndarray, size: int = SIZE) -> int:
    """A lower bound of the sequences for counts[x] pieces of each length x from 0 to `size`, by dual feasible functions."""
    x = np.arange(size + 1)
    total = x * counts
    number, length = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(total)])
    least = np.arange(0, size // 2 + 1)  # lengths below count as none, above size - least as whole
    most = size - least
    bound = -(-int(((number[-1] - number[most + 1]) * size + length[most + 1] - length[least]).max()) // size)
    for k in range(1, ROUNDINGS + 1):
        rounded = np.where((k + 1) * x % size == 0, x * k, (k + 1) * x // size * size)
        bound = max(bound, -(-int((rounded * counts).sum()) // (k * size)))
    return bound


def _pack_part(rows: pa.Table, size: int, round_no: int, part: int) -> pa.Table:
    lengths = rows["length"].to_numpy()
    where, offsets, left = best_fit(lengths, size)
    bound = least_sequences(np.bincount(lengths, minlength=size + 1), size)
    ids = (round_no << ROUND_BITS) + (part << PART_BITS) + where
    if round_no:
        old, before = np.unique(rows["sequence_id"].to_numpy(), return_inverse=True)
        if len(old) <= len(left):  # no sequence was saved
            where, offsets, ids = before, rows["offset"].to_numpy(), rows["sequence_id"].to_numpy()
            left = size - np.bincount(before, lengths).astype(np.int64)
    gap = len(left) - bound
    emptiest = np.argsort(-left, kind="stable")[: OPENED * (1 + gap)]
    open_ = np.zeros(len(left), bool)
    open_[emptiest] = left[emptiest] > 0
    put = {"sequence_id": pa.array(ids), "offset": pa.array(offsets), "certified": pa.array(np.full(len(ids), gap == 0)), "_part": pa.array(np.full(len(ids), part)), "_open": pa.array(open_[where])}
    for name, column in put.items():
        at = rows.schema.get_field_index(name)
        rows = rows.set_column(at, name, column) if at >= 0 else rows.append_column(name, column)
    return rows


def pack(pieces: DataFrame, size: int = SIZE, parts: int | None = None) -> DataFrame:
    """Rows of `pieces` (each with a `length` from 1 to `size`) with sequence_id, offset, and certified.

    A sequence's pieces lie one behind another from offset 0. `certified` tells that the partition which packed the
    piece opened no more sequences than its bound. Other columns are carried, those with these names replaced; keep them
    narrow, since a partition's rows are in memory together (at most PART_ROWS on average). Empty tables stay empty.
    """
    extra = [("sequence_id", LongType()), ("offset", LongType()), ("certified", BooleanType()), ("_part", IntegerType()), ("_open", BooleanType())]
    pieces = pieces.drop(*(n for n, _ in extra))
    schema = StructType(list(pieces.schema.fields))
    for name, kind in extra:
        schema = schema.add(name, kind)
    histogram = np.zeros(size + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most `size` rows
        histogram[length] = n
    bound, rows = least_sequences(histogram, size), int(histogram.sum())
    if parts is None:
        parts = max(1, -(-rows // PART_ROWS), min(input_partitions(pieces.sparkSession), rows // LEAST_ROWS))

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from _cast(_pack_part(pa.Table.from_batches(held), size, 0, TaskContext.get().partitionId()), schema)

    def exchange(round_no: int):
        def groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.Table] = []
            for batch in batches:
                group, at = batch.column("_part").to_numpy(), 0
                for cut in [*(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]:
                    if held and cut > at and held[-1]["_part"][0].as_py() != group[at]:
                        yield from _cast(_pack_part(pa.concat_tables(held), size, round_no, held[0]["_part"][0].as_py()), schema)
                        held = []
                    if cut > at:
                        held.append(pa.Table.from_batches([batch.slice(at, cut - at)]))
                    at = cut
            if held:
                yield from _cast(_pack_part(pa.concat_tables(held), size, round_no, held[0]["_part"][0].as_py()), schema)

        return groups

    now, done, round_no = stash(pieces.repartition(parts).mapInArrow(deal, schema), "packing-round"), [], 0
    while parts > 1 and (round_no == 0 or parts > GROUP):
        used = sum(d.where("offset = 0").count() for d in [*done, now])
        if used == bound:
            break
        round_no, parts = round_no + 1, -(-parts // GROUP)
        done.append(now.where("not _open"))
        moved = now.where("_open").withColumn("_part", (F.col("_part") / GROUP).cast("int"))
        now = stash(moved.repartition("_part").sortWithinPartitions("_part").mapInArrow(exchange(round_no), schema), "packing-round")
    for d in done:
        now = now.unionByName(d)
    return now.drop("_part", "_open")


def _cast(rows: pa.Table, schema: StructType) -> list[pa.RecordBatch]:
    return rows.select(schema.names).set_column(schema.names.index("_part"), "_part", rows["_part"].cast(pa.int32())).to_batches()


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed token ids, of pieces made with_ids and where `pack` placed them."""
    held = placed.select("row", "sequence_id", "offset").join(pieces.select("row", "ids"), "row")
    in_order = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return held.groupBy("sequence_id").agg(F.flatten(F.transform(in_order, lambda p: p["ids"])).alias("ids"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = pack(encode_pieces(table(spark, sf_dir, "documents")).drop("row"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")
