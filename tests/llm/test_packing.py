"""Packing: ids and pieces against the tokenizers library, places against the contract, bounds against exhaustive search."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scrivia.llm import packing

ODD = ["a  b", " a", "a ", "\n", "a\n\nb", "a \nb", "a\n b", "it's\tfine\r\n", "x y z", "a\x1cb c", "1 2  3", "<|endoftext|>", "a <|endoftext|> b", "é 日本 😀 <| x", "don't 've I'll", "▁   c", "word " * 3000, "y" * 20_000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(packing.BYTE_MODEL)


def check_pieces(rows, docs, library, size):
    """Rows (doc_id, piece, start, length, ids_crc32) of all docs, any number of rows an id."""
    want = []
    for doc_id, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        head = len(ids) % size or size
        starts = [0, *range(head, len(ids), size)]
        for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want.append((doc_id, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted(map(str, rows)) == sorted(map(str, want))


def check_places(rows, size):
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(held)


def test_whole_table(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.op13_best_fit_packing(spark, sf_dir).collect()
    check_pieces([r[:5] for r in rows], [tuple(r) for r in docs.select("doc_id", "text").collect()], library, 1024)
    lengths = np.array([r.length for r in rows])
    bound = packing.least_sequences(np.bincount(lengths, minlength=1025))
    assert bound <= check_places(rows, 1024) <= bound + 2


@pytest.mark.parametrize("parts", [1, 3, 20])
def test_odd_documents(spark, library, parts):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(None, "a b"), (None, None), (7, ""), (7, "same words"), (7, "same words")] * 3
    clashing = spark.createDataFrame(docs, "doc_id long, text string").withColumns({n: F.lit(1) for n in ("row", "piece", "length", "offset", "_part", "ids", "sequence_id")})
    pieces = packing.encode_pieces(clashing, size=64, with_ids=True)
    placed = packing.pack(pieces.drop("ids"), size=64, parts=parts)
    rows = placed.collect()
    check_pieces([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], docs, library, 64)
    packed = packing.sequences(pieces, placed).collect()
    assert check_places(rows, 64) == len(packed)
    ids = {r.sequence_id: r.ids for r in packed}
    assert all(zlib.crc32(np.array(ids[r.sequence_id][r.offset : r.offset + r.length], "<u4").tobytes()) == r.ids_crc32 for r in rows)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.encode_pieces(empty)).count() == 0


def fewest(lengths, size):
    """Sequences that lengths need, by trying every place."""
    best, lengths = len(lengths), sorted(lengths, reverse=True)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for room in sorted({r for r in rooms if r >= lengths[i]}):
            at = rooms.index(room)
            place(i + 1, [*rooms[:at], room - lengths[i], *rooms[at + 1 :]])
        place(i + 1, [*rooms, size - lengths[i]])

    place(0, [])
    return best


def test_bounds_hold_and_are_met():
    rnd, met = random.Random(5), 0
    for _ in range(150):
        size = rnd.choice([10, 24, 100])
        lengths = [rnd.randint(1, size) for _ in range(rnd.randint(1, 8))]
        exact = fewest(lengths, size)
        bound = packing.least_sequences(np.bincount(lengths, minlength=size + 1), size)
        _, _, left = packing.best_fit(np.array(lengths), size)
        assert bound <= exact <= len(left)
        met += bound == exact
    assert met > 130


def test_lengths_above_half_are_certified(spark):
    """Each needs a sequence of its own, which the sum of lengths does not tell."""
    rows = packing.pack(spark.range(3000).select((F.col("id") % 200 + 600).alias("length")), parts=4).collect()
    assert all(r.certified for r in rows) and check_places(rows, 1024) == 3000


def test_exchange_saves_sequences(spark):
    lengths = spark.range(6000).select((F.pmod(F.xxhash64("id"), F.lit(700)) + 1).alias("length"))
    rows = packing.pack(lengths, parts=40).collect()
    counts = np.bincount([r.length for r in rows], minlength=1025)
    alone = sum(len(packing.best_fit(np.array([r.length for r in rows[i::40]]))[2]) for i in range(40))
    used = check_places(rows, 1024)
    assert len(rows) == 6000 and packing.least_sequences(counts) <= used < alone - 10


def test_a_hot_length_and_one_document(spark, library):
    docs = spark.range(4000).select(F.lit(3).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    rows = packing.pack(packing.encode_pieces(docs), parts=6).collect()
    length = len(library.encode("the same text").ids) + 1
    assert check_places(rows, 1024) == -(-4000 // (1024 // length))
