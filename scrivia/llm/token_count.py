"""Token counts by a map-side two-tier lookup.

Tier one is a compact table of frequent pre-tokens and their lengths, made from a bounded sample and broadcast.
Tier two is each Python worker's own cache: a pre-token missing from both is encoded once and kept until the cache
is full. Texts never leave their task and no pre-token is shuffled; the table changes speed, never a count.
"""

from __future__ import annotations

import itertools
from collections import Counter

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivia.llm.common import hold_cache, table
from scrivia.llm.pretokens import PIECE_MODEL, piece_segments, splits_at_spaces

#: Documents that the frequent table is made from, their characters at most, and the table's entries.
SAMPLE_DOCUMENTS, SAMPLE_CHARACTERS = 1000, 20_000
FREQUENT = 50_000
#: Pre-tokens that a worker keeps besides; a longer one is not kept.
CACHED = 300_000
LONGEST_KEPT = 64
TOKEN_LIMIT = 4096

_workers: dict[tuple, "Lengths"] = {}


class Lengths(dict):
    """Pre-token -> number of tokens; encodes what it does not know."""

    def __init__(self, model: str, frequent: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        assert splits_at_spaces([self.model.id_to_piece(i) for i in range(self.model.get_piece_size())])
        words, lengths = unpack(frequent)
        super().__init__(zip(words, lengths))
        self.least = len(self)

    def __missing__(self, segment: str) -> int:
        # the model puts a space in front; a segment without one is encoded behind a line break, which is
        # two tokens, the space and the break's byte
        if segment == " " or segment == "\n":
            n = 1
        elif segment[0] == " ":
            n = len(self.model.encode(segment[1:]))
        else:
            n = len(self.model.encode("\n" + segment)) - 2
        if len(segment) <= LONGEST_KEPT:
            if len(self) - self.least >= CACHED:
                for key in list(itertools.islice(reversed(self), CACHED // 2)):
                    del self[key]
            self[segment] = n
        return n


def pack(words: list[str], lengths: list[int]) -> bytes:
    """One length byte for each word, a zero, and the words, each behind a NUL."""
    return bytes(lengths) + b"\0" + "\0".join(words).encode()


def unpack(table: bytes) -> tuple[list[str], bytes]:
    lengths, _, words = table.partition(b"\0")
    return (words.decode().split("\0") if lengths else []), lengths


def frequent_table(docs: DataFrame, text_col: str, model: str = PIECE_MODEL) -> bytes:
    """The packed lengths of at most FREQUENT pre-tokens that are frequent in SAMPLE_DOCUMENTS documents.

    The sample is bounded in rows and characters and taken from the first partitions that hold enough of it.
    """
    sample = docs.where(F.length(text_col) <= SAMPLE_CHARACTERS).select(text_col).limit(SAMPLE_DOCUMENTS).collect()
    seen = Counter(s for row in sample for s in piece_segments(row[0]))
    lengths = Lengths(model, b"\0")
    words = [w for w, n in seen.most_common(FREQUENT) if n > 1 and len(w) <= LONGEST_KEPT and "\0" not in w]
    pairs = [(w, n) for w in words if 0 < (n := lengths[w]) < 256]
    return pack([w for w, _ in pairs], [n for _, n in pairs])


def count_tokens(docs: DataFrame, text_col: str = "text", model: str = PIECE_MODEL, frequent: bytes | None = None) -> DataFrame:
    """Add n_bytes and n_tokens (long) to every row of `docs`, by the SentencePiece model, without special tokens.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted each; an empty table stays empty.
    Existing columns n_bytes and n_tokens are replaced, all others are carried. Texts of any length are counted
    whole; memory is bounded by one Arrow batch and the cache.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent_table(docs, text_col, model) if frequent is None else frequent)

    @F.arrow_udf("long")
    def n_tokens(texts: pa.Array) -> pa.Array:
        hold_cache("token_count", _workers.clear)
        key = (model, len(shared.value), hash(shared.value))
        if key not in _workers:
            _workers.clear()
            _workers[key] = Lengths(model, shared.value)
        lengths = _workers[key].__getitem__
        return pa.array([sum(map(lengths, piece_segments(t.as_py() or ""))) for t in texts], pa.int64())

    return docs.withColumns(
        {"n_bytes": F.coalesce(F.octet_length(text_col).cast("long"), F.lit(0).cast("long")), "n_tokens": n_tokens(F.col(text_col))}
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))
