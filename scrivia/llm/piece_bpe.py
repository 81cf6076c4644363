"""SentencePiece BPE in vectorised merge rounds.

Words (pre-tokens) become one flat numpy array of symbols. A round finds the lowest pair rank of every word by a
segmented minimum, merges all its leftmost non-overlapping pairs of that rank at once, and compacts the array;
words without a pair left are taken out. Rounds go on until no word is left.

Merging all pairs of a rank at once equals one merge at a time unless a merge makes a pair of no higher rank; words
where that happens merge only their leftmost pair in that round.
"""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from scrivia.llm.common import SLICE, hold_cache, in_slices, table
from scrivia.llm.pretokens import PIECE_MODEL, SPACE, piece_segments, splits_at_spaces

#: Pre-tokens that a worker keeps; longer ones are not kept.
CACHED = 100_000
LONGEST_KEPT = 64
#: Symbols that meet in one run of rounds, and ids and bytes decoded in one step, about: this bounds memory.
SYMBOLS = 500_000
DECODED_IDS = 300_000
DECODED_BYTES = 1_000_000
#: Piece types of the model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
#: Texts whose new pre-tokens are encoded together.
TOGETHER = SLICE
NO_PAIR = np.iinfo(np.int32).max


class PieceBpe:
    """One model's pair ranks and piece bytes; encodes pre-tokens and decodes ids."""

    def __init__(self, model: str = PIECE_MODEL):
        proto = sentencepiece_model_pb2.ModelProto()
        with open(model, "rb") as f:
            proto.ParseFromString(f.read())
        pieces = proto.pieces
        assert proto.normalizer_spec.name == "identity" and not any(p.type == USER_DEFINED for p in pieces)
        assert splits_at_spaces([p.piece for p in pieces if p.type == NORMAL])
        self.n = len(pieces)
        self.end_id = proto.trainer_spec.eos_id
        symbols = {p.piece: i for i, p in enumerate(pieces) if p.type == NORMAL}
        for char in sorted({c for p in symbols for c in p} - symbols.keys()):
            symbols[char] = len(pieces) + len(symbols)  # only ever seen inside pieces
        self.width = max(symbols.values()) + 1
        rank_of = {s: r for r, s in enumerate(sorted({p.score for p in pieces if p.type == NORMAL}, reverse=True))}
        keys, merged, ranks = [], [], []
        for piece, at in symbols.items():
            for cut in range(1, len(piece)):
                left, right = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.width + right)
                    merged.append(at)
                    ranks.append(rank_of[pieces[at].score])
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.array(keys, np.int64)[order]
        self.merged = np.array(merged, np.int32)[order]
        self.ranks = np.array(ranks, np.int32)[order]
        # a character is its piece, or minus one minus its code point
        self.of_char = -1 - np.arange(0x110000, dtype=np.int32)
        for piece, at in symbols.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = at
        self.byte_ids = np.zeros(256, np.int32)
        surface = []
        for i, p in enumerate(pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
                surface.append(bytes([int(p.piece[1:-1], 16)]))
            elif p.type == CONTROL:
                surface.append(b"")
            elif p.type == UNKNOWN:
                surface.append(proto.trainer_spec.unk_surface.encode())
            else:
                surface.append(p.piece.replace(SPACE, " ").encode())
        self.is_byte = np.array([p.type == BYTE for p in pieces])
        self.starts_with_space = np.array([p.type == NORMAL and p.piece.startswith(SPACE) for p in pieces])
        self.sizes = np.array([len(s) for s in surface], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.cache: dict[str, bytes] = {"\n": self.byte_ids[10:11].tobytes()}

    # -- encoding

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; NO_PAIR where the vocabulary has none."""
        key = np.where((left < 0) | (right < 0), -1, left.astype(np.int64) * self.width + right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = self.keys[at] == key
        return np.where(known, self.ranks[at], NO_PAIR), np.where(known, self.merged[at], -1)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each pre-token (spaces written as spaces), as the bytes of int32."""
        lengths = np.array([len(w) for w in words], np.int64)
        text = "".join(words).replace(" ", SPACE)
        symbol = self.of_char[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, into = self._all_pairs(symbol, word)
        while len(symbol):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(word)))
            least_here = np.repeat(least, size)
            if (over := least_here == NO_PAIR).any():
                done.append((word[over], symbol[over]))
                symbol, word, rank, into, least_here = (x[~over] for x in (symbol, word, rank, into, least_here))
                if not len(symbol):
                    break
            hits = np.flatnonzero(rank == least_here)
            run = np.maximum.accumulate(np.where(np.diff(hits, prepend=-2) != 1, np.arange(len(hits)), 0))
            chosen = hits[(np.arange(len(hits)) - run) % 2 == 0]
            state = self._merge(symbol, word, rank, into, chosen)
            # words with several merges at once, one of which made a pair that would have come before the others
            owner = word[chosen]
            again = np.concatenate([[False], owner[1:] == owner[:-1]])
            if again.any():
                several = again | np.append(again[1:], False)
                newest = self._new_ranks(symbol, word, into, chosen, state)
                early = np.unique(owner[several & (newest <= least_here[chosen])])
                if len(early):
                    state = self._merge(symbol, word, rank, into, chosen[~again | ~np.isin(owner, early)])
            symbol, word, rank, into = state
        if not done:
            return [b""] * len(words)
        word = np.concatenate([w for w, _ in done])
        symbol = np.concatenate([s for _, s in done])
        order = np.argsort(word, kind="stable")
        word, symbol = word[order], symbol[order]
        word, symbol = self._with_bytes(word, symbol)
        ends = (4 * np.searchsorted(word, np.arange(len(words)), side="right")).tolist()
        data = symbol.astype(np.int32).tobytes()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def _all_pairs(self, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, into = np.full(len(symbol), NO_PAIR, np.int32), np.full(len(symbol), -1, np.int32)
        if len(symbol) > 1:
            rank[:-1], into[:-1] = self._pairs(symbol[:-1], symbol[1:])
            rank[:-1][word[1:] != word[:-1]] = NO_PAIR
        return rank, into

    def _merge(self, symbol, word, rank, into, chosen):
        """Merge the pairs that start at `chosen`, drop their right symbols, and rank the pairs around them anew."""
        keep = np.ones(len(symbol), bool)
        keep[chosen + 1] = False
        symbol, rank, into = symbol.copy(), rank.copy(), into.copy()
        symbol[chosen] = into[chosen]
        symbol, word, rank, into = symbol[keep], word[keep], rank[keep], into[keep]
        at = chosen - np.arange(len(chosen))
        around = np.zeros(len(symbol), bool)
        around[at] = True
        around[np.maximum(at - 1, 0)] = True
        changed = np.flatnonzero(around)
        inner = changed[changed < len(symbol) - 1]
        rank[changed] = NO_PAIR
        same = word[inner] == word[inner + 1]
        inner = inner[same]
        rank[inner], into[inner] = self._pairs(symbol[inner], symbol[inner + 1])
        return symbol, word, rank, into

    def _new_ranks(self, symbol, word, into, chosen, state) -> np.ndarray:
        """The lowest rank of the pairs that each merge makes: with the merged symbol before it, with the merged one
        behind it, and with the one that stands behind it until that is merged itself."""
        at = chosen - np.arange(len(chosen))
        before = np.maximum(at - 1, 0)
        newest = np.minimum(state[2][at], np.where((at > 0) & (state[1][before] == state[1][at]), state[2][before], NO_PAIR))
        behind = np.minimum(chosen + 2, len(symbol) - 1)
        there = (chosen + 2 < len(symbol)) & (word[behind] == word[chosen])
        return np.minimum(newest, np.where(there, self._pairs(into[chosen], symbol[behind])[0], NO_PAIR))

    def _with_bytes(self, word: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become the pieces of their bytes."""
        foreign = np.flatnonzero((symbol < 0) | (symbol >= self.n))
        if not len(foreign):
            return word, symbol
        inner = {at: char for char, at in enumerate(self.of_char) if at >= self.n} if (symbol >= self.n).any() else {}
        as_bytes = [chr(-1 - s if s < 0 else inner[s]).encode() for s in symbol[foreign].tolist()]
        times = np.ones(len(symbol), np.int64)
        times[foreign] = [len(b) for b in as_bytes]
        starts = np.cumsum(times) - times
        word, out = np.repeat(word, times), np.repeat(symbol, times)
        for at, b in zip(starts[foreign].tolist(), as_bytes):
            out[at : at + len(b)] = self.byte_ids[list(b)]
        return word, out

    def _learn(self, segments: set[str]) -> dict[str, bytes]:
        """Encode new pre-tokens; those that are too long to keep are returned."""
        if len(self.cache) > CACHED:  # the first ones seen are the frequent ones
            for key in list(itertools.islice(reversed(self.cache), CACHED // 2)):
                if key not in segments:
                    del self.cache[key]
        passing: dict[str, bytes] = {}
        todo = [s for s in segments if s not in self.cache]
        while todo:
            total = itertools.accumulate(len(s) for s in todo)
            n = max(1, sum(1 for _ in itertools.takewhile(lambda t: t <= SYMBOLS, total)))
            some, todo = todo[:n], todo[n:]
            for segment, ids in zip(some, self.encode_words(some)):
                (self.cache if len(segment) <= LONGEST_KEPT else passing)[segment] = ids
        return passing

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Ids of whole texts as list<int32>, the end id last; a null text is empty."""
        end = np.array([self.end_id], np.int32).tobytes()
        known, parts = self.cache.__getitem__, []
        for at in range(0, len(texts), TOGETHER):
            some = [piece_segments(t or "") for t in texts.slice(at, TOGETHER).to_pylist()]
            passing = self._learn(set().union(*some))
            if passing:
                known_or_passing = lambda s: passing[s] if s in passing else known(s)
                out = [b"".join(map(known_or_passing, segments)) + end for segments in some]
            else:
                out = [b"".join(map(known, segments)) + end for segments in some]
            offsets = np.concatenate([[0], np.cumsum([len(b) // 4 for b in out])]).astype(np.int32)
            parts.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(out), np.int32))))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    # -- decoding

    def decode(self, ids: pa.ListArray) -> pa.StringArray:
        """Texts of lists of ids; null where the list is null."""
        ends, parts, at = ids.offsets.to_numpy()[1:], [], 0
        while at < len(ids):
            upto = (int(ends[at - 1]) if at else int(ids.offsets[0].as_py())) + DECODED_IDS
            to = max(at + 1, int(np.searchsorted(ends, upto, side="right")))
            parts.append(self._decode(pa.concat_arrays([ids.slice(at, to - at)])))
            at = to
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    def _decode(self, ids: pa.ListArray) -> pa.StringArray:
        offsets = ids.offsets.to_numpy().astype(np.int64)
        flat = ids.values.to_numpy(zero_copy_only=False)
        sizes = self.sizes[flat]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        # the space in front of the text goes
        skip = np.zeros(len(flat), np.int64)
        seen = np.flatnonzero(sizes)
        first = seen[np.minimum(np.searchsorted(seen, offsets[:-1]), max(len(seen) - 1, 0))] if len(seen) else np.zeros(0, np.int64)
        if len(seen):
            own = (first >= offsets[:-1]) & (first < offsets[1:])
            first = first[own]
            skip[first] = self.starts_with_space[flat[first]]
        parts: list[bytes] = []
        at = 0
        while at < len(flat):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + DECODED_BYTES, side="right")) - 1)
            n = sizes[at:to] - skip[at:to]
            begin = self.starts[flat[at:to]] + skip[at:to]
            shift = np.repeat(begin - (np.cumsum(n) - n), n)
            parts.append(self.surface[shift + np.arange(len(shift))].tobytes())
            at = to
        data = b"".join(parts)
        cut = np.concatenate([[0], np.cumsum(sizes - skip)])[offsets]
        base = int(cut[0]) if len(cut) else 0
        has_null = ids.null_count > 0
        try:
            data.decode("utf-8")
        except UnicodeDecodeError:
            return self._decode_slowly(ids)
        if has_null:
            texts = [data[a:b].decode() if ok else None for a, b, ok in zip(cut[:-1].tolist(), cut[1:].tolist(), ids.is_valid().to_pylist())]
            return pa.array(texts, pa.string())
        return pa.StringArray.from_buffers(
            len(ids), pa.py_buffer((cut - base).astype(np.int32).tobytes()), pa.py_buffer(data[base:] if base else data)
        )

    def _decode_slowly(self, ids: pa.ListArray) -> pa.StringArray:
        """For ids whose bytes are no UTF-8: every byte that fits nowhere becomes U+FFFD."""
        texts = []
        for one in ids.to_pylist():
            if one is None:
                texts.append(None)
                continue
            out, at_start = [], True
            for is_byte, group in itertools.groupby(one, key=lambda i: bool(self.is_byte[i])):
                if is_byte:
                    out.append(_utf8(b"".join(self.surface[self.starts[i] : self.starts[i] + 1].tobytes() for i in group)))
                    at_start = False
                    continue
                for i in group:
                    s = self.surface[self.starts[i] : self.starts[i] + self.sizes[i]].tobytes().decode()
                    if s and at_start:
                        s, at_start = (s[1:] if self.starts_with_space[i] else s), False
                    out.append(s)
            texts.append("".join(out))
        return pa.array(texts, pa.string())


def _utf8(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[at : at + n].decode("utf-8"))
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def piece_bpe(model: str = PIECE_MODEL) -> PieceBpe:
    return PieceBpe(model)


def encode_documents(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", model: str = PIECE_MODEL) -> DataFrame:
    """Add the ids (array<int>) of every row's whole text, the end id last.

    A null text counts as empty and gives the end id alone; repeated rows are encoded each; an empty table stays
    empty; a column already named `ids_col` is replaced and all others are carried. Texts of any length are
    encoded whole.
    """

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        hold_cache("piece_bpe", piece_bpe.cache_clear)
        return piece_bpe(model).encode(texts)

    return docs.withColumn(ids_col, encode(F.col(text_col)))


def decode_documents(docs: DataFrame, ids_col: str = "ids", text_col: str = "decoded", model: str = PIECE_MODEL) -> DataFrame:
    """Add the text of every row's ids; null ids give a null text, no ids an empty one. Control ids are silent and
    byte ids that form no character become U+FFFD, as in the library."""

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        return piece_bpe(model).decode(ids)

    return docs.withColumn(text_col, decode(F.col(ids_col)))


def code_documents(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded", model: str = PIECE_MODEL) -> DataFrame:
    """Both of the above for whole texts and their own ids, in one pass: a worker holds the results of few rows."""

    def code(texts: pa.Array) -> pa.Array:
        hold_cache("piece_bpe", piece_bpe.cache_clear)
        bpe = piece_bpe(model)
        ids = bpe.encode(texts)
        return pa.StructArray.from_arrays([ids, bpe.decode(ids)], ["ids", "decoded"])

    coded = F.arrow_udf(in_slices(code), "struct<ids: array<int>, decoded: string>")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in (ids_col, decoded_col)])
    both = docs.select(own.alias("_own"), coded(F.col(text_col)).alias("_coded"))
    return both.select("_own.*", F.col("_coded.ids").alias(ids_col), F.col("_coded.decoded").alias(decoded_col))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoded and decoded documents."""
    return docs.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(code_documents(docs))
