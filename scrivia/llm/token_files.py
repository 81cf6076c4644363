"""Token ids in ORC files.

Documents are dealt by ranges of their ids, encoded, and written in ascending order. ORC keeps the ids as integer
run-length streams in stripes, with row indexes and a Bloom filter on doc_id: readers take stripes in parallel, and
a filter on doc_id skips stripes and row groups by their metadata.
"""

from __future__ import annotations

import itertools
import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivia.llm.common import hold_cache, stash, stash_path, table
from scrivia.llm.pretokens import WORD_MODEL

END_ID = 1
#: A special token of the tokenizer.
PART = "<|startoftext|>"
#: Words that a worker keeps; longer ones are not kept.
CACHED = 800_000
LONGEST_KEPT = 64
#: Files whose sums are broadcast (16 MB).
MAX_BROADCAST_FILES = 1_000_000
#: Texts whose new words are encoded together.
TOGETHER = 256
ORC_OPTIONS = {
    "compression": "snappy",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
FILE_SCHEMA = "doc_id long, position long, n_tokens int, ids array<int>"
#: `position` holds the file's number above these bits and the row's number below.
POSITION_BITS = 33


def words_of(text: str) -> list[str]:
    """Pieces that the tokenizer treats one by one: it drops white space and never looks across it.

    It lower-cases as well, so for Latin-1 texts without its special strings that is done here already, which leaves
    fewer different words.
    """
    if "<|" not in text:
        try:
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
    return text.replace("\n", " ").split(" ")


class WordIds(dict):
    """Word -> its ids as the bytes of little-endian int32."""

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.model = Tokenizer.from_file(model)
        self.model.no_truncation()
        self.model.no_padding()
        self.part = self.model.token_to_id(PART)
        self._assert_words_stand_alone()

    def _assert_words_stand_alone(self) -> None:
        """`words_of` and `learn` hold for a tokenizer that drops blanks, lower-cases, and parts a letter from a sign."""
        of = lambda text: self.model.encode(text, add_special_tokens=False).ids
        assert self.part is not None and of(PART.join(["ab", "cd"])) == of("ab") + [self.part] + of("cd")
        for text in ("The Cat sat. On it!", "Ünder  the\nÉlm, no: yes? a;", "x1. 2y, z"):
            assert of(text) == of(text.lower()) == [i for w in text.replace("\n", " ").split(" ") for i in of(w)]
        for letter in ("a", "Z", "é", "\xff"):
            assert all(of(letter + sign) == of(letter) + of(sign) for sign in ".,;:!?")

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Encode new words; those that are too long to keep are returned."""
        if len(self) > CACHED:  # the first ones seen are the frequent ones
            for key in list(itertools.islice(reversed(self), CACHED // 2)):
                if key not in words:
                    del self[key]
        new = [w for w in words if w not in self]
        # the tokenizer parts a letter from the sign behind it (beyond Latin-1 its normal form may end in a mark)
        signed = [w for w in new if w[-1] in ".,;:!?" and w[-2:-1].isalpha() and w[-2] < "\u0100"]
        plain = {w for w in itertools.chain(set(new).difference(signed), (w[:-1] for w in signed), ".,;:!?") if w not in self}
        found = self.encoded(list(plain))
        of = lambda w: found[w] if w in found else self[w]
        found.update({w: of(w[:-1]) + of(w[-1]) for w in signed})
        self.update((w, b) for w, b in found.items() if len(w) <= LONGEST_KEPT)
        return {w: b for w, b in found.items() if len(w) > LONGEST_KEPT}

    def encoded(self, words: list[str]) -> dict[str, bytes]:
        """Many words in one call, parted by a special token, which the tokenizer finds before anything else."""
        out: dict[str, bytes] = {}
        apart = [w for w in words if "<|" in w or len(w) > LONGEST_KEPT]
        if apart:
            out.update((w, np.array(e.ids, "<i4").tobytes()) for w, e in zip(apart, self.model.encode_batch_fast(apart, add_special_tokens=False)))
            words = [w for w in words if w not in out]
        for at in range(0, len(words), 1000):
            some = words[at : at + 1000]
            ids = np.array(self.model.encode_batch_fast([PART.join(some)], add_special_tokens=False)[0].ids, "<i4")
            cuts = np.flatnonzero(ids == self.part)
            data, starts, ends = ids.tobytes(), (4 * cuts + 4).tolist(), (4 * cuts).tolist()
            out.update(zip(some, [data[a:b] for a, b in zip([0, *starts], [*ends, len(data)])]))
        return out

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Ids of whole texts as list<int32>, the end id last; a null text is empty."""
        end, known, parts = np.array([END_ID], "<i4").tobytes(), self.__getitem__, []
        for at in range(0, len(texts), TOGETHER):
            some = [words_of(t or "") for t in texts.slice(at, TOGETHER).to_pylist()]
            passing = self.learn(set().union(*some))
            if passing:
                known_or_passing = lambda w: passing[w] if w in passing else known(w)
                out = [b"".join(map(known_or_passing, words)) + end for words in some]
            else:
                out = [b"".join(map(known, words)) + end for words in some]
            offsets = np.concatenate([[0], np.cumsum([len(b) // 4 for b in out])]).astype(np.int32)
            parts.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(out), "<i4"))))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))


@lru_cache(maxsize=2)
def word_ids(model: str = WORD_MODEL) -> WordIds:
    return WordIds(model)


def write_token_files(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", model: str = WORD_MODEL
) -> None:
    """Write FILE_SCHEMA in ascending order of the ids, nulls first, and of a checksum of the text among rows of one id.

    A null or empty text has the end id alone; repeated rows are all written; an empty table gives files without
    rows; other columns are not read. An id that holds many rows is dealt over several files.
    """

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        hold_cache("token_files", word_ids.cache_clear)
        return word_ids(model).encode(texts)

    dealt = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text")).withColumn(
        "_tie", F.xxhash64("_text")
    )
    ordered = dealt.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    rows = ordered.select("doc_id", F.monotonically_increasing_id().alias("position"), encode("_text").alias("ids"))
    rows.select("doc_id", "position", F.size("ids").alias("n_tokens"), "ids").write.format("orc").options(**ORC_OPTIONS).save(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The rows of `write_token_files`; filters on doc_id reach the files' indexes and Bloom filters."""
    return spark.read.schema(FILE_SCHEMA).orc(path)


def token_starts(files: DataFrame) -> DataFrame:
    """The rows of `files` (position, n_tokens and any others) with start: the tokens of all rows before each one.

    Running sums stay within a file, whose size is bounded. The sums of files, one row a file (16 bytes), are broadcast
    up to MAX_BROADCAST_FILES and joined by a shuffle beyond.
    """
    numbered = files.withColumn("_file", F.shiftrightunsigned("position", POSITION_BITS))
    per_file = numbered.groupBy("_file").agg(F.sum("n_tokens").alias("_tokens"))
    ahead = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    bases = stash(per_file.select("_file", F.coalesce(F.sum("_tokens").over(ahead), F.lit(0)).alias("_base")), "token-bases")
    if bases.count() <= MAX_BROADCAST_FILES:
        bases = F.broadcast(bases)
    within = Window.partitionBy("_file").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    placed = numbered.withColumn("_before", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(bases, "_file")
    return placed.withColumn("start", F.col("_base") + F.col("_before")).drop("_file", "_base", "_before")


def checksums(ids: pa.Array) -> pa.Array:
    """CRC-32 of each list of ids as little-endian unsigned 32-bit integers."""
    offsets = ids.offsets.to_pylist()
    data = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
    return pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:])], pa.int64())


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stash_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    files = read_token_files(spark, path)
    ids_checksum = F.arrow_udf(checksums, "long")
    sums = files.select("doc_id", "position", F.col("n_tokens").cast("long"), ids_checksum("ids").alias("ids_crc32"))
    return token_starts(sums).select("doc_id", "start", "n_tokens", "ids_crc32")
