"""Language identification by mixture inference.

A document is a mixture of languages: each of its words comes from one of them, by that language's character
n-grams. Expectation-maximisation estimates the proportions; the set of languages is the one with the largest
likelihood less a penalty for each language beyond the first; the language named is the set's largest.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivia.llm.common import held_out, hold_cache, stash, table

#: Labelled documents of a language that the model is fitted on, about: a sample by the checksum of the id.
TRAIN_PER_LANGUAGE = 4000
TRAIN_PARTITIONS = 12
#: Values of lang that a model is learned for; more are refused, as they are no languages (256 KB of counts each).
MAX_LANGUAGES = 512
BUCKETS = 2**15
SMOOTHING = 0.05
MAX_ROUNDS = 25
#: Penalty of a further language, in units of log(words).
PENALTY = 3.0
CACHED = 300_000
LONGEST_KEPT = 48
UNDETERMINED = "und"
OUT = ["lang_pred", "score", "langs", "shares"]

_WORD = re.compile(r"[^\W\d_]+")
_workers: dict[int, "Mixture"] = {}


def ngram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character bigrams and trigrams of each word, its edges included, and each word's number of them."""
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    codes = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum(lengths)
    at = np.arange(len(codes), dtype=np.int64)
    word = np.repeat(np.arange(len(words)), lengths)
    left = ends[word] - at  # characters of the word from here on
    two, three = at[left >= 2], at[left >= 3]
    pair = codes[two] * np.uint64(0x9E3779B97F4A7C15) + codes[two + 1] * np.uint64(0xC2B2AE3D27D4EB4F)
    triple = (codes[three] * np.uint64(0xD6E8FEB86659FD93) + codes[three + 1]) * np.uint64(0xFF51AFD7ED558CCD) + codes[three + 2] * np.uint64(0xC4CEB9FE1A85EC53)
    mix = lambda h: ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - 15)).astype(np.int64)
    owner = np.concatenate([word[two], word[three]])
    order = np.argsort(owner, kind="stable")
    return np.concatenate([mix(pair), mix(triple)])[order], np.bincount(owner, minlength=len(words))


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-gram counts by language of one partition of the sample."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = _WORD.findall(text.lower())
            if words:
                own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                own += np.bincount(ngram_buckets(words)[0], minlength=BUCKETS)
    langs = sorted(counts)
    yield pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "counts": pa.array([counts[x].tobytes() for x in langs], pa.binary())})


def train(docs: DataFrame) -> tuple[list[str], bytes]:
    """Languages and their n-gram log-likelihoods (float32, one row of BUCKETS each).

    Learns from rows with a text and a lang whose id is not held out; of each language a sample of about
    TRAIN_PER_LANGUAGE documents. Counts of tasks are added up on executors. The result has 128 KB a language; more than
    MAX_LANGUAGES languages raise a ValueError.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counted = stash(usable.groupBy("lang").count(), "language-sizes")
    if counted.count() > MAX_LANGUAGES:
        raise ValueError(f"lang has more than {MAX_LANGUAGES} values")
    share = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1_000_003)) / 1_000_003
    sample = usable.join(F.broadcast(counted), "lang").where(share * F.col("count") < TRAIN_PER_LANGUAGE)  # MAX_LANGUAGES rows
    gathered = sample.select("lang", "text").repartition(TRAIN_PARTITIONS).mapInArrow(_gather, "lang string, counts binary")

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(c, np.int64) for c in rows["counts"]], axis=0)
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "counts": [total.astype(np.int64).tobytes()]})

    summed = gathered.groupBy("lang").applyInPandas(added, "lang string, counts binary").collect()  # one row a language
    total = {row.lang: np.frombuffer(row.counts, np.int64) for row in summed}
    langs = sorted(total)
    logs = [np.log((total[x] + SMOOTHING) / (total[x].sum() + SMOOTHING * BUCKETS)) for x in langs]
    return langs, np.array(logs, np.float32).tobytes()


class Found(NamedTuple):
    """The language named, its proportion, and the chosen set of languages with their proportions, largest first."""

    lang: str
    score: float
    langs: list[str]
    shares: list[float]


NOTHING = Found(UNDETERMINED, 0.0, [], [])


class Mixture:
    """A worker's model, with the likelihoods of the words it has met."""

    def __init__(self, langs: list[str], logs: bytes):
        self.langs = langs
        self.logs = np.ascontiguousarray(np.frombuffer(logs, np.float32).reshape(len(langs), BUCKETS).T)
        self.rows: dict[str, int] = {}
        self.likelihood = np.zeros((0, len(langs)))

    def score_words(self, words: list[str]) -> np.ndarray:
        buckets, counts = ngram_buckets(words)
        return np.add.reduceat(self.logs[buckets].astype(np.float64), np.cumsum(counts) - counts, axis=0)

    def documents(self, texts: list[str | None]) -> list[Found]:
        found = [_WORD.findall(t.lower()) if t else [] for t in texts]
        words = set().union(*found)
        new = [w for w in words if w not in self.rows]
        if len(self.rows) + len(new) > CACHED:
            self.rows, self.likelihood = {}, self.likelihood[:0]
            new = list(words)
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            self.rows.update(zip(some, range(len(self.rows), len(self.rows) + len(some))))
            self.likelihood = np.concatenate([self.likelihood, self.score_words(some)])
        out = [self.document(t, words) for t, words in zip(texts, found)]
        for word in [w for w in new if len(w) > LONGEST_KEPT]:
            del self.rows[word]
        return out

    def document(self, text: str | None, words: list[str]) -> Found:
        # the pattern takes some numerals for letters
        if not words or not self.langs or not any(map(str.isalpha, itertools.chain.from_iterable(words))):
            return NOTHING
        at, times = np.unique(np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words)), return_counts=True)
        return self.infer(self.likelihood[at], times.astype(np.float64))

    def infer(self, logs: np.ndarray, times: np.ndarray) -> Found:
        """The set of languages with the largest penalised likelihood, from the words' log-likelihoods and counts."""
        total, top = times.sum(), logs.max(axis=1)
        likelihood = np.exp(logs - top[:, None])
        share, _ = mixture(likelihood, times, np.full(len(self.langs), 1 / len(self.langs)))
        order = np.argsort(-share, kind="stable")
        single = times @ (logs - top[:, None])
        best_one = int(np.argmax(single))
        chosen, chosen_share, best = [best_one], np.ones(1), single[best_one]
        # no set can gain more than the words' best likelihoods, which are zero here
        for size in range(2, len(order) + 1):
            price = PENALTY * math.log(total + 1) * (size - 1)
            if -price <= best:
                break
            members = order[:size]
            own_share, value = mixture(likelihood[:, members], times, share[members] / max(share[members].sum(), 1e-300))
            if value - price > best:
                chosen, chosen_share, best = list(members), own_share, value - price
        largest = np.argsort(-np.asarray(chosen_share), kind="stable").tolist()
        shares = [float(min(1.0, max(0.0, chosen_share[i]))) for i in largest]
        langs = [self.langs[chosen[i]] for i in largest]
        return Found(langs[0], shares[0], langs, shares)


def mixture(likelihood: np.ndarray, times: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions by expectation-maximisation, and the log-likelihood."""
    total = times.sum()
    for _ in range(MAX_ROUNDS):
        per_word = np.maximum(likelihood @ share, 1e-300)
        new = share * ((times / per_word) @ likelihood) / total
        done = np.abs(new - share).max() < 1e-3
        share = new
        if done:
            break
    return share, float(times @ np.log(np.maximum(likelihood @ share, 1e-300)))


def identify(docs: DataFrame, model: tuple[list[str], bytes], text_col: str = "text") -> DataFrame:
    """Add lang_pred, score (that language's proportion in the chosen set, 0 to 1), langs and shares (the set and its
    proportions, largest first) to every row; columns of these names are replaced.

    A null text, or one without a letter, is `und` with score 0 and no languages; so is every text if nothing could be
    learned. Texts are read whole; repeated rows are judged each; an empty table stays empty; other columns are carried.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double, langs: array<string>, shares: array<double>>")
    def predict(texts: pa.Array) -> pa.Array:
        hold_cache("langid", _workers.clear)
        key = hash((tuple(shared.value[0]), shared.value[1]))
        if key not in _workers:
            _workers.clear()
            _workers[key] = Mixture(*shared.value)
        out: list[Found] = []
        for at in range(0, len(texts), 256):
            out += _workers[key].documents(texts.slice(at, 256).to_pylist())
        types = [pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64())]
        columns = zip(*out) if out else [[]] * len(OUT)
        return pa.StructArray.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], OUT)

    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in OUT])
    return docs.select(own.alias("_own"), predict(F.col(text_col)).alias("_judged")).select("_own.*", "_judged.*")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *OUT)
