"""Toxicity by a noisy channel and a learned lexicon.

Written characters may stand for others (1 for i or l, $ for s), letters may be spaced out or parted by signs, and
repeated. A unit of text whose characters allow more than one reading becomes a lattice; the Viterbi path under a
character trigram model, gathered from the whole corpus, restores it. Letters that are spaced out may be several words,
and a doubled letter may be one: the lattice chooses, and the lexicon may know the undoubled word as well. Restored words and their beginnings are the
features of a logistic regression that is learned from labels.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivia.llm.common import give_back, held_out, hold_cache, in_slices, stash, table

#: What a written sign can stand for, in the channel (fixed values).
READINGS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "µ": "u",
}
#: Signs that part letters.
SEPARATORS = "._-*~/\\'`^:,"
COST_READ, COST_SKIP, COST_REPEAT = 1.0, 0.5, 0.3
#: Spaced letters are not parted where a gap is wider than others of their run.
COST_WIDE = 1.0
#: Doubled letters of a word that may each be one letter: of more, all or none.
MAX_DOUBLED = 4
#: Letters of a word of the lexicon that is looked for inside a run of spaced letters.
SPANS = (5, 16)

#: The trigram model's alphabet: 0 is an edge or sign, 1-26 a letter, 27 a letter beyond a-z.
LETTERS, OTHER = 28, 27
#: Labelled documents of each class that the lexicon is fitted on, about: a sample by the checksum of the id.
TRAIN_PER_CLASS = 10_000
TRAIN_PARTITIONS = 12
FEATURES = 2**20
#: Features of the regression at most, those with the strongest evidence in the sample: a bound of the classifier.
LEXICON = 4096
#: Characters whose trigrams are counted together.
CODES_TOGETHER = 1 << 20
#: A feature in the lexicon has at least these log-odds, less a standard error.
MIN_ODDS = 0.7
#: How a word may begin, in letters.
BEGINNINGS = (4, 5, 6, 7, 8)
RIDGE = 1.0
CACHED, LONGEST_KEPT = 400_000, 48

_LETTER_RUN = re.compile(r"[^\W\d_]+")
#: Characters that stand alone but for signs beside them, with any blanks between.
_SIGN = r"""[._\-*~/\\'`^:,;?!"()\[\]{}]"""
_SPACED = re.compile(rf"(?<!\S){_SIGN}{{0,3}}\S{_SIGN}{{0,3}}(?:\s+{_SIGN}{{0,3}}\S{_SIGN}{{0,3}}(?!\S)){{2,}}")
_GAP = re.compile(r"\s+")
_REPEATED = re.compile(r"(.)\1")
_DOUBLED = re.compile(r"([^\W\d_])\1+")
#: Signs that may be letters at the beginning and at the end of a word.
_OPENING, _CLOSING = "@$!|+(€£¡", "@$|+€£"
_SIGNS = re.compile("[" + re.escape("".join(READINGS)) + "]")
_PARTED = re.compile("[" + re.escape(SEPARATORS) + "]+")
_workers: dict[int, "Scorer"] = {}


class Model(NamedTuple):
    trigrams: bytes  # float32 log-probabilities, LETTERS ** 3
    lexicon: dict[int, float]  # feature -> weight
    intercept: float


# -- the channel


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point: 0 an edge or sign, 1-26 a letter, OTHER a letter beyond a-z."""
    of = np.fromiter((OTHER if chr(i).isalpha() else 0 for i in range(0x110000)), np.int8, 0x110000)
    of[ord("a") : ord("z") + 1] = of[ord("A") : ord("Z") + 1] = np.arange(1, 27)
    return of


class _ClassOf(dict):
    """Character -> its class."""

    def __missing__(self, c: str) -> int:
        self[c] = of = int(classes()[ord(c)])
        return of


_class_of = _ClassOf()


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hold_cache("trigrams", lambda: None)
    total = np.zeros(LETTERS**3, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            text = "  ".join(t for t in batch.column(0).slice(at, 256).to_pylist() if t)
            for start in range(0, len(text) or 1, CODES_TOGETHER):  # two characters more, so that no trigram is lost
                part = text[max(0, start - 2) : start + CODES_TOGETHER]
                edges = ("" if start else "  ", "  " if start + CODES_TOGETHER >= len(text) else "")
                codes = classes()[np.frombuffer(f"{edges[0]}{part}{edges[1]}".encode("utf-32-le"), "<u4")].astype(np.int64)
                total += np.bincount((codes[:-2] * LETTERS + codes[1:-1]) * LETTERS + codes[2:], minlength=LETTERS**3)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"gram": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.int64())})
    batch = None
    give_back()


def character_model(docs: DataFrame, text_col: str = "text") -> bytes:
    """Log-probabilities of a character after two others, from all documents; at most LETTERS ** 3 counts come back."""
    counts = docs.select(text_col).mapInArrow(_count_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    n = np.zeros(LETTERS**3)
    for row in counts.collect():
        n[row.gram] = row.n
    n = n.reshape(LETTERS, LETTERS, LETTERS)
    two = n.sum(axis=0)
    back_off = (two + 0.5) / (two + 0.5).sum(axis=1, keepdims=True)
    logs = np.log((n + 2.0 * back_off) / (n.sum(axis=2, keepdims=True) + 2.0))
    return logs.astype(np.float32).tobytes()


class Restorer:
    def __init__(self, trigrams: bytes):
        self.logs = np.frombuffer(trigrams, np.float32).reshape(LETTERS, LETTERS, LETTERS).tolist()

    def viterbi(self, unit: str, gaps: dict[int, bool] | None = None) -> str:
        """The likeliest letters of a unit. A state is the last two classes and what they read; every sign is read
        as one of its letters, or skipped if it parts letters; a character like the one before it may be a repeat.
        `gaps` are places where a new word may start, and whether they are wider than others."""
        states: dict[tuple[int, int, str], tuple[float, tuple]] = {(0, 0, ""): (0.0, ())}
        before = ""
        for i, c in enumerate(unit):
            if gaps and i in gaps:
                parted = {k: (score - (COST_WIDE if gaps[i] else 0.0), text) for k, (score, text) in states.items()}
                for (a, b, last), (score, text) in states.items():
                    if last:
                        _keep(parted, (b, 0, ""), score + self.logs[a][b][0], (text, " "))
                states = parted
            new: dict[tuple[int, int, str], tuple[float, tuple]] = {}
            options = [(r, _class_of[r], COST_READ) for r in READINGS[c]] if c in READINGS else [(c, _class_of[c], 0.0)] if c.isalpha() else []
            skips = COST_SKIP if c in SEPARATORS or c.isspace() or not (options or c.isalpha()) else COST_REPEAT if c == before else None
            for (a, b, last), (score, text) in states.items():
                if skips is not None:
                    _keep(new, (a, b, last), score - skips, text)
                following = self.logs[a][b]
                for letter, k, cost in options:
                    _keep(new, (b, k, letter), score - cost + following[k], (text, letter))
            states, before = new, c
        if not states:
            return ""
        text = max(states.values(), key=lambda s: s[0] + 0.0)[1]
        letters = []
        while text:
            text, letter = text
            letters.append(letter)
        return "".join(reversed(letters))

    def word(self, word: str) -> list[str]:
        """A word of letters alone, and how it reads if letters are repeats."""
        return [word, self.viterbi(word)] if _REPEATED.search(word) else [word]

    def readings(self, chunk: str) -> list[str]:
        """The words of a chunk without white space, restored where its characters allow more than one reading."""
        core = chunk.lower().lstrip("\"'([{").rstrip(".,;:?\"')]}")
        if core.isalpha():
            return self.word(core)
        core = bare(core)
        if core.isalpha():
            return self.word(core)
        pieces = [p for p in _PARTED.split(core) if p]
        if len(pieces) > 1 and all(len(p) <= 2 for p in pieces):
            pieces = ["".join(pieces)]
        out: list[str] = []
        for piece in pieces:
            words = _LETTER_RUN.findall(piece)
            out += words
            if words and (_SIGNS.search(piece) or _REPEATED.search(piece)):
                out.append(self.viterbi(piece))
                if any(s in piece for s in "!|+(") and (inner := piece.strip("!|+(")) and not inner.isalpha():
                    out.append(self.viterbi(inner))
        if len(pieces) > 1:
            out.append(self.viterbi(core))  # the parts may be one word after all
        return out

    def spaced(self, text: str, among: dict[int, float] | None = None) -> list[str]:
        """Words that are written letter by letter, as the lattice parts them; a run is also read as one word, which may
        have a lone letter or sign beside it, so without its first, its last, and both. Words in `among`, a lexicon, are
        found anywhere in a run."""
        out: list[str] = []
        for found in _SPACED.finditer(text):
            run = found[0].lower()
            letters = [c.strip(SEPARATORS + ";?\"()[]{}") or c[:1] for c in run.split()]
            gaps = [len(g) > 1 or g not in " \t" for g in _GAP.findall(run)]
            wide = any(gaps) and not all(gaps)
            places: dict[int, bool] = {}
            at = 0
            for c, gap in zip(letters, gaps):
                at += len(c)
                places[at] = wide and gap
            out += self.viterbi("".join(letters), places).split()
            for a, b in ((0, 0), (1, 0), (0, 1), (1, 1)):
                if len(letters) - a - b >= 3:
                    out.append(self.viterbi(" ".join(letters[a : len(letters) - b])))
            if among:
                out += self.spans(letters, among)
        return out

    def spans(self, letters: list[str], among: dict[int, float]) -> list[str]:
        out: list[str] = []
        for i in range(len(letters)):
            for j in range(i + SPANS[0], min(len(letters), i + SPANS[1]) + 1):
                own = "".join(letters[i:j])
                if 2 * sum(map(str.isalpha, own)) > len(own):
                    word = own if own.isalpha() else self.viterbi(own)
                    # the word and how it begins, as one number alone may be there by chance
                    out += [w for w in (word, *undoubled(word)) if len(w) >= SPANS[0] and all(f in among for f in word_features(w)[:2])]
        return out


def bare(chunk: str) -> str:
    """A chunk without the signs at its ends that cannot be letters, and without repeated signs there; each character is
    looked at once."""
    inside = lambda c: c == "_" or c.isalnum()
    a, b = 0, len(chunk)
    while True:
        was = (a, b)
        while a < b and not (inside(chunk[a]) or chunk[a] in _OPENING):
            a += 1
        while a < b and not (inside(chunk[b - 1]) or chunk[b - 1] in _CLOSING):
            b -= 1
        if b - a >= 2 and chunk[b - 1] == chunk[b - 2] and not inside(chunk[b - 1]):
            last = chunk[b - 1]
            while a < b and chunk[b - 1] == last:
                b -= 1
        if b - a >= 2 and chunk[a] == chunk[a + 1] and not inside(chunk[a]):
            first = chunk[a]
            while a < b and chunk[a] == first:
                a += 1
        if (a, b) == was:
            return chunk[a:b]


def undoubled(word: str) -> list[str]:
    """The word with each of its doubled letters as one or two, but not as it is."""
    runs = [(m.start(), m.end()) for m in _DOUBLED.finditer(word)]
    if not runs:
        return []
    times = itertools.product((1, 2), repeat=len(runs)) if len(runs) <= MAX_DOUBLED else [(n,) * len(runs) for n in (1, 2)]
    out = []
    for chosen in times:
        parts, at = [], 0
        for (start, end), n in zip(runs, chosen):
            parts += [word[at:start], word[start] * n]
            at = end
        out.append("".join(parts) + word[at:])
    return [w for w in out if w != word]


def _keep(states: dict, key: tuple, score: float, text: str) -> None:
    if key not in states or states[key][0] < score:
        states[key] = (score, text)


# -- features and scores


def word_features(word: str) -> tuple[int, ...]:
    """The word, and how it begins, as numbers below FEATURES."""
    parts = [word] + [f"^{word[:n]}" for n in BEGINNINGS if len(word) > n]
    return tuple(zlib.crc32(p.encode()) % FEATURES for p in parts)


class Features:
    """The features of texts, with those of the chunks met before; only the ones in `among`, if that is given."""

    def __init__(self, trigrams: bytes, among: dict[int, float] | None = None):
        self.restorer = Restorer(trigrams)
        self.among = among
        self.cache: dict[str, tuple[int, ...]] = {}

    def known(self, words: list[str]) -> list[str]:
        """The words, and with a lexicon also what they are undoubled, of which only features in it count."""
        return words if self.among is None else words + [u for w in words if _REPEATED.search(w) for u in undoubled(w)]

    def of_words(self, words: list[str]) -> tuple[int, ...]:
        found = [f for w in words for f in word_features(w)]
        return tuple(found if self.among is None else [f for f in found if f in self.among])

    def __call__(self, text: str) -> set[int]:
        chunks = set(text.split())
        if len(self.cache) > CACHED:  # the first ones seen are the frequent ones
            for key in list(itertools.islice(reversed(self.cache), CACHED // 2)):
                del self.cache[key]
        new = [c for c in chunks if c not in self.cache]
        for chunk in new:
            self.cache[chunk] = self.of_words(self.known(self.restorer.readings(chunk)))
        found = set().union(*map(self.cache.__getitem__, chunks))
        for chunk in [c for c in new if len(c) > LONGEST_KEPT]:
            del self.cache[chunk]
        if spaced := self.restorer.spaced(text, self.among):
            found.update(self.of_words(self.known(spaced)))
        return found


class Scorer:
    """A worker's model."""

    def __init__(self, model: Model):
        self.lexicon = model.lexicon
        self.features = Features(model.trigrams, model.lexicon)

    def __call__(self, text: str) -> float:
        return sum(map(self.lexicon.__getitem__, self.features(text)))


def probability(evidence: float, model: Model) -> float:
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, evidence + model.intercept))))


# -- learning


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Lexicon and curve from labels of documents that are not held out; the character model from all documents.

    Each class gives about TRAIN_PER_CLASS documents; a doc_id with several labels counts as toxic if one says so;
    labels without a document, and null ones, are ignored. Without toxic labels the lexicon is empty.
    """
    trigrams = character_model(docs)
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one_each = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r["count"] for r in one_each.groupBy("toxic").count().collect()}  # two classes
    share = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1_000_003)) / 1_000_003
    limit = F.when(F.col("toxic") == 1, TRAIN_PER_CLASS / max(1, sizes.get(1, 0))).otherwise(TRAIN_PER_CLASS / max(1, sizes.get(0, 0)))
    sampled = F.broadcast(one_each.where(share < limit))  # about twice TRAIN_PER_CLASS rows
    sample = docs.select("doc_id", "text").where(F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).join(sampled, "doc_id")
    sample = sample.select("text", "toxic").repartition(TRAIN_PARTITIONS)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of one partition, the documents of each class that have a feature, and as feature -1 all documents."""
        features, counts = Features(trigrams), (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[int(toxic == 1)].update(features(text) | {-1})
        met = list(counts[0].keys() | counts[1].keys())
        columns = [met, [counts[1][f] for f in met], [counts[0][f] for f in met]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["feature", "toxic", "clean"])

    counted = stash(
        sample.mapInArrow(present, "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")),
        "toxicity-features",
    )
    everywhere = counted.where("feature = -1").first()
    n_toxic, n_clean = (everywhere.toxic, everywhere.clean) if everywhere else (0, 0)
    # the log-odds less a standard error, so that chance finds little
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    low = odds - F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    best = counted.where("feature >= 0").withColumn("low", low).where(F.col("low") >= MIN_ODDS)
    chosen = [r.feature for r in best.orderBy(F.desc(F.col("low") * F.sqrt("toxic")), "feature").limit(LEXICON).collect()]
    if not chosen:
        return Model(trigrams, {}, -4.0)

    def design(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Which chosen features the documents of one partition have."""
        features, place = Features(trigrams, dict.fromkeys(chosen, 0.0)), {f: i for i, f in enumerate(chosen)}
        for batch in batches:
            own = [sorted(place[f] for f in features(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32())), batch.column(1).cast(pa.int32())], ["own", "toxic"])

    rows = sample.mapInArrow(design, "own array<int>, toxic int").collect()  # about twice TRAIN_PER_CLASS
    weights, intercept = logistic_regression([r.own for r in rows], [r.toxic == 1 for r in rows], len(chosen))
    return Model(trigrams, dict(zip(chosen, weights)), intercept)


def logistic_regression(rows: list[list[int]], labels: list[bool], width: int, rounds: int = 300) -> tuple[list[float], float]:
    """Weights and intercept over sets of features, by accelerated gradient steps; both classes weigh the same."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    which = np.fromiter(itertools.chain.from_iterable(rows), np.int64, len(at))
    y = np.array(labels, float)
    weigh = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    per_row = np.bincount(at, minlength=len(rows)).max(initial=1) + 1
    often = np.bincount(which, weigh[at], minlength=width)
    step = 4.0 / (np.append(often, weigh.sum()) * np.sqrt(per_row) + RIDGE)
    beta = np.zeros(width + 1)
    beta[-1] = -1.0
    ahead, past = beta.copy(), 1.0
    for _ in range(rounds):
        margin = np.bincount(at, ahead[which], minlength=len(rows)) + ahead[-1]
        error = weigh * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y)
        gradient = np.append(np.bincount(which, error[at], minlength=width) + RIDGE * ahead[:-1], error.sum())
        new, now = ahead - step * gradient, (1 + math.sqrt(1 + 4 * past * past)) / 2
        if (gradient * (new - beta)).sum() > 0:  # overshot
            ahead, past = new, 1.0
        else:
            ahead, past = new + (past - 1) / now * (new - beta), now
        beta = new
    return beta[:-1].tolist(), float(beta[-1])


def score_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add score (0 to 1) to every row; reads only the text.

    A null or empty text has no evidence and takes the intercept's value; repeated rows are scored each; an empty
    table stays empty; other columns are carried, one named score is replaced. Texts are read whole, in time that
    grows with their length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: pa.Array) -> pa.Array:
        model = shared.value
        hold_cache("toxicity", _workers.clear)
        key = hash((model.trigrams, tuple(model.lexicon.items()), model.intercept))
        if key not in _workers:
            _workers.clear()
            _workers[key] = Scorer(model)
        scorer = _workers[key]
        return pa.array([probability(scorer(t.as_py() or ""), model) for t in texts], pa.float64())

    return docs.withColumn("score", F.arrow_udf(in_slices(score), "double")(F.col(text_col)))


def restore_documents(docs: DataFrame, trigrams: bytes, text_col: str = "text", out_col: str = "restored") -> DataFrame:
    """Add the restored readings of every text, joined by spaces; null where the text is null."""

    @F.arrow_udf("string")
    def restore(texts: pa.Array) -> pa.Array:
        restorer = Restorer(trigrams)
        one = lambda t: " ".join([w for c in t.split() for w in restorer.readings(c)] + restorer.spaced(t))
        return pa.array([None if t is None else one(t) for t in texts.to_pylist()], pa.string())

    return docs.withColumn(out_col, restore(F.col(text_col)))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are not toxic, with their columns; learns from `docs` and `labels`."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("_row"), "text")
    return score_documents(rows, train(docs, labels)).where("score < 0.5").select("_row.*")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
