"""Quality rules with adaptive thresholds.

Base counts of every text become ratios in whole numbers. Their quantile sketches, over the documents that pass the
fixed base rules, are counts per whole number, for each language and source: they merge by addition, so tasks sum them
before the shuffle, and the sketches of small groups fall back on those of their language, of their source, or of all,
merged from the same counts. A sketch has at most LARGEST + 1 cells, its ranks are exact, and its values are below by
less than one unit. Limits come from a group's quantiles, so they follow the group; then documents meet the limits of
their group and are filtered.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivia.llm.common import WORD, hold_cache, in_slices, stash, table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
#: Ratios in thousandths, each with two quantiles: the limit is the upper one and SPREAD times its distance from the
#: lower one, or more, by two further quantiles of the group. One is the room that a text of the lower quartile of
#: sizes gives to chance: ROOM[metric] symbols, lines or words of it, as a ratio. The other looks at the texts that have
#: any (non-zero cells). Where only a minority has symbols, the limit stands halfway between none and the lower quartile
#: of those; lines repeat by chance in clean texts too, so there the limit is FAR times the quartiles' distance beyond.
UPPER = {"symbol_ratio": ("q50", "q25"), "dup_line_ratio": ("q50", "q25"), "repeat_ratio": ("q90", "q75")}
SPREAD, FAR = 6, 3
ROOM = {"symbol_ratio": (10, "word_chars"), "dup_line_ratio": (2, "n_lines"), "repeat_ratio": (45, "n_words")}
#: The mean length of a word, in hundredths of a character, has limits on both sides of the median, WIDTH times the
#: smaller distance of the quartiles from it, or LEAST_WIDTH. The smaller one is that of clean texts even where a third
#: of a group are long or short by junk.
WIDTH, LEAST_WIDTH = 12, 8
METRICS = [*UPPER, "word_length"]
ROOMS = [f"room_{m}" for m in ROOM]
LARGEST = 100_000
QUANTILES = {"q25": (1, 4), "q50": (1, 2), "q75": (3, 4), "q90": (9, 10)}
#: Groups with fewer documents take the sketch of their language, then of their source, or of all.
MIN_GROUP = 100
#: Up to so many groups, their thresholds are broadcast.
MAX_BROADCAST_GROUPS = 100_000

_WORDS = re.compile(WORD)
BASE = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def base_counts(text: str) -> tuple[int, ...]:
    """The counts in BASE of one whole text; n_lines counts lines with a word."""
    words = _WORDS.findall(text)
    lines = Counter(line for line in text.split("\n") if _WORDS.search(line))
    n_lines = sum(lines.values())
    return (
        len(words),
        sum(map(len, words)),
        sum(text.count(c) for c in SYMBOLS),
        n_lines,
        n_lines - len(lines),
        repeated_words(words),
    )


def repeated_words(words: list[str]) -> int:
    """Words in windows of three that occur twice or more, the first occurrence included."""
    if len(words) < 4:
        return 0
    numbers: dict[str, int] = {}
    at = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) == len(words):
        return 0
    n = len(numbers)
    if n < 2_000_000:
        windows = (at[:-2] * n + at[1:-1]) * n + at[2:]
    else:  # three numbers would not fit; pairs are numbered first
        pairs = np.unique(at[:-1] * n + at[1:], return_inverse=True)[1]
        windows = pairs[:-1] * n + at[2:]
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    twice = times[which] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(twice)] |= twice
    return int(covered.sum())


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the BASE counts, METRICS and base_failed to every row; a null text counts as empty."""
    schema = ", ".join(f"{name}: bigint" for name in BASE)

    def count(texts: pa.Array) -> pa.Array:
        hold_cache("quality", lambda: None)
        found = [base_counts(t.as_py() or "") for t in texts]
        columns = zip(*found) if found else [[]] * len(BASE)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], BASE)

    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in BASE])
    counts = F.arrow_udf(in_slices(count), f"struct<{schema}>")
    counted = docs.select(own.alias("_own"), counts(F.col(text_col)).alias("_counts")).select("_own.*", "_counts.*")
    ratio = lambda part, whole: F.least(F.lit(1000), F.expr(f"coalesce({part} * 1000 div nullif({whole}, 0), 0)"))
    return counted.withColumns(
        {
            "symbol_ratio": ratio("n_symbols", "word_chars"),
            "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
            "repeat_ratio": ratio("n_repeat_words", "n_words"),
            **{f"room_{m}": ratio(f"{k}L", whole) for m, (k, whole) in ROOM.items()},
            "word_length": F.least(F.lit(LARGEST), F.expr("coalesce(word_chars * 100 div nullif(n_words, 0), 0)")),
            "base_failed": (F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        }
    )


def sketches(counted: DataFrame) -> DataFrame:
    """lang, source, metric, bin, n: the mergeable sketch of every group that has a document that passes the base rules."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("int").alias("bin")) for m in [*METRICS, *ROOMS]])
    passed = counted.where("not base_failed").select("lang", "source", F.inline(cells))
    return passed.groupBy("lang", "source", "metric", "bin").agg(F.count("*").alias("n"))


def _limits(summed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, total, and least_<metric> and most_<metric> of every sketch in `summed`."""
    sketch = Window.partitionBy(*keys, "metric")
    placed = summed.withColumns(
        {
            "_upto": F.sum("n").over(sketch.orderBy("bin")),
            "_total": F.sum("n").over(sketch),
            "_zero": F.sum(F.when(F.col("bin") == 0, F.col("n")).otherwise(0)).over(sketch),
        }
    )
    beyond = lambda part, of, none: (F.col("_upto") - none) * of >= (F.col("_total") - none) * part
    first = lambda m, fits: F.min(F.when((F.col("metric") == m) & fits, F.col("bin")))
    found = {}
    for m in [*METRICS, *ROOMS]:
        for name, (part, of) in QUANTILES.items():
            found[f"{name}_{m}"] = first(m, beyond(part, of, F.lit(0)))
    for m in ("symbol_ratio", "dup_line_ratio"):
        for name in ("q25", "q75"):
            part, of = QUANTILES[name]
            found[f"some_{name}_{m}"] = first(m, (F.col("bin") > 0) & beyond(part, of, F.col("_zero")))
    total = F.max(F.when(F.col("metric") == "word_length", F.col("_total")))
    wide = placed.groupBy(*keys).agg(total.alias("total"), *[value.alias(name) for name, value in found.items()])

    q = lambda name, m: F.col(f"{name}_{m}")
    limits = {}
    for m, (high, low) in UPPER.items():
        limits[m] = (F.lit(0), F.greatest(q(high, m) + SPREAD * (q(high, m) - q(low, m)), q("q75", f"room_{m}")))
    least, most = limits["symbol_ratio"]
    limits["symbol_ratio"] = (least, F.greatest(most, F.floor(q("some_q25", "symbol_ratio") / 2)))
    least, most = limits["dup_line_ratio"]
    spread = q("some_q75", "dup_line_ratio") - q("some_q25", "dup_line_ratio")
    limits["dup_line_ratio"] = (least, F.greatest(most, q("some_q75", "dup_line_ratio") + FAR * spread))
    m = "word_length"
    width = WIDTH * F.greatest(F.lit(LEAST_WIDTH), F.least(q("q50", m) - q("q25", m), q("q75", m) - q("q50", m)))
    limits[m] = (q("q50", m) - width, q("q50", m) + width)
    return wide.select(*keys, "total", *[c.cast("bigint").alias(f"{side}_{m}") for m in METRICS for side, c in zip(("least", "most"), limits[m])])


LEVELS = {"own": ["lang", "source"], "of_lang": ["lang"], "of_source": ["source"], "of_all": []}


def group_thresholds(cells: DataFrame) -> DataFrame:
    """lang, source, level, and least_<metric> and most_<metric> of every group, from its own sketch or the one it falls
    back on, which `level` names."""
    sides = [f"{side}_{m}" for m in METRICS for side in ("least", "most")]
    met = None
    for name, keys in LEVELS.items():
        limits = _limits(cells.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n")), keys)
        found = limits.select(*[F.col(k).alias(f"_{k}_{name}") for k in keys], F.struct("total", *sides).alias(f"_{name}"))
        if met is None:
            met = found.withColumnsRenamed({f"_{k}_{name}": k for k in keys})
        elif keys:
            met = met.join(found, F.col(keys[0]).eqNullSafe(F.col(f"_{keys[0]}_{name}")))
        else:
            met = met.withColumn("_one", F.lit(1)).join(found.withColumn("_one", F.lit(1)), "_one")  # one row
    chosen, level = F.col("_of_all"), F.lit("of_all")
    for name in reversed([n for n in LEVELS if n != "of_all"]):
        enough = F.col(f"_{name}.total") >= MIN_GROUP
        chosen, level = F.when(enough, F.col(f"_{name}")).otherwise(chosen), F.when(enough, F.lit(name)).otherwise(level)
    return met.select("lang", "source", level.alias("level"), chosen.alias("_chosen")).select("lang", "source", "level", *[f"_chosen.{c}" for c in sides])


def judge(counted: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Add kept: false if base_failed or if a metric is beyond its group's limits."""
    names = [f"{c}_{m}" for m in METRICS for c in ("least", "most")]
    limits = thresholds.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *names)
    if limits.count() <= MAX_BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    met = counted.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    fine = ~F.col("base_failed")
    for m in METRICS:
        fine = fine & F.col(m).between(F.col(f"least_{m}"), F.col(f"most_{m}"))
    return met.withColumn("kept", F.coalesce(fine, F.lit(False))).drop("_lang", "_source")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (lang, source, text) that pass, with their columns.

    A null or empty text has no words and goes; a null lang or source is a group of its own; repeated rows are
    judged each; an empty table stays empty; columns named like a count or ratio are carried as they are. Texts are
    counted once: rows wait in the shared folder with their counts.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text", "lang", "source")
    counted = stash(with_counts(rows).drop("text"), "quality-rows")
    limits = stash(group_thresholds(sketches(counted)), "quality-thresholds")
    return judge(counted, limits).where("kept").select("_row.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    counted = stash(with_counts(docs).drop("text"), "quality-counts")
    limits = stash(group_thresholds(sketches(counted)), "quality-thresholds")
    return judge(counted, limits).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP8_SQL = r"""
WITH cut AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w FROM cut, LATERAL (SELECT unnest(range(1, len(ws) - 1)) AS i) t
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + d) AS n FROM twice, (VALUES (0), (1), (2)) s(d) GROUP BY r
), counts AS (
  SELECT c.r, doc_id, lang, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words
  FROM cut c LEFT JOIN covered v ON v.r = c.r
), ratios AS (
  SELECT *, least(1000, coalesce(n_symbols * 1000 // nullif(word_chars, 0), 0)) AS symbol_ratio,
         least(1000, coalesce(n_dup_lines * 1000 // nullif(n_lines, 0), 0)) AS dup_line_ratio,
         least(1000, coalesce(n_repeat_words * 1000 // nullif(n_words, 0), 0)) AS repeat_ratio,
         least(1000, coalesce(10000 // nullif(word_chars, 0), 0)) AS room_symbol_ratio,
         least(1000, coalesce(2000 // nullif(n_lines, 0), 0)) AS room_dup_line_ratio,
         least(1000, coalesce(45000 // nullif(n_words, 0), 0)) AS room_repeat_ratio,
         least(100000, coalesce(word_chars * 100 // nullif(n_words, 0), 0)) AS word_length,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM counts
), cells AS (
  SELECT lang, source, metric, bin, count(*) AS n
  FROM (SELECT lang, source, unnest(['symbol_ratio', 'dup_line_ratio', 'repeat_ratio', 'word_length', 'room_symbol_ratio', 'room_dup_line_ratio',
                                     'room_repeat_ratio']) AS metric,
               unnest([symbol_ratio, dup_line_ratio, repeat_ratio, word_length, room_symbol_ratio, room_dup_line_ratio, room_repeat_ratio]) AS bin FROM ratios WHERE NOT base_failed) GROUP BY ALL
), levels AS (
  SELECT 0 AS level, lang, source, metric, bin, n FROM cells
  UNION ALL SELECT 1, lang, NULL, metric, bin, sum(n) FROM cells GROUP BY ALL
  UNION ALL SELECT 2, NULL, source, metric, bin, sum(n) FROM cells GROUP BY ALL
  UNION ALL SELECT 3, NULL, NULL, metric, bin, sum(n) FROM cells GROUP BY ALL
), placed AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bin) AS upto,
         sum(n) OVER (PARTITION BY level, lang, source, metric) AS total,
         coalesce(sum(n) FILTER (bin = 0) OVER (PARTITION BY level, lang, source, metric), 0) AS zero FROM levels
), quantiles AS (
  SELECT level, lang, source, metric, max(total) AS n, min(bin) FILTER (4 * upto >= total) AS q25, min(bin) FILTER (2 * upto >= total) AS q50,
         min(bin) FILTER (4 * upto >= 3 * total) AS q75, min(bin) FILTER (10 * upto >= 9 * total) AS q90,
         min(bin) FILTER (bin > 0 AND 4 * (upto - zero) >= total - zero) AS some25,
         min(bin) FILTER (bin > 0 AND 4 * (upto - zero) >= 3 * (total - zero)) AS some75
  FROM placed GROUP BY ALL
), limits AS (
  SELECT level, lang, source, max(n) FILTER (metric = 'word_length') AS n,
         greatest(max(greatest(q50 + 6 * (q50 - q25), some25 // 2)) FILTER (metric = 'symbol_ratio'), max(q75) FILTER (metric = 'room_symbol_ratio')) AS s,
         greatest(max(greatest(q50 + 6 * (q50 - q25), some75 + 3 * (some75 - some25))) FILTER (metric = 'dup_line_ratio'),
                  max(q75) FILTER (metric = 'room_dup_line_ratio')) AS d,
         greatest(max(q90 + 6 * (q90 - q75)) FILTER (metric = 'repeat_ratio'), max(q75) FILTER (metric = 'room_repeat_ratio')) AS p,
         max(q50 - 12 * greatest(8, least(q50 - q25, q75 - q50))) FILTER (metric = 'word_length') AS w0,
         max(q50 + 12 * greatest(8, least(q50 - q25, q75 - q50))) FILTER (metric = 'word_length') AS w1
  FROM quantiles GROUP BY ALL
), wide AS (
  SELECT o.lang, o.source, unnest(CASE WHEN o.n >= 100 THEN {'s': o.s, 'd': o.d, 'p': o.p, 'w0': o.w0, 'w1': o.w1}
                                       WHEN l.n >= 100 THEN {'s': l.s, 'd': l.d, 'p': l.p, 'w0': l.w0, 'w1': l.w1}
                                       WHEN c.n >= 100 THEN {'s': c.s, 'd': c.d, 'p': c.p, 'w0': c.w0, 'w1': c.w1}
                                       ELSE {'s': a.s, 'd': a.d, 'p': a.p, 'w0': a.w0, 'w1': a.w1} END)
  FROM limits o JOIN limits l ON o.level = 0 AND l.level = 1 AND l.lang IS NOT DISTINCT FROM o.lang
  JOIN limits c ON c.level = 2 AND c.source IS NOT DISTINCT FROM o.source JOIN limits a ON a.level = 3
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       coalesce(NOT base_failed AND symbol_ratio <= s AND dup_line_ratio <= d AND repeat_ratio <= p AND word_length BETWEEN w0 AND w1, false) AS kept
FROM ratios r LEFT JOIN wide w ON r.lang IS NOT DISTINCT FROM w.lang AND r.source IS NOT DISTINCT FROM w.source
"""
