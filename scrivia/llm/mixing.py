"""Mixing sources to target weights.

Every source's words are packed, document after document, into blocks of a fixed length. The mix is made of
output shards; each draws how many blocks it takes from each source (the whole part of its expectation, and a
multinomial draw for the rest), numbers them on from the shard before, and maps each number through the source's
pseudorandom permutation of block indices, one permutation an epoch. Blocks and drawn indices then meet in an
equi-join on (source, block), which spreads even a source that holds most rows. Only built-in functions are used.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivia.llm.common import WORD, input_partitions, stash, table

BLOCK_WORDS = 128
SHARD_BLOCKS = 2048
MAX_SHARDS = 10_000
#: No block, and so no document, is taken more often.
MAX_EPOCHS = 3
#: Documents that one task places in a row within a source, about.
PLACE_TOGETHER = 4096
#: Slots that one task makes, about.
SLOTS_TOGETHER = 1_000_000
#: Up to so many sources, their table is broadcast.
MAX_BROADCAST_SOURCES = 50_000
#: Up to so many repeated rows, their keys are broadcast (80 bytes each).
MAX_BROADCAST_REPEATED = 200_000
#: Rounds of the permutations.
ROUNDS = 6


class Mix(NamedTuple):
    """documents: one row per document with size, source_size, target, taken; sources: one row per source;
    slots: the mix itself, (shard, source_no, slot, block); pieces: (document's place, block, words from and to)."""

    documents: DataFrame
    sources: DataFrame
    slots: DataFrame
    pieces: DataFrame


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"({WORD})")).cast("long"), F.lit(0).cast("long"))


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _uniform(*parts: Column) -> Column:
    """In [0, 1), from the checksum of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / float(2**52)


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> also source_no (by code point, null last), weight (1, 2, 3, repeating) and target.

    All words are shared by weight; a target stops at MAX_EPOCHS times its source's size and what is over is
    shared again. That is the water level L with sum(min(cap, L * weight)) = total: the largest value of
    (total - caps of sources that fill up earlier) / (weights of the others).
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("source_no", F.row_number().over(order)).withColumn("weight", (F.col("source_no") - 1) % 3 + 1)
    fills = Window.orderBy(F.col("source_size") / F.col("weight"), "source_no")
    everything = Window.partitionBy()
    caps = F.col("source_size") * MAX_EPOCHS
    before = F.coalesce(F.sum(caps).over(fills.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(fills.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = ranked.withColumn("_level", (F.sum("source_size").over(everything) - before).cast("double") / rest)
    return level.withColumn(
        "target", F.least(caps.cast("double"), F.max("_level").over(everything) * F.col("weight"))
    ).drop("_level")


def _placed(docs: DataFrame, source_col: str, size_col: str, then: list[str]) -> DataFrame:
    """Each document's first word's number within its source, in the order of the checksums of the ids (of the texts
    where an id is null), and of `then` where ids and sizes are equal.

    A running sum over a whole source would put it into one task; so sums run within ranges of the checksum, and
    ranges start where those before end.
    """
    n = docs.count()
    digits = 0
    while n > PLACE_TOGETHER * 16**digits:
        digits += 1
    keyed = docs.withColumn("_range", F.substring("_key", 1, digits) if digits else F.lit(""))
    starts = keyed.groupBy(source_col, "_range").agg(F.sum(size_col).alias("_words")).withColumn(
        "_start",
        F.coalesce(
            F.sum("_words").over(Window.partitionBy(source_col).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ),
    )
    within = Window.partitionBy(source_col, "_range").orderBy("_key", "doc_id", size_col, *then)
    placed = keyed.withColumns(
        {
            "_ahead": F.coalesce(F.sum(size_col).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "_nth": F.row_number().over(within),
        }
    ).alias("d")
    met = placed.join(
        starts.alias("s"),
        F.col(f"d.{source_col}").eqNullSafe(F.col(f"s.{source_col}")) & (F.col("d._range") == F.col("s._range")),
    )
    return met.select("d.*", (F.col("s._start") + F.col("d._ahead")).alias("_offset"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", by_text: bool = False) -> Mix:
    """Mix `docs` by the weights 1, 2, 3 (repeating) of their sources in code point order.

    A null text or one without words has size 0 and nothing is taken of it; a null source is a source of its own,
    ordered last; repeated rows count one by one, each with its own place; an empty table gives an empty mix.
    Columns of `docs` beyond the three named are not read. The same rows give the same mix, in any order. With `by_text`
    pieces also tell the checksum of the document's text (text_key), and documents of one id and size are in its order.
    """
    spark = docs.sparkSession
    then = ["text_key"] if by_text else []
    sized = stash(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            F.md5(F.coalesce(F.col(id_col).cast("string"), text_key(F.col(text_col))).cast("binary")).alias("_key"),
            *[text_key(F.col(text_col)).alias(c) for c in then],
        ),
        "mix-sizes",
    )
    blocks = F.ceil(F.col("source_size") / BLOCK_WORDS)
    sources = stash(
        source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
        .withColumn("n_blocks", blocks)
        .withColumn("share", F.when(F.col("source_size") > 0, F.col("target") * F.col("n_blocks") / F.col("source_size")).otherwise(0.0)),
        "mix-sources",
    )
    totals = sources.agg(F.count("*").alias("n"), F.coalesce(F.sum("share"), F.lit(0.0)).alias("share")).first()
    n_mixed = round(totals["share"])
    n_shards = min(MAX_SHARDS, max(1, -(-n_mixed // SHARD_BLOCKS)))

    # what each shard expects of each source, the whole parts, and the multinomial draw for the rest
    expected = (
        sources.where("n_blocks > 0")
        .select("source_no", "n_blocks", "share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))).alias("shard"))
        .withColumn(
            "_blocks",
            F.expr(f"((shard + 1) * {n_mixed}L) div {n_shards} - (shard * {n_mixed}L) div {n_shards}"),
        )
        .withColumn("_expected", F.col("_blocks") * (F.col("share") / F.lit(totals["share"])))
        .withColumn("_whole", F.floor("_expected"))
    )
    by_shard = Window.partitionBy("shard").orderBy("source_no")
    rest = expected.withColumns(
        {
            "_high": F.sum(F.col("_expected") - F.col("_whole")).over(by_shard),
            "_left": F.col("_blocks") - F.sum("_whole").over(Window.partitionBy("shard")),
            "_last": F.lead("source_no").over(by_shard).isNull(),
        }
    ).withColumn("_low", F.coalesce(F.lag("_high").over(by_shard), F.lit(0.0)))
    draws = (
        rest.where("_last and _left > 0")
        .select("shard", "_high", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_left"))).alias("_draw"))
        .select(F.col("shard").alias("_of"), (_uniform(F.lit("draw"), F.col("shard").cast("string"), F.col("_draw").cast("string")) * F.col("_high")).alias("_point"))
    )
    hit = (F.col("shard") == F.col("_of")) & (F.col("_point") >= F.col("_low")) & (F.col("_point") < F.col("_high"))
    drawn = rest.join(draws, hit).groupBy("shard", "source_no").agg(F.count("*").alias("_drawn"))
    counts = expected.join(drawn, ["shard", "source_no"], "left").withColumn(
        "_count", F.col("_whole") + F.coalesce("_drawn", F.lit(0))
    )
    before = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.withColumn("_first", F.coalesce(F.sum("_count").over(before), F.lit(0)).cast("long")).withColumn(
        "_end", F.least(F.col("_first") + F.col("_count"), F.col("n_blocks") * MAX_EPOCHS)
    )
    # a few rows become many here: they are dealt out first, by a number that is not put together again
    slots = (
        ranges.where("_end > _first")
        .repartition(max(input_partitions(spark), n_mixed // SLOTS_TOGETHER), "shard", "source_no")
        .select("shard", "source_no", "n_blocks", _round_keys(F.col("source_no"), F.col("n_blocks")).alias("_keys"), F.explode(F.sequence(F.col("_first"), F.col("_end") - 1)).alias("slot"))
        .withColumn("_epoch", F.floor(F.col("slot") / F.col("n_blocks")))
        .withColumn("block", _permuted(F.col("slot") % F.col("n_blocks"), F.col("n_blocks"), F.col("source_no"), F.col("_epoch"), F.col("_keys")))
        .select("shard", "source_no", "slot", "block")
    )

    known = sources.select(F.col("source").alias("_source"), "source_no", "source_size", "target")
    if totals["n"] <= MAX_BROADCAST_SOURCES:
        known = F.broadcast(known)
    placed = _placed(sized, "source", "size", then).join(known, F.col("source").eqNullSafe(F.col("_source")))
    end = F.col("_offset") + F.col("size")
    pieces = (
        placed.select(
            "*",
            F.explode_outer(
                F.when(
                    F.col("size") > 0,
                    F.sequence(F.floor(F.col("_offset") / BLOCK_WORDS), F.floor((end - 1) / BLOCK_WORDS)),
                )
            ).alias("block"),
        )
        .withColumn("_from", F.greatest(F.col("block") * BLOCK_WORDS, "_offset") - F.col("_offset"))
        .withColumn("_to", F.least((F.col("block") + 1) * BLOCK_WORDS, end) - F.col("_offset"))
    )
    times = slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))
    # their size is known too late to trust an automatic broadcast
    taken = pieces.join(times.hint("merge"), ["source_no", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))
    documents = (
        taken.groupBy("source_no", "_range", "_nth")
        .agg(
            *[F.any_value(c).alias(c) for c in ("doc_id", "size", "source_size", "target")],
            F.coalesce(F.sum((F.col("_to") - F.col("_from")) * F.col("times")), F.lit(0)).cast("long").alias("taken"),
        )
        .select("doc_id", "size", "source_size", "target", "taken")
    )
    return Mix(documents, sources, slots, taken)


def _round_keys(source_no: Column, n: Column) -> Column:
    """For each epoch and round of a source's permutations a number below n; made once for a range of slots."""
    key = lambda e, r: F.floor(_uniform(F.lit("key"), source_no.cast("string"), F.lit(str(e)), F.lit(str(r))) * n)
    return F.array(*[F.array(*[key(e, r) for r in range(ROUNDS)]) for e in range(MAX_EPOCHS)])


def _permuted(index: Column, n: Column, source_no: Column, epoch: Column, keys: Column) -> Column:
    """A pseudorandom permutation of 0 .. n-1, another one for each source and epoch, for any n.

    In each round a number and its partner (key - number) mod n trade places, or both stay, by one bit of a checksum of
    the larger of the two; so a round maps the numbers one to one.
    """

    def one(x: Column, round_: Column) -> Column:
        partner = F.pmod(round_["key"] - x, n)
        name = [source_no.cast("string"), epoch.cast("string"), round_["i"].cast("string"), F.greatest(x, partner).cast("string")]
        bit = F.md5(F.concat_ws("|", F.lit("swap"), *name).cast("binary")).substr(1, 1) >= F.lit("8")
        return F.when(bit, partner).otherwise(x)

    rounds = F.transform(F.element_at(keys, (epoch + 1).cast("int")), lambda k, i: F.struct(k.alias("key"), i.alias("i")))
    return F.aggregate(rounds, index, one)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: a document comes once for each epoch that takes of it, with the words of the blocks
    taken in that epoch (its whole text, unchanged, if all were). Returns the columns of `docs`, whatever their names.

    Documents of which nothing is taken go. A null or empty text has no words and goes as well; an empty table stays
    empty. An id may be null, and may stand on several texts: a row is known by id, source, checksum of the text, and
    its number among equal ones. n_chars, if there is one, becomes the length of the text that is taken.
    """
    mix = mix_sources(docs, by_text=True)
    per_copy = (
        mix.pieces.where("times > 0")
        .select("doc_id", "source", "text_key", "size", "_range", "_nth", "source_no", "_from", "_to", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"))
        .groupBy("source_no", "_range", "_nth", "copy")
        .agg(
            F.any_value("doc_id").alias("id"),
            F.any_value("source").alias("of_source"),
            F.any_value("text_key").alias("of_text"),
            F.any_value("size").alias("size"),
            F.sort_array(F.collect_list(F.struct("_from", "_to"))).alias("parts"),
        )
    )
    # equal rows stand one after another in their source
    first = F.min("_nth").over(Window.partitionBy("source_no", "id", "of_text"))
    copies = per_copy.select("id", "of_source", "of_text", "size", "parts", (F.col("_nth") - first + 1).alias("number_taken"))
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", text_key(F.col("text")).alias("key"))
    row = F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("of_source")) & (F.col("key") == F.col("of_text"))
    # only rows that repeat are sorted for their number; the others' texts move once, to meet their copies
    repeated = stash(
        docs.groupBy(F.col("doc_id").alias("id"), F.col("source").alias("of_source"), text_key(F.col("text")).alias("of_text"))
        .agg(F.count("*").alias("times")).where("times > 1").drop("times"),
        "mix-repeated",
    )
    numbered = carried.withColumn("number", F.lit(1))
    if n_repeated := repeated.count():
        if n_repeated <= MAX_BROADCAST_REPEATED:
            repeated = F.broadcast(repeated)
        nth = Window.partitionBy("doc_id", "source", "key").orderBy(F.md5(F.to_json("row").cast("binary")))
        again = carried.join(repeated, row, "left_semi").withColumn("number", F.row_number().over(nth))
        numbered = numbered.join(repeated, row, "left_anti").unionByName(again)
    met = numbered.join(copies, row & (F.col("number") == F.col("number_taken"))).select("row", "size", "parts")
    whole = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["_to"] - p["_from"]) == F.col("size")
    spaced = F.regexp_extract_all(F.col("row.text"), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    cut = F.array_join(
        F.transform("parts", lambda p: F.array_join(F.slice(F.col("words"), (p["_from"] + 1).cast("int"), (p["_to"] - p["_from"]).cast("int")), "")), ""
    )
    out = met.withColumn("words", F.when(~whole, spaced)).withColumn("taken", F.when(F.col("words").isNull(), F.col("row.text")).otherwise(cut))
    changed = {"text": F.col("taken"), "n_chars": F.length("taken").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return out.select(*[changed[c].alias(c) if c in changed else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).documents


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS key FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS source_no FROM totals
), weighed AS (
  SELECT *, (source_no - 1) % 3 + 1 AS weight FROM ranked
), levels AS (
  SELECT *, CAST((SELECT sum(source_size) FROM totals) - coalesce(sum(3 * source_size) OVER (ORDER BY source_size / weight, source_no
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / sum(weight) OVER (ORDER BY source_size / weight, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), targets AS (
  SELECT source, source_size, source_no, least(CAST(3 * source_size AS DOUBLE), (SELECT max(level) FROM levels) * weight) AS target,
         CAST(ceil(source_size / 128) AS BIGINT) AS n_blocks
  FROM levels
), shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN target * n_blocks / source_size ELSE 0.0 END AS share FROM targets
), size_of AS (
  SELECT sum(share) AS share, CAST(round_even(sum(share), 0) AS BIGINT) AS n_mixed FROM shares
), plan AS (
  SELECT *, least(10000, greatest(1, (n_mixed + 2047) // 2048)) AS n_shards FROM size_of
), expected AS (
  SELECT source_no, n_blocks, shard, ((shard + 1) * n_mixed) // n_shards - (shard * n_mixed) // n_shards AS blocks,
         (((shard + 1) * n_mixed) // n_shards - (shard * n_mixed) // n_shards) * (shares.share / plan.share) AS wanted
  FROM shares, plan, range(plan.n_shards) AS r(shard) WHERE n_blocks > 0
), whole AS (
  SELECT *, CAST(floor(wanted) AS BIGINT) AS whole FROM expected
), edges AS (
  SELECT *, sum(wanted - whole) OVER (PARTITION BY shard ORDER BY source_no) AS high,
         blocks - sum(whole) OVER (PARTITION BY shard) AS left_over FROM whole
), cuts AS (
  SELECT *, coalesce(lag(high) OVER (PARTITION BY shard ORDER BY source_no), 0.0) AS low FROM edges
), ends AS (
  SELECT shard, max(high) AS top, CAST(max(left_over) AS BIGINT) AS left_over FROM cuts GROUP BY shard
), points AS (
  SELECT shard, CAST(CAST('0x' || substr(md5('draw|' || shard || '|' || i), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 * top AS point
  FROM ends, LATERAL (SELECT unnest(range(1, left_over + 1)) AS i) t
), drawn AS (
  SELECT c.shard, c.source_no, count(*) AS n FROM cuts c JOIN points p ON p.shard = c.shard AND p.point >= c.low AND p.point < c.high GROUP BY ALL
), taken_of AS (
  SELECT source_no, least(sum(whole + coalesce(n, 0)), 3 * max(n_blocks)) AS n_slots, max(n_blocks) AS n_blocks
  FROM cuts LEFT JOIN drawn USING (shard, source_no) GROUP BY source_no
), slots AS (
  SELECT source_no, n_blocks, slot, slot // n_blocks AS epoch
  FROM taken_of, LATERAL (SELECT unnest(range(0, CAST(n_slots AS BIGINT))) AS slot) t
), x0 AS (
  SELECT source_no, n_blocks, epoch, CAST(slot % n_blocks AS BIGINT) AS x FROM slots
@ROUNDS@), times AS (
  SELECT source_no, x AS block, count(*) AS times FROM x@LAST@ GROUP BY ALL
), placed AS (
  SELECT d.doc_id, d.size, t.source_no, t.source_size, t.target,
         row_number() OVER (PARTITION BY t.source_no ORDER BY d.key, d.doc_id, d.size) AS nth,
         coalesce(sum(d.size) OVER (PARTITION BY t.source_no ORDER BY d.key, d.doc_id, d.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), pieces AS (
  SELECT *, unnest(range(CAST(ahead // 128 AS BIGINT), CAST((ahead + size - 1) // 128 AS BIGINT) + 1)) AS block FROM placed WHERE size > 0
), sums AS (
  SELECT p.source_no, p.nth, sum((least((p.block + 1) * 128, ahead + size) - greatest(p.block * 128, ahead)) * coalesce(times, 0)) AS taken
  FROM pieces p LEFT JOIN times t ON t.source_no = p.source_no AND t.block = p.block GROUP BY ALL
)
SELECT p.doc_id, p.size, p.source_size, p.target, CAST(coalesce(s.taken, 0) AS BIGINT) AS taken
FROM placed p LEFT JOIN sums s USING (source_no, nth)
""".replace(
    "@ROUNDS@",
    "".join(
        f"""), k{r} AS MATERIALIZED (
  SELECT *, (CAST(floor(CAST(CAST('0x' || substr(md5('key|' || source_no || '|' || epoch || '|{r}'), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 * n_blocks) AS BIGINT) - x + n_blocks) % n_blocks AS y
  FROM x{r}
), x{r + 1} AS MATERIALIZED (
  SELECT source_no, n_blocks, epoch, CASE WHEN substr(md5('swap|' || source_no || '|' || epoch || '|{r}|' || greatest(x, y)), 1, 1) >= '8' THEN y ELSE x END AS x
  FROM k{r}
"""
        for r in range(ROUNDS)
    ),
).replace("@LAST@", str(ROUNDS))
