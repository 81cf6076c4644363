"""Prices, usage, budgets and ingest estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Price lists are small: beyond so many rows the prefix join is refused.
MAX_PRICES = 10_000
# Tokens of an image in and out, of a table in and out, and characters that fill a page densely.
IMAGE_IN, IMAGE_OUT, TABLE_IN, TABLE_OUT, DENSE_PAGE = 1700, 260, 900, 120, 600


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage (model, input_tokens, output_tokens) with cost_usd and unpriced.

    A model has the price of its name without `models/`, else of the longest known name that it starts with. Names are
    matched once for each distinct model: its prefixes meet the price list in an equi-join.
    """
    names = usage.select("model").distinct().withColumn("_name", F.regexp_replace("model", "^models/", ""))
    starts = names.select("model", F.explode(F.transform(F.sequence(F.lit(1), F.length("_name")), lambda n: F.substr("_name", F.lit(1), n))).alias("_known"))
    met = starts.join(prices.withColumnRenamed("name", "_known"), "_known")
    best = met.groupBy("model").agg(F.max_by(F.struct("price_in", "price_out"), F.length("_known")).alias("_price"))
    cost = (F.col("input_tokens") * F.col("_price.price_in") + F.col("output_tokens") * F.col("_price.price_out")) / 1_000_000
    return usage.join(best, "model", "left").withColumns({"cost_usd": F.coalesce(cost, F.lit(0.0)), "unpriced": F.col("_price").isNull()}).drop("_price")


def usage_totals(costed: DataFrame, *keys: str) -> DataFrame:
    return costed.groupBy(*keys).agg(
        F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.round(F.sum("cost_usd"), 6).alias("cost_usd"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("unpriced"), F.col("model")))), ",").alias("unpriced_models"),
    )


def within_budget(costed: DataFrame, key: str, order: list[str], budget: float | None) -> DataFrame:
    """Events up to and with the first that takes the key's total above the budget; none or 0 is no limit."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    spent = costed.withColumn("spent_before", F.coalesce(F.sum("cost_usd").over(before), F.lit(0.0)))
    if not budget:
        return spent.withColumn("over", F.lit(False))
    return spent.where(F.col("spent_before") <= budget).withColumn("over", F.col("spent_before") + F.col("cost_usd") > budget)


def ingest_estimate(parsed: DataFrame, price_in: float, price_out: float, embed_price: float, semantic: bool = True, budget: float | None = 2.0) -> DataFrame:
    """parsed: document_id, pages, chars, images, tables -> calls, tokens, cost and its band."""
    calls = F.col("images") + F.col("tables")
    tokens_in = F.col("images") * IMAGE_IN + F.col("tables") * TABLE_IN
    tokens_out = F.col("images") * IMAGE_OUT + F.col("tables") * TABLE_OUT
    embed = F.floor(F.col("chars") / 4 * (3.2 if semantic else 1.15)) + F.col("images") * IMAGE_OUT + F.col("tables") * 600
    cost = (tokens_in * price_in + tokens_out * price_out + embed * embed_price) / 1_000_000
    return parsed.select(
        "document_id", calls.alias("calls"), tokens_in.alias("input_tokens"), tokens_out.alias("output_tokens"), embed.cast("long").alias("embedding_tokens"),
        F.bround(cost, 4).alias("cost_usd"), F.bround(cost * 0.6, 4).alias("cost_low_usd"), F.bround(cost * 1.5, 4).alias("cost_high_usd"),
        (F.lit(bool(budget)) & (cost * 1.5 > (budget or 0))).alias("over_budget"),
    )
