"""Slugs settled in rounds against names taken one after another."""

import random

from pyspark.sql import functions as F

from scrivia.operators import registry as R


def one_after_another(names):
    taken, out = set(), []
    for base in names:
        slug, n = base, 2
        while slug in taken:
            slug, n = f"{base}-{n}", n + 1
        taken.add(slug)
        out.append(slug)
    return out


def test_rounds_equal_one_after_another(spark):
    rnd = random.Random(3)
    names = [rnd.choice(["doc", "doc-2", "doc-3", "doc-2-2", "doc-4", "paper", "paper-2", "other"]) for _ in range(120)]
    df = spark.createDataFrame([(i, n, "kept") for i, n in enumerate(names)], "at long, name string, slug_of string")
    got = {r.at: r.slug for r in R.unique_slugs(df, "name", "at").collect()}
    assert [got[i] for i in range(120)] == one_after_another(names)
    assert R.unique_slugs(df.where("false"), "name", "at").count() == 0


def test_names_that_differ_by_a_number_are_one_round(spark):
    df = spark.range(100_000).select("id", F.concat(F.lit("doc "), F.col("id").cast("string")).alias("name"))
    got = R.unique_slugs(df, "name", "id")
    assert got.select("slug").distinct().count() == 100_000 and got.where(F.col("slug") != F.concat(F.lit("doc-"), F.col("id").cast("string"))).count() == 0
