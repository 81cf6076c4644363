"""Text functions, registry and cost on small vectors."""

import pytest
from pyspark.sql import functions as F

from scrivia.functions import text as T
from scrivia.operators import cost, registry


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tokens(spark):
    assert one(spark, T.tokenize(F.lit("The Cities' boss's classes, v1.2 and buses"))) == ["city", "boss'", "classe", "v1.2", "buse"]


def test_sentences_and_units(spark):
    assert one(spark, T.sentences(F.lit("One. Two! (Three) is v1.2 here.\n\nfour"))) == ["One.", "Two!", "(Three) is v1.2 here.", "four"]
    assert one(spark, T.units(F.lit("# Head\n\n| a |\n\n" + "Long one. " * 60))) == ["# Head", "| a |"] + ["Long one."] * 60


def test_markdown_rows(spark):
    rows = F.array(F.array(F.lit("a"), F.lit("b|c")), F.array(F.lit(" "), F.lit(None)), F.array(F.lit("1  2")))
    assert one(spark, T.rows_to_markdown(rows)) == "| a | b\\|c |\n|---|---|\n| 1 2 |  |"


def test_markdown_cells_are_made_once(spark):
    """A cell's pattern stands once in the plan, so that the table is not made again for each row."""
    rows = spark.range(2).select(F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.col("id").cast("string"))).alias("rows"))
    plan = rows.select(T.rows_to_markdown(F.col("rows")).alias("m"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("coalesce(") == 1
    assert rows.select(T.describe_table(T.rows_to_markdown(F.col("rows")), F.lit("c")).alias("d"))._jdf.queryExecution().analyzed().toString().count("---|") == 1


def test_citations_and_links(spark):
    assert one(spark, T.citations(F.lit("Herons nest early [2], storks late [1][2]. [123]"))) == [1, 2]
    assert one(spark, T.link_citations(F.lit("a [1] `[1]` [2](x) [9]"), F.lit(2))) == "a [1](#cite-1) `[1]` [2](x) [9]"


def test_entities_and_json(spark):
    assert one(spark, T.proper_phrases(F.lit("The Bank of England met NASA and Al"))) == ["bank of england", "nasa"]
    assert one(spark, T.lenient_json(F.lit('Sure ```json {"k": 3} ```'), "k int")).k == 3
    assert one(spark, T.lenient_json(F.lit("nothing"), "k int")) is None


def test_prices_and_budget(spark):
    prices = spark.createDataFrame([("m-4", 2.0, 10.0), ("m-4-mini", 1.0, 5.0)], "name string, price_in double, price_out double")
    usage = spark.createDataFrame([(1, "models/m-4", 10**6, 0), (2, "m-4-mini-2026", 10**6, 10**6), (3, "x", 5, 5)], "id long, model string, input_tokens long, output_tokens long")
    costed = {r.id: (r.cost_usd, r.unpriced) for r in cost.priced(usage, prices).collect()}
    assert costed == {1: (2.0, False), 2: (6.0, False), 3: (0.0, True)}
    spent = spark.createDataFrame([("k", i, 0.006) for i in range(4)], "key string, id long, cost_usd double")
    kept = cost.within_budget(spent, "key", ["id"], 0.01).orderBy("id").collect()
    assert [(r.id, r.over) for r in kept] == [(0, False), (1, True)]


def test_staging_rejects(spark):
    files = spark.createDataFrame([("a.md", 5), ("x.exe", 5), ("b.PDF", 0), ("c.csv", 2**21)], "name string, size long")
    ok, bad = registry.stage_files(files, 1)
    assert [r.name for r in ok.collect()] == ["a.md"]
    assert {r.name: r.reason for r in bad.collect()} == {"x.exe": "unsupported", "b.PDF": "empty", "c.csv": "too large"}


def test_slugs(spark):
    names = spark.createDataFrame([(1, "My Docs"), (2, "my docs!"), (3, "")], "id long, name string")
    assert {r.id: r.slug for r in registry.unique_slugs(names, "name", "id").collect()} == {1: "my-docs", 2: "my-docs-2", 3: "collection"}
    names = spark.createDataFrame(list(enumerate(["a-2", "a", "a", "a", "b", "a 2", "b", "x" * 39 + "-y"])), "id long, name string")
    got = {r.id: r.slug for r in registry.unique_slugs(names, "name", "id").collect()}
    assert got == {0: "a-2", 1: "a", 2: "a-3", 3: "a-4", 4: "b", 5: "a-2-2", 6: "b-2", 7: "x" * 39 + "-"}


def test_places_that_do_not_belong_together_fail(spark):
    df = spark.createDataFrame([(1, ["a", "b"], [5, 6]), (2, [], [])], "id long, tables array<string>, notes array<int>")
    assert [tuple(r) for r in registry.described(df, "tables", "notes").orderBy("n").collect()] == [(1, 1, "a", 5), (1, 2, "b", 6)]
    with pytest.raises(Exception, match="differ in length"):
        registry.described(spark.createDataFrame([(1, ["a"], [5, 6])], df.schema), "tables", "notes").collect()


def test_entities_of_many_names_are_counted_in_one_pass(spark):
    import time

    from scrivia.functions import text as T

    names = [f"Name{i // 3 if i % 5 else 7}ia" for i in range(10_000)]
    want = sorted({n: (-names.count(n), names.index(n)) for n in set(names)}.items(), key=lambda x: x[1])[:8]
    df = spark.createDataFrame([("; ".join(names) + ".",)], "text string")
    few = df.select(T.heuristic_entities(F.substring("text", 1, 200))).first()
    assert few
    began = time.monotonic()
    got = df.select(T.heuristic_entities(F.col("text"))).first()[0]
    assert got == [n.lower() for n, _ in want] and time.monotonic() - began < 5


def test_chunks_of_every_document_and_owned_transcripts(spark):
    from scrivia.operators import registry as R

    chunks = spark.range(1300).select((F.col("id") % 2).alias("document_id"), (F.col("id") % 7).alias("page"), F.col("id").alias("ordinal"))
    kept = R.document_chunks(chunks)
    assert [r["count"] for r in kept.groupBy("document_id").count().collect()] == [500, 500] and kept.where("page > 5").count() == 0
    turns = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, "a")], "conv_id long, turn long, role string")
    got = R.transcripts(turns, spark.createDataFrame([(1, "me")], "conv_id long, owner string")).collect()
    assert sorted(map(tuple, got)) == [(1, "me", "a>b"), (2, None, None)]
