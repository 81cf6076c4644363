"""SQL functions and the table function give what their DataFrame forms give."""

from pyspark.sql import functions as F

from scrivia.functions import text as T
from scrivia.operators import chunking as C
from scrivia.operators import sql_surface

ODD = [None, "", "The cities' bosses. \"Next\" one (3) isn't it?\n\nA | b\n\n| a | b |\n|---|---|\n# head\n", "word " * 200 + "end. " * 90, "é No break. Ünd 'so\tweiter\n \n\nx"]


def test_functions(spark, sf_dir):
    sql_surface.register(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").unionByName(spark.createDataFrame([(t,) for t in ODD], "text string"))
    docs.createOrReplaceTempView("docs_of_test")
    got = spark.sql("SELECT text, tokenize(text) AS t, keywords(text) AS k, split_sentences(text) AS s, units(text) AS u FROM docs_of_test")
    own = got.select("*", T.tokenize(F.col("text")).alias("t2"), T.keywords(F.col("text")).alias("k2"), T.sentences(F.col("text")).alias("s2"), T.units(F.col("text")).alias("u2"))
    assert own.where("NOT (t <=> t2 AND k <=> k2 AND s <=> s2 AND u <=> u2)").count() == 0
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_chunk_text(spark, sf_dir):
    sql_surface.register(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    pages = C.sections(docs, target=900)
    pages.createOrReplaceTempView("pages_of_test")
    got = spark.sql("SELECT * FROM chunk_text(TABLE(SELECT document_id, page, units(text) AS units FROM pages_of_test) PARTITION BY document_id ORDER BY (page), 300, 40)").collect()
    want = C.recursive_chunks(pages, 300, 40).select("document_id", "page", "seq", "text").collect()
    assert sorted((r.document_id, r.page, r.seq, r.text) for r in got) == sorted(map(tuple, want))
    places = {}
    for r in got:
        places.setdefault(r.document_id, []).append((r.page, r.seq, r.number))
    assert all([n for _, _, n in sorted(rows)] == list(range(len(rows))) for rows in places.values())
