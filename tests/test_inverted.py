from pyspark.sql import functions as F

from scrivia.operators import lexical as L


def test_spans_are_inverted_in_slices(spark, monkeypatch):
    corpus = spark.range(50).select(F.col("id").alias("chunk_id"), F.concat(F.lit("word number n"), "id").alias("text")).coalesce(1)
    questions = spark.createDataFrame([(1, "word n7"), (2, "number n31 n40")], "question_id long, question string")
    whole = L.bm25(questions, L.lexical_index(corpus), 5).collect()
    monkeypatch.setattr(L, "INVERTED", 7)
    cut = L.lexical_index(corpus)
    assert cut.read("blocks").agg(F.max(F.size("docs"))).first()[0] <= 7
    assert sorted(map(str, L.bm25(questions, cut, 5).collect())) == sorted(map(str, whole))
