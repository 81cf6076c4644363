"""Tokens cut inside tasks against those of the column functions."""

from pyspark.sql import functions as F

from scrivia.functions import text as T
from scrivia.functions.words import alphanumeric_words, coded, lists_of

ODD = [None, "", " ", "The the THIS", "ponies' boss's gas ass ss ies sies a.b'c 'x' 3.14 a..b I'm", "KK İs ſs xéy 日b", "_ a_b", "\U0001f600s's"]


def test_tokens_are_those_of_the_column_function(spark, sf_dir):
    texts = ODD + ["".join(f" a{chr(c)}b {chr(c)}s" for c in range(at, min(at + 2000, 0xD800))) for at in range(1, 0xD800, 2000)]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    words = F.filter(F.split("t", "[^A-Za-z0-9]+"), lambda w: w != "")
    want = rows.select(T.tokenize(F.col("t")).alias("a"), words.alias("b")).orderBy("i").collect()
    code, sizes, tokens = coded(texts)
    at = 0
    for text, size, r in zip(texts, sizes.tolist(), want, strict=True):
        assert [tokens[c] for c in code[at : at + size]] == (r.a or []), text
        assert [w.decode() for w in alphanumeric_words(text or "")] == (r.b or []), text
        at += size
    assert at == len(code) and len(tokens) == len(set(tokens))
    assert lists_of([[b"a", b"b"], [], [b"a"]]).to_pylist() == [["a", "b"], [], ["a"]] and lists_of([]).to_pylist() == []
