import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from scrivia.llm import common, piece_bpe


def test_results_leave_few_rows_at_a_time():
    sizes, seen = [], []

    def of(texts):
        sizes.append(len(texts))
        return texts

    for out in common.in_slices(of, 3)(iter([pa.array(range(7)), pa.array([], pa.int64()), pa.array([7])])):
        seen += out.to_pylist()
    assert seen == list(range(8)) and sizes == [3, 3, 1, 1]


def test_one_pass_codes_as_two_do(spark, odd_documents):
    rows = odd_documents.select("doc_id", "text", F.lit(1).alias("ids"), F.lit("x").alias("decoded"))
    two = piece_bpe.decode_documents(piece_bpe.encode_documents(rows)).select("doc_id", "text", "ids", "decoded")
    one = piece_bpe.code_documents(rows).select("doc_id", "text", "ids", "decoded")
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_the_encoding_stage_encodes_a_text_once(spark, odd_documents):
    plan = corpus_pipeline.encoding_stage(spark, odd_documents, "none")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1 and plan.count("#") and plan.split("ArrowEvalPython [")[1].split("]")[0].count("(text#") == 1


def test_a_worker_keeps_few_pre_tokens():
    bpe = piece_bpe.PieceBpe()
    texts = pa.array([" ".join(f"w{n}" for n in range(at, at + 1000)) for at in range(0, 400_000, 1000)])
    bpe.encode(texts)
    assert len(bpe.cache) <= piece_bpe.CACHED + 1000 * piece_bpe.TOGETHER <= 400_000
    assert bpe.encode(texts.slice(399)).to_pylist() == piece_bpe.PieceBpe().encode(texts.slice(399)).to_pylist()
