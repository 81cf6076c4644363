import hashlib
import zlib

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from scrivia.llm import piece_bpe, token_count, token_files

PIECES = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
RUNS = ["▁" * n + "x" for n in range(40)] + ["a" * 300, "ab" * 200, "\n\n  \n", " lead", "trail ", "İ,", "क़. Σ."]


def test_op2_equals_the_library(spark, sf_dir, documents):
    got = {r.doc_id: r for r in piece_bpe.op2_sentencepiece(spark, sf_dir).collect()}
    for d in documents.collect():
        ids = PIECES.encode(d.text or "") + [2]
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(PIECES.decode(ids).encode()).hexdigest()


def test_encoding_and_decoding_of_odd_texts(spark, odd_documents):
    more = odd_documents.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(RUNS, 100)), "doc_id long, text string"))
    rows = piece_bpe.decode_documents(piece_bpe.encode_documents(more)).collect()
    assert len(rows) == 10 + len(RUNS)
    for r in rows:
        assert r.ids == PIECES.encode(r.text or "") + [2]
        assert r.decoded == PIECES.decode(r.ids)


def test_decoding_of_any_ids(spark):
    lists = [[1, 2], [], [0], [200], [131, 172, 230], [29871, 29871, 300], [2, 29871, 260], [230, 131, 300]]
    rows = piece_bpe.decode_documents(spark.createDataFrame([(x,) for x in lists], "ids array<int>")).collect()
    assert [r.decoded for r in rows] == [PIECES.decode(x) for x in lists]


def test_op9_equals_the_library(spark, sf_dir, documents, odd_documents):
    got = {r.doc_id: r for r in token_count.op9_token_counts(spark, sf_dir).collect()}
    for d in documents.collect():
        assert (got[d.doc_id].n_bytes, got[d.doc_id].n_tokens) == (len(d.text.encode()), len(PIECES.encode(d.text)))
    for r in token_count.count_tokens(odd_documents).collect():
        assert (r.n_bytes, r.n_tokens) == (len((r.text or "").encode()), len(PIECES.encode(r.text or "")))
    empty = odd_documents.where("false")
    assert token_count.count_tokens(empty).count() == 0


def test_op5_equals_the_library(spark, sf_dir, documents):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start = 0
    got = sorted(token_files.op5_token_files(spark, sf_dir).collect())
    for d, r in zip(sorted(documents.collect(), key=lambda d: d.doc_id), got, strict=True):
        ids = tokenizer.encode(d.text or "", add_special_tokens=False).ids + [1]
        data = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(data))
        start += len(ids)


def test_token_files_of_odd_texts(spark, odd_documents, tmp_path):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    more = odd_documents.select("doc_id", "text").union(spark.createDataFrame([(None, "İ, a. b's."), (50, "İ. <|endoftext|>. x")], "doc_id long, text string"))
    token_files.write_token_files(more, f"file://{tmp_path}/t")
    rows = token_files.read_token_files(spark, f"file://{tmp_path}/t").orderBy("position").collect()
    want = sorted((-1 if r.doc_id is None else r.doc_id, tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in more.collect())
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids) for r in rows) == want
    ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert ids == sorted(ids)
    files = token_files.read_token_files(spark, f"file://{tmp_path}/t")
    assert files.where("doc_id = 3").count() == 3
    starts = [r.start for r in token_files.token_starts(files).orderBy("position").collect()]
    assert starts == [sum(len(x.ids) for x in rows[:i]) for i in range(len(rows))]
