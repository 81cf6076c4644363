import pytest

#: Texts that every operator must take: null, empty, spaces alone, one word, signs, a very long word, a very long text.
ODD_TEXTS = [None, "", "  \n\t ", "word", "the cat. sat é日本😀 <s> <|endoftext|> ▁", "x" * 5000, "la casa de la " * 3000, "a\tb\x0bc\x85d e"]


@pytest.fixture(scope="session")
def odd_documents(spark):
    rows = [(i, t, "en" if i % 2 else None, "src0" if i % 3 else None, -i, i) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[3], rows[3]]  # repeated rows
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens long, label int")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
