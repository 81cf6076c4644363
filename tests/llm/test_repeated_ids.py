"""Near duplicates and mixing where ids repeat or are null."""

from collections import Counter

from scrivia.llm import jaccard_join, mixing, quality

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def text(name, n=60):
    return " ".join(f"{name}{i}" for i in range(n))


def test_deduplicated_keeps_one_row_of_each_component(spark):
    near = text("a") + " z"
    rows = [
        (1, text("a")), (1, text("b")), (1, None), (2, near), (2, text("c")), (2, ""),
        (None, text("d")), (None, text("d") + " z"), (None, text("e")), (None, near), (3, text("f")), (3, text("f")), (4, text("e")),
    ]
    df = spark.createDataFrame([(d, t, "en", f"s{i}", 1) for i, (d, t) in enumerate(rows)], COLUMNS)
    got = Counter((r.doc_id, (r.text or "")[:1]) for r in jaccard_join.deduplicated(df).collect())
    assert got == Counter([(1, "a"), (1, "b"), (1, ""), (2, "c"), (2, ""), (None, "d"), (3, "f"), (4, "e")])
    assert jaccard_join.deduplicated(df.where("false")).count() == 0


def test_mixed_documents_with_null_and_repeated_ids(spark):
    rows = [(i if i % 3 else None, text(f"x{i}_", 40 + 7 * i), f"l{i % 2}", f"s{i % 2}") for i in range(60)]
    rows += [(7, text(f"y{i}_", 30 + 50 * i), "l", "s1") for i in range(12)]  # one id on several texts
    rows += [(8, text("again", 90), f"l{i}", None) for i in range(3)]  # equal but for a column
    df = spark.createDataFrame([(d, t, lang, s, len(t)) for d, t, lang, s in rows], COLUMNS)
    want = Counter()
    for r in mixing.mix_sources(df, by_text=True).pieces.where("times > 0").collect():
        want[r.doc_id, r.source, r.text_key] += (r._to - r._from) * r.times
    known = {w: (d, s, mixing_key(t)) for d, t, _, s in rows for w in t.split()}
    got = Counter()
    for r in mixing.mixed_documents(df).collect():
        for word in r.text.split():
            assert known[word][:2] == (r.doc_id, r.source)
            got[known[word]] += 1
    assert got == want
    taken = sum(r.taken for r in mixing.mix_sources(df).documents.collect())
    assert sum(got.values()) == taken


def test_columns_of_any_name_are_carried(spark):
    names = ["source_no", "_n", "_size", "_nth", "row", "key", "number", "copy", "parts", "size", "times", "id", "own", "label", "digest", "taken", "words", "kept"]
    rows = [(i % 9 if i % 5 else None, text(f"t{i % 12}_", 70), "en", f"s{i % 3}", 1, *[f"{n}{i}" for n in names]) for i in range(30)]
    df = spark.createDataFrame(rows, f"{COLUMNS}, " + ", ".join(f"{n} string" for n in names))
    by_row = {tuple(r)[5:] for r in df.collect()}
    for stage in (mixing.mixed_documents, jaccard_join.deduplicated, quality.kept_documents):
        got = stage(df)
        found = got.collect()
        assert got.columns == df.columns and found and {tuple(r)[5:] for r in found} <= by_row, stage


def mixing_key(text):
    import hashlib

    return hashlib.md5(text.encode()).hexdigest()
