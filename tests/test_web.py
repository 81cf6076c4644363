"""Tables, captions, images and sections of web pages."""

import re

import pytest
from pyspark.sql import functions as F

from scrivia.functions import text as T
from scrivia.operators.chunking import cut_sections, section_of
from scrivia.sources import corpus

LONG = "".join(f"<h2>Part {i}</h2><p>{'word ' * 500}</p>" for i in range(6))
PAGES = {
    1: "<title>T</title><h1>A</h1><p>text<img alt='in p'> goes on</p><table><caption>Sales <b>2024</b></caption><tr><th>x|y<th>n</tr><tr><td>1<td>2</table><p>end",
    2: f"{LONG}<table><tr><td>deep<td>down</tr></table><img alt='late'><p>last</p>",
    3: "<table><tr><td>outer <table><tr><td>inner</td></tr></table> more</td><td>b</td></tr></table>",
    4: "<table><tr><td>never<td>closed",
    5: "<table></table><table><caption>empty</caption><tr><td> </td></tr></table>",
    6: "",
    7: None,
    8: "<nav><table><tr><td>menu</td></tr></table></nav><p>one<br>two</p><td>stray</td>",
}


TABLE = "<table><caption>Cap</caption><tr><th>k</th><th>v</th></tr><tr><td>a|b</td><td>1</td></tr></table><img alt='i' src='x'>"


@pytest.fixture(scope="module")
def given(spark, sf_dir):
    """The given pages, which have no tables, with one between every two paragraphs."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("html", F.replace("html", F.lit("</p><p>"), F.lit(f"</p>{TABLE}<p>")))


@pytest.fixture(scope="module")
def read(spark):
    return corpus.web_pages(spark.createDataFrame(list(PAGES.items()), "page_id long, html string")).persist()


def test_tables_stand_in_the_text_with_caption_and_section(read):
    rows = {r.page_id: r for r in read.collect()}
    one = rows[1]
    assert one.text == "# A\n\ntext goes on\n\n| x\\|y | n |\n|---|---|\n| 1 | 2 |\n\nend"
    assert [(e.kind, e.caption, e.section) for e in one.elements] == [("table", "Sales 2024", 1), ("image", "in p", 1)]
    assert one.text[one.elements[0].at :].startswith(one.elements[0].markdown)
    two = rows[2]
    assert len(two.sections) > 2 and {e.section for e in two.elements} == {len(two.sections)}
    assert [[" ".join(r) for r in t] for t in rows[3].tables] == [["outer inner more b"], ["inner"]]
    assert rows[4].tables == [[["never", "closed"]]]
    for empty in (5, 6, 7):
        assert (rows[empty].text, rows[empty].elements, rows[empty].sections) == ("", [], [""])
    assert (rows[8].text, rows[8].tables) == ("one two", [])


def test_markdown_and_sections_equal_the_column_forms(given):
    pages = corpus.web_pages(given).persist()
    assert pages.select(F.sum(F.size("tables"))).first()[0] > 100
    for r in pages.collect():
        assert r.sections == cut_sections(r.text)
        for e in r.elements:
            if e.kind == "table":
                assert r.text[e.at : e.at + len(e.markdown)] == e.markdown
    rows = pages.select(F.explode("tables").alias("rows"), "elements")
    assert rows.where(~F.exists("elements", lambda e: e["markdown"] == T.rows_to_markdown(F.col("rows")))).count() == 0
    elements = corpus.web_elements(pages)
    by_join = section_of(elements.select("document_id", F.col("at").alias("offset")).distinct(), corpus.web_sections(pages).select("document_id", "page", "text"))
    want = {(r.document_id, r.offset, r.page) for r in by_join.select("document_id", "offset", "page").collect()}
    assert {(r.document_id, r["at"], r.page) for r in elements.collect()} == want


def test_tables_of_the_given_pages_are_all_found(given):
    html = {r.page_id: re.sub(r"(?s)<(script|style|noscript|nav|footer|header|form|svg)\b.*?</\1>", "", r.html or "") for r in given.collect()}
    got = {r.page_id: len(r.tables) for r in corpus.web_pages(given).collect()}
    plain = {p: len([t for t in re.findall(r"(?s)<table.*?(?:</table>|$)", h) if re.search(r"<t[dh][^>]*>\s*[^<\s]", t)]) for p, h in html.items()}
    assert got == plain


def test_elements_are_numbered_and_described(read):
    rows = corpus.web_elements(read).where("document_id = '1'").orderBy("kind").collect()
    assert [(r.kind, r.n) for r in rows] == [("image", 1), ("table", 1)]
    assert rows[1].description.startswith("Sales 2024. Table with 1 rows")
