"""Sources: files, text, delimited rows, web pages, golden sets, vectors."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivia.functions import text as T
from scrivia.operators.chunking import cut_sections, sections

# Fixed values of the row blocks.
ROWS_PER_BLOCK, ROWS_PER_PAGE, TEXT_ROWS, MAX_ROWS = 40, 400, 400, 2001
# Elements that pages are read without, and those that make a block.
DROPPED = {"script", "style", "noscript", "nav", "footer", "header", "form", "svg"}
HEADINGS = {"h1": "# ", "h2": "## ", "h3": "### ", "h4": "#### "}
BLOCKS = {"p", "pre", "blockquote", "figcaption", "li", *HEADINGS}
VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """path, length, name of supported files below `path`, without hidden path parts."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    named = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    return named.where(T.file_kind(F.col("name")).isNotNull() & ~F.col("path").rlike(r"/\.[^/]")).orderBy("path")


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """document_id, title, page, text of whole text files, cut into sections."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("document_id"), T.tidy(F.col("value")).alias("text"))
    stem = F.regexp_replace("document_id", r"\.[^.]*$", "")
    return sections(files.withColumn("title", F.coalesce(T.first_heading(F.col("text")), stem)))


def row_blocks(rows: DataFrame, name: str, columns: list[str], order: str) -> DataFrame:
    """The first MAX_ROWS - 1 rows as markdown tables of ROWS_PER_BLOCK rows with the header: block, page, caption,
    markdown. Each partition keeps its first rows only, so that no more than these are numbered in one task."""
    cells = F.array(*[F.col(c).cast("string") for c in columns])
    first_rows = rows.orderBy(order).limit(MAX_ROWS - 1)
    numbered = first_rows.select(cells.alias("cells"), F.row_number().over(Window.orderBy(order)).alias("n"))
    blocks = numbered.groupBy(F.floor((F.col("n") - 1) / ROWS_PER_BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("n", "cells"))).alias("_r"))
    header = F.array(*[F.lit(c) for c in columns])
    first = F.col("block") * ROWS_PER_BLOCK + 1
    return blocks.select(
        "block", (F.floor(first / ROWS_PER_PAGE) + 1).cast("int").alias("page"),
        F.concat(F.lit(f"{name} rows "), first.cast("string"), F.lit("-"), (first + F.size("_r") - 1).cast("string")).alias("caption"),
        T.rows_to_markdown(F.concat(F.array(header), F.transform("_r", lambda r: r["cells"]))).alias("markdown"),
    )


def row_text(rows: DataFrame, name: str, columns: list[str], order: str) -> DataFrame:
    """The page text of a delimited file: its name as a heading, and a markdown table of its first TEXT_ROWS rows."""
    cells = F.array(*[F.col(c).cast("string") for c in columns])
    first_rows = rows.orderBy(order).limit(TEXT_ROWS).select(F.struct(F.col(order).alias("o"), cells.alias("cells")).alias("r"))
    header = F.array(F.array(*[F.lit(c) for c in columns]))
    body = F.transform(F.sort_array(F.collect_list("r")), lambda r: r["cells"])  # TEXT_ROWS at most
    return first_rows.agg(F.concat(F.lit(f"# {name}\n\n"), T.rows_to_markdown(F.concat(header, body))).alias("text")).select(F.lit(name).alias("document_id"), F.lit(1).alias("page"), "text")


def _squeezed(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def _markdown(rows: list[list[str]]) -> str:
    """What `rows_to_markdown` of the text functions gives, for the parser's tasks."""
    cells = [[c.replace("|", "\\|") for c in row] for row in rows if any(row)]
    width = max(map(len, cells), default=0)
    lines = ["| " + " | ".join(row + [""] * (width - len(row))) + " |" for row in cells]
    return "\n".join([lines[0], "|" + "---|" * width, *lines[1:]]) if lines else ""


class _Table:
    """An open table: its place among the page's blocks, and what it holds so far."""

    def __init__(self, place: int):
        self.place, self.rows, self.cell, self.caption, self.in_caption = place, [], None, [], False

    def end_cell(self):
        if self.cell is not None:
            self.rows[-1].append(_squeezed(self.cell))
        self.cell = None

    def start(self, tag: str):
        if tag in ("caption", "tr", "td", "th"):
            self.in_caption = tag == "caption"
        if tag == "tr" or (tag in ("td", "th") and not self.rows):
            self.end_cell()
            self.rows.append([])
        if tag in ("td", "th"):
            self.end_cell()
            self.cell = []

    def end(self, tag: str):
        if tag == "caption":
            self.in_caption = False
        elif tag in ("td", "th", "tr"):
            self.end_cell()

    def data(self, data: str):
        if self.in_caption:
            self.caption.append(data)
        elif self.cell is not None:
            self.cell.append(data)


class _Page(HTMLParser):
    """Blocks of one page in order, with its tables among them, and the places of its images; an open block ends where the
    next begins. A table inside a cell is a table of its own behind the outer one, whose cell has its words too."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.blocks, self.tables, self.images = "", [], [], []
        self.skip, self.open, self.buffer, self.in_title, self.nested, self.waiting = [], None, [], False, [], []

    def _end_block(self):
        words = _squeezed(self.buffer)
        if self.open and words:
            self.blocks.append(HEADINGS.get(self.open, "- " if self.open == "li" else "") + words)
        self.open, self.buffer = None, []
        self.images += [(len(self.blocks), alt) for alt in self.waiting]  # an image stands behind the block it is in
        self.waiting = []

    def _end_table(self):
        table = self.nested.pop()
        table.end_cell()
        self.blocks[table.place] = _markdown(table.rows)
        self.tables.append(table)

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.skip.append(tag)
        elif self.skip:
            return
        elif tag == "title":
            self.in_title = True
        elif tag == "img" and (alt := dict(attrs).get("alt")):
            self.waiting.append(alt)
            if not self.open:
                self._end_block()
        elif tag == "table":
            self._end_block()
            self.nested.append(_Table(len(self.blocks)))
            self.blocks.append("")
        elif self.nested:
            self.nested[-1].start(tag)
            for table in self.nested:
                table.data(" ")
        elif tag in BLOCKS:
            self._end_block()
            self.open = tag
        elif tag == "br" and self.open:
            self.buffer.append(" ")

    def handle_endtag(self, tag):
        if self.skip and tag == self.skip[-1]:
            self.skip.pop()
        elif self.skip:
            return
        elif tag == "title":
            self.in_title = False
        elif tag == "table" and self.nested:
            self._end_table()
        elif self.nested:
            self.nested[-1].end(tag)
        elif tag in BLOCKS and self.open:
            self._end_block()

    def handle_data(self, data):
        if self.skip:
            return
        if self.in_title:
            self.title += data
        elif self.nested:
            for table in self.nested:
                table.data(data)
        elif self.open:
            self.buffer.append(data)

    def finished(self) -> tuple:
        """title, text, tables, images, sections, elements; called once, at the end of the page."""
        self.close()
        self._end_block()
        while self.nested:
            self._end_table()
        starts = [0, *accumulate(len(b) + 2 if b else 0 for b in self.blocks)]
        text = "\n\n".join(filter(None, self.blocks))
        cut = cut_sections(text)
        ends = list(accumulate(len(s) + 1 for s in cut))
        section = lambda offset: min(bisect_right(ends, offset), len(cut) - 1) + 1
        tables = sorted((t for t in self.tables if self.blocks[t.place]), key=lambda t: t.place)
        elements = [("table", starts[t.place], section(starts[t.place]), _squeezed(t.caption), self.blocks[t.place]) for t in tables]
        elements += [("image", starts[place], section(starts[place]), alt, None) for place, alt in self.images]
        return self.title.strip(), text, [t.rows for t in tables], [alt for _, alt in self.images], cut, elements


ELEMENT = "kind string, at long, section int, caption string, markdown string"
WEB_PAGE = (
    "page_id long, title string, text string, tables array<array<array<string>>>, images array<string>, "
    f"sections array<string>, elements array<struct<{', '.join(c.replace(' ', ': ') for c in ELEMENT.split(', '))}>>"
)


def web_pages(pages: DataFrame) -> DataFrame:
    """page_id, title, text, tables (rows of cells), images (alternative texts), sections and elements of pages (page_id,
    html). The text has tables as markdown in their places; an element is a table or image with its place in the text (at),
    the section that holds it, its caption, and a table's markdown. A page is read in one pass of one task, so elements meet
    their sections without a join. A null or empty page has an empty text and one empty section."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for html in batch.column("html").to_pylist():
                page = _Page()
                page.feed(html or "")
                found.append(page.finished())
            columns = list(zip(*found)) if found else [[]] * (len(out) - 1)
            elements = [[dict(zip(names, e)) for e in of_page] for of_page in columns[-1]]
            arrays = [pa.array(c, f.type) for c, f in zip([*columns[:-1], elements], list(out)[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), *arrays], schema=out)

    element = pa.struct([("kind", pa.string()), ("at", pa.int64()), ("section", pa.int32()), ("caption", pa.string()), ("markdown", pa.string())])
    strings = pa.list_(pa.string())
    names = [f.name for f in element]
    out = pa.schema(
        [("page_id", pa.int64()), ("title", pa.string()), ("text", pa.string()), ("tables", pa.list_(pa.list_(strings))),
         ("images", strings), ("sections", strings), ("elements", pa.list_(element))]
    )
    return pages.select("page_id", "html").mapInArrow(read, WEB_PAGE)


def web_sections(read: DataFrame) -> DataFrame:
    """document_id, title, page, text: the sections of read pages as rows."""
    placed = read.select(F.col("page_id").cast("string").alias("document_id"), "title", F.posexplode("sections").alias("_i", "text"))
    return placed.select("document_id", "title", (F.col("_i") + 1).alias("page"), "text")


def web_elements(read: DataFrame) -> DataFrame:
    """document_id, n (from 1 within the page and kind), kind, at, page, caption, markdown, and the description that a table
    is found by: the tables and images of read pages as rows."""

    def numbered(kind: str) -> Column:
        return F.transform(F.filter("elements", lambda e: e["kind"] == kind), lambda e, i: F.struct((i + 1).alias("n"), e.alias("e")))

    both = F.concat(numbered("table"), numbered("image"))
    rows = read.select(F.col("page_id").cast("string").alias("document_id"), F.explode(both).alias("r"))
    rows = rows.select("document_id", "r.n", "r.e.*").withColumnRenamed("section", "page")
    described = F.when(F.col("kind") == "table", T.describe_table(F.col("markdown"), F.col("caption")))
    return rows.select("document_id", "n", "kind", "at", "page", "caption", "markdown", described.alias("description"))


GOLDEN = "question string, reference_answer string, expected_document string, expected_page int, tag string"


def golden_set(spark: SparkSession, path: str, lines: bool) -> tuple[DataFrame, DataFrame]:
    """Items of a JSON array or of JSON lines that are fit, and those that are not."""
    raw = spark.read.schema(GOLDEN).option("multiLine", str(not lines).lower()).json(path)
    n = F.length(T.strip(F.coalesce("question", F.lit(""))))
    fit = n.between(3, 1000) & (F.length(F.coalesce("reference_answer", F.lit(""))) <= 2000) & (F.coalesce("expected_page", F.lit(1)) >= 1)
    return raw.where(fit), raw.where(~fit)


def vectors(df: DataFrame, dim: int) -> DataFrame:
    """The rows; a vector of another dimension stops the job."""
    return df.where(F.assert_true(F.size("embedding") == dim, F.lit(f"vectors must have {dim} components")).isNull())
