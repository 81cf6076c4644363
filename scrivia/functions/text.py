"""Text functions as columns: tokens, sentences, tables, entities, citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that tokens leave out.
STOPWORDS = (
    "a an and are as at be but by for from has have in is it its of on or that the this to was were will with what "
    "which who whom how why when where do does did can could should would there their they them these those than then "
    "so if into about over under not no yes i you he she we our your his her my me us been being also any all such may "
    "might must shall"
).split()
# Patterns and limits.
TOKEN = r"[a-z0-9]+(?:[.'][a-z0-9]+)*"
SENTENCE_END = r"(?U)(?<=[.!?])\s+(?=[\"'(\[]?[A-Z0-9])|\n+"
PROPER = (
    r"(?U)\b(?:[A-Z][a-zA-Z0-9&\-]+(?:\s+(?:of\s+|for\s+|de\s+)?[A-Z][a-zA-Z0-9&\-]+)*|[A-Z]{2,}[0-9]*)\b"
)
REFERENTIAL = r"(?i)\b(it|its|they|them|their|this|that|these|those|he|she|his|her|there|same|above)\b"
CAPTION = r"(?i)^\s*(fig(ure)?\.?|table|chart|exhibit|diagram|graph|plate)\s*[\dA-Z]"
TABLE_TEXT_LIMIT = 8000
PUBLIC_TEXT_LIMIT = 1600
PARENT_WINDOW = 3200
MAX_ENTITIES = 8
SUFFIX_KINDS = {
    "pdf": "pdf", "docx": "docx", "pptx": "pptx", "md": "text", "markdown": "text", "txt": "text", "csv": "table",
    "html": "web", "htm": "web", "epub": "pdf", "png": "image", "jpg": "image", "jpeg": "image", "webp": "image",
}


def strip(text: Column) -> Column:
    """Without white space at either end (F.trim drops spaces alone)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tokenize(text: Column, stopwords: bool = False) -> Column:
    """Lower-case words, without stop words, plural endings folded."""
    words = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    if not stopwords:
        words = F.filter(words, lambda w: ~w.isin(STOPWORDS))
    return F.transform(
        words,
        lambda w: F.when((F.length(w) > 4) & w.endswith("ies"), F.concat(F.substr(w, F.lit(1), F.length(w) - 3), F.lit("y")))
        .when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.substr(w, F.lit(1), F.length(w) - 1))
        .otherwise(w),
    )


def keywords(text: Column) -> Column:
    return F.filter(tokenize(text), lambda w: F.length(w) > 1)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_END), strip), lambda s: s != "")


def units(text: Column) -> Column:
    """Paragraphs; a long one that is no table or heading comes as its sentences."""
    blocks = F.filter(F.transform(F.split(text, r"(?U)\n\s*\n"), strip), lambda b: b != "")
    whole = lambda b: b.startswith("|") | b.startswith("#") | (F.length(b) <= 400)
    return F.flatten(F.transform(blocks, lambda b: F.when(whole(b), F.array(b)).otherwise(sentences(b))))


def tidy(text: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(text, "[­\r]", ""), r"[ \t]+\n", "\n")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def first_heading(text: Column) -> Column:
    """The text behind the first `# `, or null."""
    return F.nullif(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1), F.lit(""))


def is_caption(text: Column) -> Column:
    return text.rlike(CAPTION)


def table_cell(value: Column) -> Column:
    return strip(F.replace(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)\s+", " "), F.lit("|"), F.lit("\\|")))


def rows_to_markdown(rows: Column) -> Column:
    """array<array<string>> as a pipe table: blank rows go, short rows are padded, the first row is the header."""
    cells = F.filter(F.transform(rows, lambda r: F.transform(r, table_cell)), lambda r: F.exists(r, lambda c: c != ""))
    sized = let(cells, lambda c: F.struct(c.alias("rows"), F.array_max(F.transform(c, F.size)).alias("width")))
    line = lambda width: lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = lambda width: F.concat(F.lit("|"), F.repeat(F.lit("---|"), width))
    below = lambda c: F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))
    lines = lambda c, w: F.concat(F.transform(F.slice(c, 1, 1), line(w)), F.array(rule(w)), F.transform(below(c), line(w)))
    return let(sized, lambda t: F.when(F.size(t["rows"]) == 0, F.lit("")).otherwise(F.array_join(lines(t["rows"], t["width"]), "\n")))


def pipe_tables(text: Column) -> Column:
    """Runs of lines between pipes that have a rule of dashes."""
    runs = F.regexp_extract_all(text, F.lit(r"(?m)(?:^[ \t]*\|.*\|[ \t]*$\n?){2,}"), F.lit(0))
    return F.filter(F.transform(runs, strip), lambda t: t.rlike(r"(?m)^\s*\|[\s:|]*-+"))


def describe_table(markdown: Column, caption: Column) -> Column:
    names = lambda lines: F.filter(F.transform(F.split(F.regexp_replace(F.element_at(lines, 1), r"^\|+|\|+$", ""), r"\|"), strip), lambda c: c != "")
    lead = F.when(F.coalesce(caption, F.lit("")) != "", F.concat(caption, F.lit(". "))).otherwise("")
    rows = lambda lines: F.greatest(F.size(lines) - 2, F.lit(0)).cast("string")
    said = lambda lines: F.concat(lead, F.lit("Table with "), rows(lines), F.lit(" rows and columns: "), F.array_join(F.slice(names(lines), 1, 12), ", "), F.lit("."))
    return let(F.split(markdown, "\n"), said)


def describe_figure(kind: Column, page: Column, caption: Column, context: Column) -> Column:
    what = F.when(kind == "scan", "Scanned page").otherwise("Figure")
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.concat_ws(
        " ",
        F.concat(what, F.lit(" on page "), page.cast("string"), F.lit(".")),
        F.when(given(caption), F.concat(F.regexp_replace(caption, r"\.+$", ""), F.lit("."))),
        F.when(given(context), F.concat(F.lit("Nearby text: "), F.substring(context, 1, 400))),
    )


def table_chunk_text(description: Column, markdown: Column) -> Column:
    cut = F.when(F.length(markdown) > TABLE_TEXT_LIMIT, F.concat(F.substring(markdown, 1, TABLE_TEXT_LIMIT), F.lit("\n…"))).otherwise(markdown)
    return F.concat(description, F.lit("\n\n"), cut)


def normalize_entity(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(text)), r"(?U)\s+", " "), r"^(the|a|an)\s+", "")


def proper_phrases(text: Column) -> Column:
    """Normalised capitalised phrases and acronyms in the order of the text, repeats included."""
    found = F.filter(
        F.transform(F.regexp_extract_all(text, F.lit(PROPER), F.lit(0)), strip),
        lambda p: (F.length(p) >= 3) & ~F.lower(p).isin(STOPWORDS),
    )
    return F.transform(found, normalize_entity)


def let(value: Column, body) -> Column:
    """`body` of a value that is worked out once, however often it stands in the body's lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def heuristic_entities(text: Column, limit: int = 8) -> Column:
    """The different phrases of a text that look like names, the most frequent first, then by their place.

    Phrases are sorted, so that equal ones are runs; a run's length is their number, and its first their first place.
    """
    placed = lambda found: F.array_sort(F.transform(found, lambda e, i: F.struct(e.alias("e"), i.alias("i"))))
    begins = lambda s: F.filter(
        F.transform(s, lambda x, k: F.when((k == 0) | (F.get(s, k - 1)["e"] != x["e"]), k)), lambda k: k.isNotNull()
    )
    run = lambda s, starts: lambda k, j: F.struct(
        (k - F.coalesce(F.get(starts, j + 1), F.size(s))).alias("n"), F.get(s, k)["i"].alias("i"), F.get(s, k)["e"].alias("e")
    )
    counted = let(placed(proper_phrases(text)), lambda s: let(begins(s), lambda starts: F.array_sort(F.transform(starts, run(s, starts)))))
    return F.transform(F.slice(counted, 1, limit), lambda x: x["e"])


def citations(text: Column) -> Column:
    """Sorted distinct numbers of `[n]`."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[(\d{1,2})\]"), F.lit(1)).cast("array<int>")))


def link_citations(text: Column, n_sources: Column) -> Column:
    """`[n]` becomes `[n](#cite-n)` for n up to n_sources, outside code spans and existing links."""
    parts = F.regexp_extract_all(text, F.lit(r"`[^`]*`|[^`]+|`"), F.lit(0))

    def linked(part: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.greatest(n_sources, F.lit(1))),
            part,
            lambda t, n: F.when(n <= n_sources, F.regexp_replace(t, F.concat(F.lit(r"\["), n.cast("string"), F.lit(r"\](?!\()")), F.concat(F.lit("["), n.cast("string"), F.lit("](#cite-"), n.cast("string"), F.lit(")")))).otherwise(t),
        )

    return F.array_join(F.transform(parts, lambda p: F.when(p.startswith("`"), p).otherwise(linked(p))), "")


def plain_preview(markdown: Column) -> Column:
    """Markdown as plain text on one line."""
    text = markdown
    for pattern, put in (
        (r"```[^`]*```", " "),
        (r"(?m)^\s*\|?\s*:?-{3,}.*$", " "),
        (r"(?m)^#{1,6}\s*", ""),
        (r"(?m)^\s*[-*+]\s+", ""),
        (r"!?\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"[*_`]+", ""),
        (r"\|", " "),
        (r"(?U)\s+", " "),
    ):
        text = F.regexp_replace(text, pattern, put)
    return strip(text)


def approx_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def slug(name: Column, default: str = "collection") -> Column:
    base = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    base = F.substring(base, 1, 40)
    return F.when(base == "", default).otherwise(base)


def lenient_json(text: Column, schema: str) -> Column:
    """A struct from text that holds JSON, fenced or among other words; null if there is none."""
    bare = strip(F.regexp_replace(F.regexp_replace(strip(text), r"^```[a-zA-Z]*\s*", ""), r"```$", ""))
    block = F.regexp_extract(bare, r"(?s)(\{.*\}|\[.*\])", 1)
    parse = lambda t: F.when(F.try_parse_json(t).isNotNull(), F.from_json(t, schema))
    return F.coalesce(parse(bare), parse(block))


def safe_filename(name: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9._ -]+", "_"), "^[ .]+|[ .]+$", "")
    suffix = F.lower(F.regexp_extract(clean, r"(\.[^.]*)$", 1))
    stem = F.substring(F.substr(clean, F.lit(1), F.length(clean) - F.length(suffix)), 1, 120)
    return F.when(stem == "", F.concat(F.lit("file"), suffix)).otherwise(F.concat(stem, suffix))


def file_kind(name: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for pair in SUFFIX_KINDS.items() for x in pair])
    return kinds[F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))]


def embedding_input(title: Column, unit: Column, page: Column, chunk_title: Column, text: Column) -> Column:
    head = F.concat_ws(" | ", title, F.concat_ws(" ", unit, page.cast("string")), F.nullif(chunk_title, F.lit("")))
    return F.concat(head, F.lit("\n"), text)


def excerpt(page_text: Column, chunk_text: Column) -> Column:
    """A window of the page around the chunk; the whole page if it is short."""
    at = F.greatest(F.position(F.substring(chunk_text, 1, 80), page_text) - 1, F.lit(0))
    start = F.greatest(at - PARENT_WINDOW // 3, F.lit(0))
    end = start + PARENT_WINDOW
    window = F.concat(
        F.when(start > 0, "… ").otherwise(""),
        F.substr(page_text, start + 1, F.lit(PARENT_WINDOW)),
        F.when(end < F.length(page_text), " …").otherwise(""),
    )
    return F.when(F.length(page_text) <= PARENT_WINDOW, page_text).otherwise(window)


def source_label(filename: Column, page: Column, modality: Column, url: Column | None = None) -> Column:
    label = F.concat(filename, F.lit(" p."), page.cast("string"), F.lit(" ("), modality, F.lit(")"))
    return label if url is None else F.when(url.isNotNull(), F.concat(F.lit("web: "), url)).otherwise(label)


def public_text(text: Column) -> tuple[Column, Column]:
    """The text as shown, and whether it was cut."""
    return F.substring(text, 1, PUBLIC_TEXT_LIMIT), F.length(text) > PUBLIC_TEXT_LIMIT


def clamp_score(score: Column) -> Column:
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3)


def l2_normalize(vector: Column) -> Column:
    """Unit length; a zero vector stays. The norm is carried through the fold, as a lambda would compute it anew for
    every component."""
    with_norm = F.struct(vector.alias("v"), F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x)).alias("n"))
    return F.element_at(
        F.transform(F.array(with_norm), lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: x / s["n"])).otherwise(s["v"])), 1
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
