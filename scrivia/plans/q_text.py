"""Queries over the text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scrivia.functions import text as T
from scrivia.plans.fixtures import SQL_CHUNKS, chunks, sql_keywords, sql_sentences, sql_tokens, table


def documents(spark, sf):
    return table(spark, sf, "documents")


def tokenize(spark, sf):
    d = documents(spark, sf)
    return d.select("doc_id", F.array_join(T.tokenize(F.col("text")), " ").alias("tokens"), F.size(T.keywords(F.col("text"))).cast("long").alias("n_keywords"))


def sentences(spark, sf):
    return documents(spark, sf).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("seq", "sentence"))


def units(spark, sf):
    found = T.units(F.col("text"))
    return documents(spark, sf).select("doc_id", F.size(found).cast("long").alias("n_units"), F.element_at(found, 1).alias("first_unit"))


def tidy(spark, sf):
    padded = F.concat(F.replace(F.col("text"), F.lit("\n"), F.lit("  \r\n\n\n")), F.lit("\n\n"))
    return documents(spark, sf).select("doc_id", F.md5(T.tidy(padded).cast("binary")).alias("tidy_md5"))


def headings(spark, sf):
    made = F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("source"), F.lit("\n# Title of "), F.col("source"), F.lit("\n"), F.col("text"))).otherwise(F.col("text"))
    name = F.concat(F.lit("file_"), F.col("doc_id").cast("string"))
    return documents(spark, sf).select("doc_id", F.coalesce(T.first_heading(made), name).alias("title"))


def captions(spark, sf):
    s = documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    made = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Fig. "), F.col("line").cast("string"), F.lit(" "), F.col("t"))).otherwise(F.col("t"))
    return s.select("doc_id", "line", T.is_caption(made).alias("is_caption"))


def markdown_rows(spark, sf):
    n = table(spark, sf, "part")
    cells = F.array(F.col("p_partkey").cast("string"), F.concat(F.col("p_name"), F.lit(" |  x")), F.when(F.col("p_size") % 2 == 0, F.col("p_type")))
    rows = F.array(F.array(F.lit("key"), F.lit("name"), F.lit("type"), F.lit("none")), F.array(F.lit(""), F.lit(None).cast("string")), cells)
    made = n.select("p_partkey", "p_brand", T.rows_to_markdown(rows).alias("markdown"))
    return made.select("p_partkey", "markdown", T.describe_table(F.col("markdown"), F.col("p_brand")).alias("description"))


def figures(spark, sf):
    d = documents(spark, sf)
    kind = F.when(F.col("doc_id") % 2 == 0, "scan").otherwise("raster")
    caption = F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("source"), F.lit("..")))
    return d.select("doc_id", T.describe_figure(kind, F.col("doc_id") % 9 + 1, caption, F.col("text")).alias("description"))


def table_chunks(spark, sf):
    d = documents(spark, sf)
    return d.select("doc_id", F.md5(T.table_chunk_text(F.col("source"), F.col("text")).cast("binary")).alias("text_md5"))


def entities(spark, sf):
    """The most frequent capitalised phrases of every document, ties by first place."""
    found = documents(spark, sf).select("doc_id", F.posexplode(T.proper_phrases(F.col("text"))).alias("pos", "entity"))
    ranked = found.groupBy("doc_id", "entity").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    top = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "first"))
    return ranked.withColumn("rank", top).where(F.col("rank") <= T.MAX_ENTITIES).select("doc_id", "entity", "n", "rank")


def cited(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    made = F.concat(F.col("text"), F.lit(" ["), (F.col("turn") % 12).cast("string"), F.lit("] and [3][140]"))
    found = T.citations(made)
    return c.select("conv_id", "turn", F.array_join(found.cast("array<string>"), ",").alias("cited"), F.array_contains(found, 3).alias("cites_three"))


def linked(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    made = F.concat(F.lit("see [1] and `[2]` or [2](x) [9] "), F.col("text"))
    return c.select("conv_id", "turn", T.link_citations(made, F.lit(3)).alias("linked"), T.plain_preview(F.concat(F.lit("# Head\n- *item* [a](b)\n"), F.col("text"))).alias("preview"))


def scalar_misc(spark, sf):
    d = documents(spark, sf)
    name = F.concat(F.lit("./"), F.col("source"), F.lit(" ü#"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".PDF").otherwise(".exe"))
    shown, cut = T.public_text(F.col("text"))
    return d.select(
        "doc_id", T.approx_tokens(F.col("text")).alias("approx_tokens"), T.slug(F.concat(F.lit("Ünder "), F.col("source"), F.lit("!"))).alias("slug"),
        T.safe_filename(name).alias("safe_name"), T.file_kind(name).alias("kind"), F.md5(shown.cast("binary")).alias("shown_md5"), cut.alias("truncated"),
        T.source_label(F.col("source"), F.col("doc_id") % 9, F.lit("text")).alias("label"), T.normalize_entity(F.concat(F.lit(" The  "), F.col("source"))).alias("entity"),
        T.clamp_score(F.col("doc_id") / 700.0).alias("score"),
    )


def excerpts(spark, sf):
    """Page windows around a passage of the text."""
    d = documents(spark, sf)
    at = (F.length("text") / 2).cast("int") + 1
    return d.select("doc_id", F.md5(T.excerpt(F.col("text"), F.substr("text", at, F.lit(500))).cast("binary")).alias("excerpt_md5"))


def embedding_inputs(spark, sf):
    c = chunks(spark, sf)
    title = F.when(F.col("doc_id") % 2 == 0, F.col("collection_id")).otherwise(F.lit(""))
    made = T.embedding_input(F.col("filename"), F.lit("page"), F.col("page"), title, F.col("text"))
    return c.select("chunk_id", F.md5(made.cast("binary")).alias("input_md5"), F.length(made).cast("long").alias("n_chars"))


def json_repair(spark, sf):
    e = table(spark, sf, "events")
    made = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Sure: "), F.col("props"), F.lit(" done"))).otherwise(F.lit("nothing"))
    return e.select("event_id", T.lenient_json(made, "k long").k.alias("k"))


def normalized_vectors(spark, sf):
    v = table(spark, sf, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double") * 3))
    return v.select("vec_id", F.round(T.dot(T.l2_normalize(F.col("v")), T.l2_normalize(F.col("v"))), 6).alias("norm"), F.round(F.element_at(T.l2_normalize(F.col("v")), 1), 5).alias("first"))


_WS = "' ' || chr(9) || chr(10) || chr(13)"
PROPER_SQL = r"\b(?:[A-Z][a-zA-Z0-9&\-]+(?:\s+(?:of\s+|for\s+|de\s+)?[A-Z][a-zA-Z0-9&\-]+)*|[A-Z]{2,}[0-9]*)\b"
STOP_SQL = ", ".join(f"'{w}'" for w in T.STOPWORDS)

QUERIES = {
    "t01_tokenize": (tokenize, f"SELECT doc_id, array_to_string({sql_tokens('text')}, ' ') AS tokens, len({sql_keywords('text')}) AS n_keywords FROM documents"),
    "t03_sentences": (sentences, f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS seq, s[i] AS sentence FROM (SELECT doc_id, {sql_sentences('text')} AS s FROM documents), LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i) t"),
    "t04_units": (
        units,
        f"""WITH b AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '\\n\\s*\\n', chr(2), 'g'), chr(2)), lambda x: trim(x, {_WS})), lambda x: x <> '') AS bs FROM documents),
        u AS (SELECT doc_id, flatten(list_transform(bs, lambda b: CASE WHEN b LIKE '|%' OR b LIKE '#%' OR length(b) <= 400 THEN [b] ELSE {sql_sentences('b')} END)) AS us FROM b)
        SELECT doc_id, len(us) AS n_units, us[1] AS first_unit FROM u""",
    ),
    "t06_tidy": (
        tidy,
        f"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(replace(text, chr(10), '  ' || chr(13) || chr(10) || chr(10) || chr(10)) || chr(10) || chr(10), chr(13), ''), '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), {_WS})) AS tidy_md5 FROM documents""",
    ),
    "t10_headings": (
        headings,
        """SELECT doc_id, coalesce(nullif(regexp_extract(CASE WHEN doc_id % 3 = 0 THEN source || chr(10) || '# Title of ' || source || chr(10) || text ELSE text END, '(?m)^#\\s+(.+)$', 1), ''), 'file_' || doc_id) AS title FROM documents""",
    ),
    "t11_captions": (
        captions,
        f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)
        SELECT doc_id, CAST(i - 1 AS INTEGER) AS line, regexp_matches(CASE WHEN doc_id % 4 = 0 THEN 'Fig. ' || (i - 1) || ' ' || ls[i] ELSE ls[i] END, '{T.CAPTION}') AS is_caption
        FROM l, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i) t""",
    ),
    "t08_t12_markdown_tables": (
        markdown_rows,
        r"""WITH c AS (SELECT *, trim(replace(regexp_replace(p_name || ' |  x', '\s+', ' ', 'g'), '|', '\|')) AS n2, CASE WHEN p_size % 2 = 0 THEN trim(regexp_replace(p_type, '\s+', ' ', 'g')) ELSE '' END AS t2 FROM part),
        m AS (SELECT p_partkey, p_brand, '| key | name | type | none |' || chr(10) || '|---|---|---|---|' || chr(10) || '| ' || p_partkey || ' | ' || n2 || ' | ' || t2 || ' |  |' AS markdown FROM c)
        SELECT p_partkey, markdown, p_brand || '. Table with 1 rows and columns: key, name, type, none.' AS description FROM m""",
    ),
    "t13_figures": (
        figures,
        """SELECT doc_id, (CASE WHEN doc_id % 2 = 0 THEN 'Scanned page' ELSE 'Figure' END) || ' on page ' || (doc_id % 9 + 1) || '.' || CASE WHEN doc_id % 3 = 0 THEN ' ' || source || '.' ELSE '' END
        || CASE WHEN text <> '' THEN ' Nearby text: ' || substr(text, 1, 400) ELSE '' END AS description FROM documents""",
    ),
    "t27_table_chunks": (table_chunks, "SELECT doc_id, md5(source || chr(10) || chr(10) || CASE WHEN length(text) > 8000 THEN substr(text, 1, 8000) || chr(10) || '…' ELSE text END) AS text_md5 FROM documents"),
    "t14_t15_entities": (
        entities,
        f"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(regexp_replace(text, '[\\x{{80}}-\\x{{10FFFF}}]', '_', 'g'), '{PROPER_SQL}'), lambda x: trim(x)), lambda x: length(x) >= 3 AND lower(x) NOT IN ({STOP_SQL})) AS ps FROM documents),
        e AS (SELECT doc_id, i, regexp_replace(regexp_replace(lower(ps[i]), '\\s+', ' ', 'g'), '^(the|a|an)\\s+', '') AS entity FROM p, LATERAL (SELECT unnest(range(1, len(ps) + 1)) AS i) t),
        g AS (SELECT doc_id, entity, count(*) AS n, min(i) AS f FROM e GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS rank FROM g)
        SELECT doc_id, entity, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8""",
    ),
    "t16_citations": (
        cited,
        """WITH c AS (SELECT conv_id, turn, list_sort(list_distinct(list_transform(regexp_extract_all(text || ' [' || (turn % 12) || '] and [3][140]', '\\[(\\d{1,2})\\]', 1), lambda x: CAST(x AS INTEGER)))) AS f FROM conversations WHERE role = 'assistant')
        SELECT conv_id, turn, array_to_string(f, ',') AS cited, list_contains(f, 3) AS cites_three FROM c""",
    ),
    "t17_t18_links_and_preview": (linked, None),
    "t19_t20_t22_scalars": (
        scalar_misc,
        """WITH n AS (SELECT *, './' || source || ' ü#' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.PDF' ELSE '.exe' END AS name FROM documents),
        c AS (SELECT *, trim(regexp_replace(name, '[^A-Za-z0-9._ -]+', '_', 'g'), ' .') AS clean FROM n)
        SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INTEGER) AS approx_tokens, 'nder-' || regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g') AS slug,
          left(clean[:-5], 120) || lower(clean[-4:]) AS safe_name, CASE WHEN doc_id % 2 = 0 THEN 'pdf' END AS kind, md5(substr(text, 1, 1600)) AS shown_md5, length(text) > 1600 AS truncated,
          source || ' p.' || (doc_id % 9) || ' (text)' AS label, lower(source) AS entity, round_even(greatest(0.0, least(1.0, doc_id / CAST(700.0 AS DOUBLE))), 3) AS score FROM c""",
    ),
    "t28_excerpts": (
        excerpts,
        """WITH c AS (SELECT doc_id, text, substr(substr(text, CAST(floor(length(text) / 2) AS BIGINT) + 1, 500), 1, 80) AS needle FROM documents),
        s AS (SELECT *, greatest(greatest(strpos(text, needle) - 1, 0) - 1066, 0) AS at0 FROM c)
        SELECT doc_id, md5(CASE WHEN length(text) <= 3200 THEN text ELSE (CASE WHEN at0 > 0 THEN '… ' ELSE '' END) || substr(text, at0 + 1, 3200) || (CASE WHEN at0 + 3200 < length(text) THEN ' …' ELSE '' END) END) AS excerpt_md5 FROM s""",
    ),
    "t26_embedding_inputs": (
        embedding_inputs,
        f"""WITH {SQL_CHUNKS}, m AS (SELECT chunk_id, filename || ' | page ' || page || CASE WHEN doc_id % 2 = 0 THEN ' | ' || collection_id ELSE '' END || chr(10) || text AS t FROM chunks)
        SELECT chunk_id, md5(t) AS input_md5, length(t) AS n_chars FROM m""",
    ),
    "t21_lenient_json": (json_repair, "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events"),
    "t25_normalized_vectors": (
        normalized_vectors,
        """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3) AS v FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM v)
        SELECT vec_id, round(list_sum(list_transform(v, lambda x: (x / l) * (x / l))), 6) AS norm, round(v[1] / l, 5) AS "first" FROM n""",
    ),
}
