"""What SQL can call once `register` has been called for a session.

`tokenize(text)`, `keywords(text)`, `split_sentences(text)` and `units(text)` are SQL functions, so the optimiser sees through them.
`chunk_text` is a table function over pages with their units:

    SELECT * FROM chunk_text(TABLE(SELECT document_id, page, units(text) AS units FROM pages)
                             PARTITION BY document_id ORDER BY (page), 1200, 150)

Its rows are those of `recursive_chunks`, with `number`, the chunk's place in its document.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from scrivia.functions import text as T
from scrivia.operators.chunking import pack_units


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _stripped(text: str) -> str:
    return f"regexp_replace({text}, {_literal(r'(?U)^\s+|\s+$')}, '')"


def _sentences(text: str) -> str:
    return f"filter(transform(split({text}, {_literal(T.SENTENCE_END)}), s -> {_stripped('s')}), s -> s <> '')"


_STOP = ", ".join(map(_literal, T.STOPWORDS))
TOKENS = f"""transform(filter(regexp_extract_all(lower(text), {_literal(T.TOKEN)}, 0), w -> w NOT IN ({_STOP})),
  w -> CASE WHEN length(w) > 4 AND endswith(w, 'ies') THEN concat(substr(w, 1, length(w) - 3), 'y')
            WHEN length(w) > 3 AND endswith(w, 's') AND NOT endswith(w, 'ss') THEN substr(w, 1, length(w) - 1) ELSE w END)"""
FUNCTIONS = {
    "tokenize": TOKENS,
    "keywords": f"filter({TOKENS}, k -> length(k) > 1)",
    "split_sentences": _sentences("text"),
    "units": f"""flatten(transform(
  filter(transform(split(text, {_literal(r'(?U)\n\s*\n')}), b -> {_stripped('b')}), b -> b <> ''),
  b -> CASE WHEN startswith(b, '|') OR startswith(b, '#') OR length(b) <= 400 THEN array(b) ELSE {_sentences('b')} END))""",
}


class ChunkText:
    """One document's pages, in the order that the call gives."""

    def __init__(self) -> None:
        self.number = 0

    def eval(self, page: Row, size: int, overlap: int) -> Iterator[tuple]:
        for seq, text in enumerate(pack_units(page["units"] or [], size, overlap)):
            yield str(page["document_id"]), page["page"], seq, self.number, text
            self.number += 1


def register(spark: SparkSession) -> None:
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING) RETURNS ARRAY<STRING> RETURN {body}")
    table_function = udtf(ChunkText, returnType="document_id string, page int, seq int, number int, text string")
    spark.udtf.register("chunk_text", table_function)
