"""Queries over indexes, retrieval, answers and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scrivia.functions import text as T
from scrivia.operators import answering as A
from scrivia.operators import chunking as C
from scrivia.operators import evaluation as E
from scrivia.operators import index as I
from scrivia.operators import lexical as L
from scrivia.operators import vector_index as V
from scrivia.operators.agent import ask
from scrivia.operators.lineage import written
from scrivia.plans.fixtures import SQL_CHUNKS, chunks, sql_keywords, sql_sentences, sql_tokens, table
from scrivia.plans.q_text import PROPER_SQL, STOP_SQL


def _corpus(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "lang")


def _questions(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def _index(spark, sf):
    """The stored index of the corpus, refreshed where its content has changed."""
    return L.index_of_version(spark, f"documents of {sf}", _corpus(spark, sf))


def bm25(spark, sf):
    return L.bm25(_questions(spark, sf), _index(spark, sf)).select("question_id", "chunk_id", "score")


def refreshed(spark, sf):
    """Rankings and statistics of an index that came about in three segments: every document under another text, then
    the labelled ones as they are and a third of the others gone, then the corpus as it is."""
    corpus = _corpus(spark, sf)
    labelled = table(spark, sf, "labels").select(F.col("doc_id").alias("chunk_id")).distinct()
    index = L.lexical_index(corpus.withColumn("text", F.concat(F.reverse("text"), F.lit(" draft"))))
    gone = corpus.join(labelled, "chunk_id", "left_anti").where(F.crc32(F.col("chunk_id").cast("string").cast("binary")) % 3 == 0)
    index = L.refreshed_index(index, corpus.join(labelled, "chunk_id", "left_semi"), gone)
    index = L.synchronized(index, corpus)
    ranked = L.bm25(_questions(spark, sf), index).select("question_id", "chunk_id", "score")
    return ranked.crossJoin(index.weights.agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings"), F.round(F.first("avg_length"), 6).alias("avg_length")))  # one row


def bm25_filtered(spark, sf):
    """Filters narrow the results; the statistics stay those of the whole corpus."""
    allowed = _corpus(spark, sf).where("lang = 'en'")
    return L.bm25(_questions(spark, sf), _index(spark, sf), 6, allowed=allowed).select("question_id", "chunk_id", "score")


def corpus_statistics(spark, sf):
    return _index(spark, sf).weights.select("term", "df", F.round("idf", 6).alias("idf"), F.round("avg_length", 6).alias("avg_length"))


def expected(spark, sf):
    return I.containing(_questions(spark, sf), _corpus(spark, sf))


def evaluated(spark, sf):
    """Hit and reciprocal rank of every benchmark question in its BM25 ranking."""
    index, items = _index(spark, sf), _questions(spark, sf)
    ranked = L.bm25(items, index).select("question_id", F.col("chunk_id").alias("id"), "rank")
    gold = I.containing_by(index, items, _corpus(spark, sf)).withColumnRenamed("chunk_id", "id")
    return A.first_hits(items, ranked, gold)


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


def dense(spark, sf):
    v = _vectors(spark, sf)
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    return I.dense_top(q, v).select("query_id", "vec_id", F.round("score", 4).alias("score"), "rank")


def _rankings(spark, sf):
    v = _vectors(spark, sf)
    part = lambda a: v.select("vec_id", F.slice("vector", a, 32).alias("vector"))
    ask = lambda p: p.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    named = lambda d, s: d.select("query_id", F.col("vec_id").alias("id"), F.lit(s).alias("source"), "rank")
    a, b = part(1), part(33)
    same = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label").join(v.select("vec_id", "label"), "label")
    graph = I.top(same.select("query_id", "vec_id"), ["query_id"], 24, "vec_id")
    return named(I.dense_top(ask(a), a), "dense").unionByName(named(I.dense_top(ask(b), b), "sparse")).unionByName(named(graph, "graph"))


def fused(spark, sf):
    return I.fuse(_rankings(spark, sf), 12)


def trace(spark, sf):
    """How many rows each source gave, and how many the fusion has."""
    r = _rankings(spark, sf)
    n = lambda s: F.count_if(F.col("source") == s).alias(f"n_{s}")
    return r.groupBy("query_id").agg(n("dense"), n("sparse"), n("graph"), F.countDistinct("id").alias("n_fused"))


def hashed(spark, sf):
    """Norm and filled buckets of the hash embedding of every document."""
    v = I.hash_embedding(_corpus(spark, sf), "chunk_id", "text")
    return v.select("chunk_id", F.round(T.dot(F.col("vector"), F.col("vector")), 6).alias("norm"), F.size(F.filter("vector", lambda x: x != 0)).cast("long").alias("filled"))


def hybrid(spark, sf):
    """Dense (hash embedding) and BM25 rankings of the benchmark questions, fused."""
    items, corpus = _questions(spark, sf), _corpus(spark, sf)
    q = I.hash_embedding(items.select("question_id", F.col("question").alias("text")), "question_id", "text").withColumnRenamed("question_id", "query_id")
    d = I.hash_embedding(corpus, "chunk_id", "text").withColumnRenamed("chunk_id", "vec_id")
    dense_part = I.dense_top(q, d).select("query_id", F.col("vec_id").alias("id"), F.lit("dense").alias("source"), "rank")
    sparse = L.bm25(items, _index(spark, sf)).select(F.col("question_id").alias("query_id"), F.col("chunk_id").alias("id"), F.lit("sparse").alias("source"), "rank")
    return I.fuse(dense_part.unionByName(sparse), 12)


def _edges(spark, sf):
    return I.entity_edges(_corpus(spark, sf))


def entity_edges(spark, sf):
    return _edges(spark, sf).groupBy("entity").agg(F.count("*").alias("n_chunks")).where("n_chunks > 1")


def by_entity(spark, sf):
    return I.entity_hits(_questions(spark, sf), _edges(spark, sf)).select("question_id", "id", "n")


def _contexts(spark, sf, k=6):
    c = chunks(spark, sf).select(F.col("doc_id").alias("chunk_id"), "modality", "text", F.col("filename").alias("title"))
    r = L.bm25(_questions(spark, sf), _index(spark, sf), k)
    return r.join(c, "chunk_id").select("question_id", F.col("chunk_id").alias("id"), F.col("rank").alias("n"), "score", "modality", "text", "title")


def reranked(spark, sf):
    c = _contexts(spark, sf, 24).withColumn("fused", F.col("score")).join(_questions(spark, sf), "question_id")
    return I.rerank(c.select("question_id", "question", "id", "text", "fused")).select("question_id", "id", "rerank")


def external(spark, sf):
    """Scores of another model, joined by document."""
    c = _contexts(spark, sf, 24).withColumn("fused", F.col("score"))
    scores = c.select("question_id", "id").join(table(spark, sf, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") * 0.5 + F.col("toxic")).alias("rerank")), "id")
    return I.external_rerank(c, scores.distinct()).select("question_id", "id", "rerank", "n")


def expanded(spark, sf):
    """Documents of one source stand on one page, the text of the source's first document."""
    whole = table(spark, sf, "documents")
    c = _contexts(spark, sf, 12).join(whole.select(F.col("doc_id").alias("id"), F.col("source").alias("parent_id")), "id")
    pages = whole.groupBy(F.col("source").alias("parent_id")).agg(F.min_by("text", "doc_id").alias("text"))
    e = I.expand_parents(c, pages)
    return e.select("question_id", "id", "n", "modality", F.array_join(F.col("merged_chunks").cast("array<string>"), ",").alias("merged"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def filtered(spark, sf):
    """Tables and images; then those of the documents that a benchmark question stands in."""
    named = expected(spark, sf).select(F.concat(F.lit("doc_"), F.col("chunk_id").cast("string")).alias("document_id"))
    shown = I.filter_rows(I.filter_rows(chunks(spark, sf), ["table", "image"], []), None, named)
    return shown.select("chunk_id", "modality")


def rewritten(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'user'")
    last = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    feedback = F.when(F.col("conv_id") % 3 == 0, "more detail")
    return c.select("conv_id", "turn", A.rewrite(F.col("text"), last, feedback).alias("standalone"))


def graded(spark, sf):
    q = _questions(spark, sf)
    g = A.grade(q, _contexts(spark, sf).select("question_id", "n", "text", "title"))
    return g.withColumn("useful_sources", F.array_join(F.col("useful_sources").cast("array<string>"), ","))


_collections: dict = {}


def _library(spark, sf):
    name = F.concat_ws("_", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return table(spark, sf, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("document_id"), name.alias("filename"), "text")


def _collection(spark, sf):
    """Documents cut into sections, and these into chunks; indexed once for a content of the documents."""
    key, docs = (spark.sparkContext.applicationId, sf), _library(spark, sf)
    version = L.content_version(docs, "document_id")
    if key not in _collections or _collections[key][0] != version:
        _collections[key] = (version, E.rechunked(docs, C.recursive_chunks))
    return _collections[key][1]


def _public(contexts):
    return contexts.select(
        "question_id", "n", "id", "document_id", "page", "modality", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.size("merged_chunks").alias("n_merged"),
        "fused", "dense_rank", "dense_sim", "bm25_rank", "graph", "rerank",
    )


def retrieved(spark, sf):
    """The whole retrieval of every benchmark question, reranked and expanded to pages, with its signals."""
    return _public(I.retrieve(_questions(spark, sf), _collection(spark, sf), I.Options(rerank="lexical"))[0])


def retrieved_simply(spark, sf):
    """The shortlist by rank fusion alone, without reranking or pages."""
    return _public(I.retrieve(_questions(spark, sf), _collection(spark, sf), I.Options(parent_expansion=False))[0])


def retrieval_trace(spark, sf):
    return I.retrieve(_questions(spark, sf), _collection(spark, sf), I.Options(rerank="lexical"))[1]


def agent_rounds(spark, sf):
    """Retrieve, grade, and search again with what is missing, for questions whose evidence does not suffice."""
    out = ask(_questions(spark, sf), _collection(spark, sf), max_retries=1)
    return out.select("question_id", "attempts", "verdict.sufficient", F.length("answer").alias("answer_length"), F.size(F.filter("sources", lambda s: s["cited"])).alias("n_cited"))


def asked(spark, sf):
    """The full record of every first question of a conversation; a turn that refers back takes words from the one before."""
    c = table(spark, sf, "conversations").where("role = 'user'")
    last = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    q = c.select(F.concat_ws(":", "conv_id", "turn").alias("question_id"), F.col("text").alias("question"), last.alias("last_user"))
    out = ask(q, _collection(spark, sf), I.Options(rerank="lexical"), "simple")
    return out.select("question_id", "standalone_question", "answer", "status", "mode", "options.top_k", "verdict.relevant", "verdict.sufficient", F.size("sources").alias("n_sources"), F.size(F.filter("sources", lambda s: s["cited"])).alias("n_cited"), F.col("trace")[0]["candidates"].alias("candidates"), "used_web", "input_tokens", "output_tokens", "cost_usd")


_runs: dict = {}


def _run_results(spark, sf):
    """Two chunkings of the documents as hidden copies, four presets each, over the benchmark questions; once for a
    content of the documents."""
    key, docs = (spark.sparkContext.applicationId, sf), _library(spark, sf)
    version = L.content_version(docs, "document_id")
    if key not in _runs or _runs[key][0] != version:
        items, gold = _questions(spark, sf), expected(spark, sf)
        named = gold.groupBy("question_id").agg(F.collect_set(F.concat(F.lit("doc_"), F.col("chunk_id").cast("string"))).alias("expected"))
        first = F.get(T.sentences(F.col("question")), 0)
        golden = written(items.join(named, "question_id", "left").withColumn("reference_answer", first), "golden")
        _runs[key] = (version, *E.run_rechunked(golden, docs, {"recursive": C.recursive_chunks, "semantic": C.semantic_chunks}, "documents"))
    return _runs[key][1]


def evaluation_cost(spark, sf):
    """What the run cost: its configurations, and the judge's calls, one for each answer that was judged, at a listed price."""
    results = _run_results(spark, sf)
    calls = results.select((F.length("answer") / 4 * F.lit(2.5 / 1_000_000)).alias("cost_usd"))
    return E.run_cost(A.summarize(results), calls)


def evaluation_results(spark, sf):
    return _run_results(spark, sf).select("config", "question_id", "hit", "rr", "faithfulness", "relevance", "correctness", "cost_usd", "failed")


def evaluation_summary(spark, sf):
    """The run's summary; its latency differs from run to run and is left out."""
    return A.summarize(_run_results(spark, sf)).drop("latency_ms")


def evaluation_report(spark, sf):
    return A.report_lines(A.summarize(_run_results(spark, sf)))


def evaluation_best(spark, sf):
    return A.best_values(A.summarize(_run_results(spark, sf)), {"hit": True, "rr": True, "faithfulness": True, "cost_usd": False})


def merged_contexts(spark, sf):
    """Three useful sources of the first round, and what the second found that is not among them, five in all."""
    both = _contexts(spark, sf, 6).select("question_id", "id", "n")
    return A.merge_contexts(both.where("n <= 3"), both, 5).select("question_id", "id", "n")


def answers(spark, sf):
    c = _contexts(spark, sf).withColumn("modality", F.lit("text"))
    return A.answer(_questions(spark, sf), c.select("question_id", "n", "modality", "text"))


def table_answers(spark, sf):
    """Questions answered from table rows."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = n.groupBy("r_name").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("rows"))
    text = F.concat(F.lit("Nations.\n\n| key | nation name |\n|---|---|\n"), F.array_join(F.transform("rows", lambda r: F.concat(F.lit("| "), r["n_nationkey"].cast("string"), F.lit(" | "), r["n_name"], F.lit(" |"))), "\n"))
    contexts = rows.select(F.col("r_name").alias("question_id"), F.lit(1).alias("n"), F.lit("table").alias("modality"), text.alias("text"))
    questions = rows.select(F.col("r_name").alias("question_id"), F.concat(F.lit("Which nation is "), F.element_at("rows", 1)["n_name"], F.lit("?")).alias("question"))
    return A.answer(questions, contexts)


def judged(spark, sf):
    d = table(spark, sf, "documents")
    a = d.select(F.col("doc_id").alias("id"), F.substring("text", 1, 80).alias("question"), F.concat(F.substring("text", 1, 400), F.lit(" [1] Something else was never said there.")).alias("answer"), F.when(F.col("doc_id") % 3 > 0, F.substring("text", 200, 300)).alias("reference"))
    return A.judge(a, d.select(F.col("doc_id").alias("id"), F.substring("text", 1, 1600).alias("text")))


def _results(spark, sf):
    e, q = table(spark, sf, "events"), F.col("event_id")
    config = F.concat(F.when(q % 2 == 0, "semantic").otherwise("recursive"), F.lit(" / "), F.element_at(F.array(*map(F.lit, ["dense", "hybrid", "hybrid+rerank", "agentic"])), (q % 4 + 1).cast("int")))
    return e.select(
        config.alias("config"), F.when(q % 5 > 0, q % 3 == 0).alias("hit"), F.when(q % 5 > 0, (q % 11) / 10.0).alias("rr"), ((q % 8) / 8.0).alias("faithfulness"),
        ((q % 9) / 8.0).alias("relevance"), F.when(q % 4 == 1, (q % 7) / 8.0).alias("correctness"), F.round(F.col("value")).alias("latency_ms"),
        ((q % 13) / 1000.0).alias("cost_usd"), (F.col("event_type") == "error").alias("failed"),
    )


def summary(spark, sf):
    return A.summarize(_results(spark, sf))


def run_costs(spark, sf):
    """A run costs what its configs and its judge cost."""
    return A.summarize(_results(spark, sf)).agg(F.round(F.sum("cost_usd") + 0.25, 4).alias("run_cost_usd"))


def best(spark, sf):
    return A.best_values(A.summarize(_results(spark, sf)), {"hit": True, "rr": True, "latency_ms": False, "cost_usd": False})


def report(spark, sf):
    return A.report_lines(A.summarize(_results(spark, sf)))


def matrix(spark, sf):
    """Every item with every config."""
    configs = spark.createDataFrame([(f"{c} / {p}",) for c in ("recursive", "semantic") for p in ("dense", "hybrid", "hybrid+rerank", "agentic")], "config string")
    return _questions(spark, sf).select("question_id").join(F.broadcast(configs))  # eight configs


def judge_scores(spark, sf):
    """Scores of an external judge, clamped."""
    raw = table(spark, sf, "labels").select("doc_id", (F.col("quality") * 1.7 - 0.2).alias("faithfulness"), (F.col("toxic") * -0.4 + 0.33333).alias("relevance"))
    return raw.select("doc_id", T.clamp_score(F.col("faithfulness")).alias("faithfulness"), T.clamp_score(F.col("relevance")).alias("relevance"))


def generated_questions(spark, sf):
    """The first fit sentence of every sampled passage, with a question about its first entity."""
    d = table(spark, sf, "documents").where(F.length("text") > 200)
    s = d.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("seq", "s")).withColumn("clean", T.strip(F.regexp_replace("s", r"^[#\-*| ]+", "")))
    fit = s.withColumn("_e", T.proper_phrases(F.col("clean"))).where((F.length("clean") > 40) & ((F.size("_e") > 0) | F.col("clean").rlike(r"\d")))
    first = I.top(fit, ["doc_id"], 1, "seq")
    subject = F.when(F.size("_e") > 0, F.try_element_at("_e", F.lit(1))).otherwise(F.array_join(F.slice(T.keywords(F.col("clean")), 1, 3), " "))
    return first.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(50).select("doc_id", F.concat(F.lit("What do the documents say about "), subject, F.lit("?")).alias("question"), F.col("clean").alias("answer"))


def lsh_recall(spark, sf):
    """Approximate dense search by random projections, with its recall against the exact one."""
    from scrivia.operators.approximate import lsh_top

    v = _vectors(spark, sf)
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    exact = I.dense_top(q, v, 10).select("query_id", "vec_id")
    near = lsh_top(q, v, 10).select("query_id", "vec_id").withColumn("found", F.lit(1))
    met = exact.join(near, ["query_id", "vec_id"], "left")
    return met.groupBy("query_id").agg(F.round(F.count("found") / F.count("*"), 4).alias("recall"))


def ivf_recall(spark, sf):
    """Approximate dense search in the stored inverted file, with its recall and the share of vectors that it scores."""
    v = _vectors(spark, sf)
    index = V.index_of_version(spark, f"embeddings of {sf}", v.select("vec_id", "vector"))
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    exact = I.dense_top(q, v, 10).select("query_id", "vec_id")
    near = V.ivf_top(q, index, 10).select("query_id", "vec_id").withColumn("found", F.lit(1))
    met = exact.join(near, ["query_id", "vec_id"], "left")
    return met.groupBy("query_id").agg(F.round(F.count("found") / F.count("*"), 4).alias("recall"))


_BM25 = f"""t AS (SELECT doc_id, text, lang, CASE WHEN len(k) = 0 THEN ['_'] ELSE k END AS k FROM (SELECT doc_id, text, lang, {sql_tokens('text')} AS k FROM documents)),
x AS (SELECT doc_id, len(k) AS n, unnest(k) AS term FROM t), p AS (SELECT doc_id, term, n, count(*) AS tf FROM x GROUP BY ALL),
c AS (SELECT count(*) AS docs, avg(len(k)) AS avgdl FROM t), d AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
r AS (SELECT term, df, ln(docs - df + 0.5) - ln(df + 0.5) AS raw, avgdl FROM d, c),
w AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM r) ELSE raw END AS idf, avgdl FROM r),
q AS (SELECT item_id AS question_id, text AS question, {sql_tokens('text')} AS k FROM benchmark), qt AS (SELECT question_id, unnest(k) AS term FROM q), qn AS (SELECT question_id, term, count(*) AS times FROM qt GROUP BY ALL),
s AS (SELECT question_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avgdl))), 6) AS score FROM p JOIN qn USING (term) JOIN w USING (term) GROUP BY ALL)"""


def _entities(name: str, source: str, key: str) -> str:
    """CTEs that end in `name` (key, entity): the eight most frequent phrases of each text that look like names."""
    cut = f"list_filter(list_transform(regexp_extract_all(regexp_replace(text, '[\\x{{80}}-\\x{{10FFFF}}]', '_', 'g'), '{PROPER_SQL}'), lambda x: trim(x)), lambda x: length(x) >= 3 AND lower(x) NOT IN ({STOP_SQL}))"
    return f"""{name}_p AS (SELECT {key}, {cut} AS ps FROM {source}),
{name}_e AS (SELECT {key}, i, regexp_replace(regexp_replace(lower(ps[i]), '\\s+', ' ', 'g'), '^(the|a|an)\\s+', '') AS entity FROM {name}_p, LATERAL (SELECT unnest(range(1, len(ps) + 1)) AS i) t),
{name}_r AS (SELECT {key}, entity, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, min(i)) AS r FROM {name}_e GROUP BY {key}, entity),
{name} AS (SELECT {key}, entity FROM {name}_r WHERE r <= 8)"""


_EDGES = _entities("edges", "documents", "doc_id")


def _ranked(k: int, where: str = "true") -> str:
    return f"ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS n FROM s WHERE score > 0 AND {where}) WHERE n <= {k})"


_DENSE = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"""


def _dense(name: str, a: int, b: int) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
      SELECT q.vec_id AS query_id, d.vec_id, round(list_dot_product(q.v[{a}:{b}], d.v[{a}:{b}]), 6) AS score FROM v q, v d WHERE q.vec_id % 50 = 0)) WHERE rank <= 24)"""


_RANKINGS = f"""{_DENSE}, {_dense('da', 1, 32)}, {_dense('db', 33, 64)},
g AS (SELECT * FROM (SELECT q.vec_id AS query_id, d.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY d.vec_id) AS rank FROM v q JOIN v d USING (label) WHERE q.vec_id % 50 = 0) WHERE rank <= 24),
rankings AS (SELECT query_id, vec_id AS id, 'dense' AS source, 1.0 AS w, rank FROM da UNION ALL SELECT query_id, vec_id, 'sparse', 1.0, rank FROM db UNION ALL SELECT query_id, vec_id, 'graph', 0.6, rank FROM g)"""
_CONTEXTS = f"ctx AS (SELECT question_id, question, n, doc_id, d.text, d.source || '_' || doc_id || '.txt' AS title FROM ranked JOIN q USING (question_id) JOIN documents d USING (doc_id))"
_KEYS = sql_keywords("question")

QUERIES = {
    "r02_bm25": (bm25, f"WITH {_BM25}, {_ranked(24)} SELECT question_id, doc_id AS chunk_id, score FROM ranked"),
    "r02_flt01_bm25_filtered": (bm25_filtered, f"""WITH {_BM25}, {_ranked(6, "(SELECT lang = 'en' FROM t WHERE t.doc_id = s.doc_id)")} SELECT question_id, doc_id AS chunk_id, score FROM ranked"""),
    "ag17_statistics": (corpus_statistics, f"WITH {_BM25} SELECT term, df, round(idf, 6) AS idf, round(avgdl, 6) AS avg_length FROM w"),
    "jn12_expected": (expected, "SELECT item_id AS question_id, doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)"),
    "ev03_hit_and_rr": (
        evaluated,
        f"""WITH {_BM25}, {_ranked(24)}, e AS (SELECT item_id AS question_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
        f AS (SELECT question_id, min(n) AS f FROM ranked JOIN e USING (question_id, doc_id) GROUP BY 1), a AS (SELECT DISTINCT question_id FROM e)
        SELECT q.question_id, CASE WHEN a.question_id IS NOT NULL THEN f IS NOT NULL END AS hit, CASE WHEN a.question_id IS NOT NULL THEN coalesce(round(1 / f::DOUBLE, 6), 0) END AS rr FROM q LEFT JOIN a USING (question_id) LEFT JOIN f ON f.question_id = q.question_id""",
    ),
    "r01_jn07_dense": (dense, f"WITH {_DENSE}, {_dense('d', 1, 64)} SELECT query_id, vec_id, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank FROM d"),
    "r04_r06_fusion": (
        fused,
        f"""WITH {_RANKINGS}, f AS (SELECT query_id, id, round(sum(w::DOUBLE / (60 + rank)), 5) AS fused, min(rank) FILTER (source = 'dense') AS dense_rank, min(rank) FILTER (source = 'sparse') AS sparse_rank, min(rank) FILTER (source = 'graph') AS graph_rank FROM rankings GROUP BY ALL),
        o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, least(coalesce(dense_rank, 1000000000), coalesce(sparse_rank, 1000000000), coalesce(graph_rank, 1000000000)), id) AS n FROM f)
        SELECT query_id, id, fused, CAST(dense_rank AS INTEGER) AS dense_rank, CAST(sparse_rank AS INTEGER) AS sparse_rank, CAST(graph_rank AS INTEGER) AS graph_rank, CAST(n AS INTEGER) AS n FROM o WHERE n <= 12""",
    ),
    "r10_st01_trace": (
        trace,
        f"WITH {_RANKINGS} SELECT query_id, count(*) FILTER (source = 'dense') AS n_dense, count(*) FILTER (source = 'sparse') AS n_sparse, count(*) FILTER (source = 'graph') AS n_graph, count(DISTINCT id) AS n_fused FROM rankings GROUP BY 1",
    ),
    "e01_hash_embedding": (hashed, None),
    "r04_hybrid": (hybrid, None),
    "r09_ag09_entity_edges": (entity_edges, f"WITH {_EDGES} SELECT entity, count(*) AS n_chunks FROM edges GROUP BY 1 HAVING count(*) > 1"),
    "r05_jn09_ag08_entities": (
        by_entity,
        f"""WITH {_EDGES}, {_entities("asked", "benchmark", "item_id")}, k AS (SELECT DISTINCT entity FROM edges),
        q AS (SELECT item_id, entity FROM benchmark, k WHERE length(entity) >= 3 AND contains(' ' || lower(text) || ' ', ' ' || entity || ' ') UNION SELECT item_id, entity FROM asked JOIN k USING (entity)),
        h AS (SELECT item_id AS question_id, doc_id AS id, count(*) AS n FROM q JOIN edges USING (entity) GROUP BY ALL)
        SELECT question_id, id, n FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY n DESC, id) AS r FROM h) WHERE r <= 24""",
    ),
    "r07_rerank": (
        reranked,
        f"""WITH {_BM25}, {_ranked(24)}, {_CONTEXTS}, k AS (SELECT question_id, doc_id, list_distinct({_KEYS}) AS qs, {sql_tokens('text')} AS ts, count(*) OVER (PARTITION BY question_id) AS nn FROM ctx),
        h AS (SELECT question_id, doc_id, nn, greatest(len(ts), 1) AS l, term, len(list_filter(ts, lambda x: x = term)) AS tf FROM (SELECT *, unnest(qs) AS term FROM k)),
        f AS (SELECT *, count(*) OVER (PARTITION BY question_id, term) AS df FROM h WHERE tf > 0),
        g AS (SELECT question_id, doc_id, sum(ln(1 + (nn - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / 120))) AS r FROM f GROUP BY ALL)
        SELECT k.question_id, k.doc_id AS id, coalesce(round(r, 4), 0) AS rerank FROM k LEFT JOIN g USING (question_id, doc_id)""",
    ),
    "r07b_external_rerank": (
        external,
        f"""WITH {_BM25}, {_ranked(24)}, l AS (SELECT DISTINCT doc_id, quality * 0.5::DOUBLE + toxic AS r FROM labels), m AS (SELECT question_id, doc_id, score, coalesce(r, 0) AS rerank FROM ranked LEFT JOIN l USING (doc_id))
        SELECT question_id, doc_id AS id, rerank, CAST(row_number() OVER (PARTITION BY question_id ORDER BY rerank DESC, score DESC, doc_id) AS INTEGER) AS n FROM m""",
    ),
    "r08_parent_expansion": (expanded, None),
    "flt01_filters": (
        filtered,
        f"WITH {SQL_CHUNKS} SELECT chunk_id, modality FROM chunks WHERE modality IN ('table', 'image') AND doc_id IN (SELECT d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))",
    ),
    "q01_rewrite": (
        rewritten,
        f"""WITH l AS (SELECT conv_id, turn, text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS last FROM conversations WHERE role = 'user'),
        a AS (SELECT *, CASE WHEN last <> '' AND (regexp_matches(text, '{T.REFERENTIAL}') OR len({sql_keywords('text')}) < 3) THEN {sql_keywords('last')} END AS ks FROM l),
        b AS (SELECT *, list_filter(ks, lambda x, i: list_position(ks, x) = i) AS ds FROM a)
        SELECT conv_id, turn, trim(text || coalesce(' ' || array_to_string(ds, ' '), '') || CASE WHEN conv_id % 3 = 0 THEN ' more detail' ELSE '' END) AS standalone FROM b""",
    ),
    "q02_t24_st04_grade": (
        graded,
        f"""WITH {_BM25}, {_ranked(6)}, {_CONTEXTS}, kw AS (SELECT question_id, {_KEYS} AS ks FROM q), kq AS (SELECT question_id, list_filter(ks, lambda x, i: list_position(ks, x) = i) AS qs FROM kw),
        m AS (SELECT question_id, n, qs, {sql_tokens("text || ' ' || title")} AS wide, {sql_tokens('text')} AS own FROM ctx JOIN kq USING (question_id)),
        a AS (SELECT question_id, n, qs, list_filter(qs, lambda x: list_contains(wide, x)) AS al, list_filter(qs, lambda x: list_contains(own, x)) AS tx FROM m),
        g AS (SELECT question_id, list_distinct(flatten(list(al) FILTER (n <= 4))) AS found, list_distinct(flatten(list(tx) FILTER (n <= 4))) AS seen,
                     list_sort(list(n) FILTER (len(al) / greatest(len(qs), 1)::DOUBLE >= 0.34)) AS useful FROM a GROUP BY 1),
        sh AS (SELECT kq.question_id, qs, found, seen, useful, coalesce(len(found) / greatest(len(qs), 1)::DOUBLE, 0) AS share FROM kq LEFT JOIN g USING (question_id))
        SELECT question_id, share >= 0.3 AS relevant, share >= 0.6 AS sufficient, coalesce(array_to_string(useful, ','), '') AS useful_sources,
               CASE WHEN found IS NULL THEN 'no sources were retrieved' ELSE array_to_string(list_filter(qs, lambda x: NOT list_contains(seen, x)), ', ') END AS missing FROM sh""",
    ),
    "jn05_st05_merged_contexts": (merged_contexts, f"WITH {_BM25}, {_ranked(5)} SELECT question_id, doc_id AS id, CAST(n AS INTEGER) AS n FROM ranked"),
    "q03_q07_agent": (agent_rounds, None),
    "r03_index_refresh": (
        refreshed,
        f"WITH {_BM25}, {_ranked(24)} SELECT question_id, doc_id AS chunk_id, score, n_terms, n_postings, avg_length FROM ranked, (SELECT count(*) AS n_terms, CAST(sum(df) AS BIGINT) AS n_postings, round(first(avgdl), 6) AS avg_length FROM w)",
    ),
    "r11_retrieve": (retrieved, None),
    "r11_tk02_shortlist": (retrieved_simply, None),
    "r10_retrieve_trace": (retrieval_trace, None),
    "q07_ask": (asked, None),
    "ev02_run_results": (evaluation_results, None),
    "ev06_run_summary": (evaluation_summary, None),
    "snk04_run_report": (evaluation_report, None),
    "ag16_run_best": (evaluation_best, None),
    "ag14_evaluation_cost": (evaluation_cost, None),
    "q04_answers": (
        answers,
        f"""WITH {_BM25}, {_ranked(6)}, {_CONTEXTS}, k AS (SELECT question_id, n, list_distinct({_KEYS}) AS qs, {sql_sentences('text')} AS ss FROM ctx),
        e AS (SELECT question_id, n, qs, i, ss[i] AS s FROM k, LATERAL (SELECT unnest(range(1, len(ss) + 1)) AS i) t),
        said AS (SELECT question_id, n, i, qs, trim(regexp_replace(s, '^[-* ]+', '')) AS p FROM e WHERE s NOT LIKE '|%' AND s NOT LIKE '#%'),
        o AS (SELECT *, len(list_intersect(qs, {sql_tokens('p')})) AS o FROM said WHERE length(p) >= 25),
        z AS (SELECT *, round(o - (n - 1) * 0.1::DOUBLE, 4) AS score, substr(p, 1, 80) AS key FROM o WHERE o > 0),
        u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, key ORDER BY score DESC, n, i) AS r FROM z) WHERE r = 1),
        b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, n, i, key) AS r4 FROM u) WHERE r4 <= 4),
        l AS (SELECT question_id, string_agg('- ' || p || ' [' || n || ']' || chr(10), '' ORDER BY r4) AS l FROM b GROUP BY 1)
        SELECT q.question_id, CASE WHEN l IS NULL THEN '{A.NOT_FOUND}' ELSE 'Here is what the documents say:' || chr(10) || chr(10) || l || chr(10) || '_Offline mode: these are extracted passages, not a generated answer._' END AS answer FROM q LEFT JOIN l USING (question_id)""",
    ),
    "q04_table_answers": (table_answers, None),
    "t23_ev04_judge": (
        judged,
        f"""WITH a AS (SELECT doc_id AS id, substr(text, 1, 80) AS question, substr(text, 1, 400) || ' [1] Something else was never said there.' AS answer, CASE WHEN doc_id % 3 > 0 THEN substr(text, 200, 300) END AS reference, substr(text, 1, 1600) AS ctx FROM documents),
        b AS (SELECT *, regexp_replace(answer, '\\[\\d{{1,2}}\\]', '', 'g') AS bare, {sql_tokens('ctx')} AS src, {sql_keywords('answer')} AS ka, {sql_keywords('coalesce(reference, chr(32))')} AS kr, list_distinct({_KEYS}) AS kq FROM a),
        c AS (SELECT id, src, {sql_keywords('s')} AS k FROM (SELECT id, src, unnest({sql_sentences('bare')}) AS s FROM b)),
        f AS (SELECT id, round_even(count(*) FILTER (len(list_intersect(list_distinct(k), src)) / len(list_distinct(k))::DOUBLE >= 0.6) / count(*)::DOUBLE, 3) AS faithfulness FROM c WHERE len(k) >= 3 GROUP BY 1),
        wa AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(ka) AS w FROM b) GROUP BY ALL), wr AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(kr) AS w FROM b) GROUP BY ALL),
        o AS (SELECT id, sum(least(wa.n, wr.n)) AS c FROM wa JOIN wr USING (id, w) GROUP BY 1),
        g AS (SELECT b.id, coalesce(2 * (c / len(ka)::DOUBLE) * (c / len(kr)::DOUBLE) / (c / len(ka)::DOUBLE + c / len(kr)::DOUBLE), 0) AS f1 FROM b LEFT JOIN o USING (id))
        SELECT b.id, coalesce(faithfulness, 0) AS faithfulness, CASE WHEN len(kq) > 0 THEN round_even(len(list_intersect(kq, ka)) / len(kq)::DOUBLE, 3) ELSE 0 END AS relevance, CASE WHEN reference IS NOT NULL AND reference <> '' THEN round_even(f1, 3) END AS correctness
        FROM b LEFT JOIN f USING (id) LEFT JOIN g USING (id)""",
    ),
    "ag13_ev06_summary": (
        summary,
        """WITH r AS (SELECT *, event_id AS q FROM events), c AS (SELECT CASE WHEN q % 2 = 0 THEN 'semantic' ELSE 'recursive' END || ' / ' || ['dense', 'hybrid', 'hybrid+rerank', 'agentic'][CAST(q % 4 AS INT) + 1] AS config, CASE WHEN q % 5 > 0 THEN CAST(q % 3 = 0 AS INT) END AS hit, CASE WHEN q % 5 > 0 THEN (q % 11) / 10::DOUBLE END AS rr,
        (q % 8) / 8::DOUBLE AS faithfulness, (q % 9) / 8::DOUBLE AS relevance, CASE WHEN q % 4 = 1 THEN (q % 7) / 8::DOUBLE END AS correctness, round(value) AS latency_ms, (q % 13) / 1000::DOUBLE AS cost_usd, event_type = 'error' AS failed FROM r)
        SELECT config, round_even(avg(hit), 4) AS hit, round_even(avg(rr), 4) AS rr, round_even(avg(faithfulness), 4) AS faithfulness, round_even(avg(relevance), 4) AS relevance, round_even(avg(correctness), 4) AS correctness, round_even(avg(latency_ms), 4) AS latency_ms, round_even(sum(cost_usd), 5) AS cost_usd, count(*) FILTER (failed) AS errors FROM c GROUP BY 1""",
    ),
    "ag14_run_cost": (run_costs, "SELECT round(sum((event_id % 13) / 1000::DOUBLE) + 0.25, 4) AS run_cost_usd FROM events"),
    "ag16_best": (best, None),
    "snk04_report": (report, None),
    "jn06_ev01_matrix": (
        matrix,
        "SELECT item_id AS question_id, c || ' / ' || p AS config FROM benchmark, (VALUES ('recursive'), ('semantic')) a(c), (VALUES ('dense'), ('hybrid'), ('hybrid+rerank'), ('agentic')) b(p)",
    ),
    "ev05_t22_judge_scores": (
        judge_scores,
        "SELECT doc_id, round_even(greatest(0, least(1, quality * 1.7::DOUBLE - 0.2::DOUBLE)), 3) AS faithfulness, round_even(greatest(0, least(1, toxic * -0.4::DOUBLE + 0.33333::DOUBLE)), 3) AS relevance FROM labels",
    ),
    "ev07_tk05_questions": (generated_questions, None),
    "r01b_lsh_recall": (lsh_recall, None),
    "r01b_ivf_recall": (ivf_recall, None),
}
QUERIES["ag16_best"] = (
    best,
    QUERIES["ag13_ev06_summary"][1].replace("WITH r AS", "WITH r AS", 1).replace("SELECT config, round_even", ", s AS (SELECT config, round_even").replace("FROM c GROUP BY 1", "FROM c GROUP BY 1)")
    + """, m AS (SELECT unnest(['hit', 'rr', 'latency_ms', 'cost_usd']) AS metric, unnest([true, true, false, false]) AS up, unnest([hit, rr, latency_ms, cost_usd]) AS v FROM s)
    SELECT metric, CASE WHEN count(v) >= 2 AND min(v) < max(v) THEN CASE WHEN up THEN max(v) ELSE min(v) END END AS best FROM m GROUP BY metric, up""",
)
