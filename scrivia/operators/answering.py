"""Rewriting, grading and extractive answers for whole tables of questions; evaluation of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivia.functions import text as T
from scrivia.operators.index import top

# Wording of the answers.
LEAD = "Here is what the documents say:\n\n"
CLOSING = "\n_Offline mode: these are extracted passages, not a generated answer._"
NOT_FOUND = "I could not find this in the indexed documents."


def rewrite(question: Column, last_user: Column, feedback: Column) -> Column:
    """A follow-up with the keywords of the user's last turn, if it refers back or is short, and with feedback."""
    refers = question.rlike(T.REFERENTIAL) | (F.size(T.keywords(question)) < 3)
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    added = F.when(given(last_user) & refers, F.array_join(F.array_distinct(T.keywords(last_user)), " "))
    return T.strip(F.concat_ws(" ", question, added, F.when(given(feedback), feedback)))


def coverage(question: Column, text: Column) -> Column:
    """The share of the question's keywords that the text has."""
    terms = F.array_distinct(T.keywords(question))
    return F.when(F.size(terms) == 0, 0.0).otherwise(F.size(F.array_intersect(terms, T.tokenize(text))) / F.size(terms))


def grade(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """question_id, relevant, sufficient, missing, useful_sources. contexts: question_id, n, text, title."""
    terms = questions.select("question_id", "question", F.array_distinct(T.keywords(F.col("question"))).alias("_q"))
    met = contexts.join(terms, "question_id").withColumns(
        {"_all": F.array_intersect("_q", T.tokenize(F.concat_ws(" ", "text", F.coalesce("title", F.lit(""))))), "_text": F.array_intersect("_q", T.tokenize(F.col("text")))}
    )
    first = F.when(F.col("n") <= 4, F.col("_all"))
    own = F.size("_all") / F.greatest(F.size("_q"), F.lit(1))
    seen = met.groupBy("question_id").agg(
        F.array_distinct(F.flatten(F.collect_list(first))).alias("_found"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("n") <= 4, F.col("_text"))))).alias("_in_text"),
        F.sort_array(F.collect_list(F.when(own >= 0.34, F.col("n")))).alias("useful_sources"),
    )
    share = F.coalesce(F.size("_found") / F.greatest(F.size("_q"), F.lit(1)), F.lit(0.0))
    out = terms.join(seen, "question_id", "left")
    return out.select(
        "question_id",
        (share >= 0.3).alias("relevant"),
        (share >= 0.6).alias("sufficient"),
        F.when(F.col("_found").isNull(), "no sources were retrieved").otherwise(F.array_join(F.array_except("_q", "_in_text"), ", ")).alias("missing"),
        F.coalesce("useful_sources", F.array().cast("array<int>")).alias("useful_sources"),
    )


def merge_contexts(kept: DataFrame, found: DataFrame, limit: int) -> DataFrame:
    """Useful sources first, then new ones that are not among them, numbered anew up to `limit` a question."""
    new = found.join(kept, ["question_id", "id"], "left_anti")
    both = kept.withColumn("_p", F.lit(0)).unionByName(new.withColumn("_p", F.lit(1)))
    return top(both.withColumnRenamed("n", "_n"), ["question_id"], limit, "_p", "_n", "id", rank="n").drop("_p", "_n")


def candidates(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """Sentences and table rows that answer: question_id, score, n, seq, passage."""
    terms = questions.select("question_id", F.array_distinct(T.keywords(F.col("question"))).alias("_q"))
    met = contexts.join(terms, "question_id")
    behind = (F.col("n") - 1) * 0.1
    text = met.where("modality <> 'table'").select("question_id", "n", "_q", F.posexplode(T.sentences(F.col("text"))).alias("seq", "s"))
    clean = T.strip(F.regexp_replace("s", r"^[-* ]+", ""))
    hits = lambda c: F.size(F.array_intersect("_q", T.tokenize(c)))
    said = (
        text.where(~F.col("s").startswith("|") & ~F.col("s").startswith("#"))
        .withColumn("passage", clean)
        .where(F.length("passage") >= 25)
        .withColumn("_o", hits(F.col("passage")))
        .where("_o > 0")
        .select("question_id", F.round(F.col("_o") - behind, 4).alias("score"), "n", "seq", "passage")
    )
    rows = F.filter(F.split("text", "\n"), lambda r: r.startswith("|"))
    table = met.where("modality = 'table'").withColumn("_rows", rows).where(F.size("_rows") > 0)
    head = hits(F.element_at("_rows", 1))
    fit = F.filter(
        F.slice("_rows", F.lit(3), F.greatest(F.size("_rows") - 2, F.lit(0))),
        lambda r: (hits(r) > 0) & (hits(r) + head >= F.least(F.lit(2), F.size("_q"))),
    )
    shown = table.withColumn("_fit", fit).where(F.size("_fit") > 0)
    told = shown.select(
        "question_id", F.round(hits(F.array_join("_fit", " ")) + 1.5 - behind, 4).alias("score"), "n", F.lit(0).alias("seq"),
        F.concat(F.lit("\n\n"), F.array_join(F.concat(F.slice("_rows", 1, 2), F.slice("_fit", 1, 6)), "\n"), F.lit("\n")).alias("passage"),
    )
    return said.unionByName(told)


def answer(questions: DataFrame, contexts: DataFrame, k: int = 4) -> DataFrame:
    """question_id, answer: the k best different passages, each with its source's number."""
    c = candidates(questions, contexts).withColumn("_key", F.substring("passage", 1, 80))
    distinct = top(c, ["question_id", "_key"], 1, F.desc("score"), "n", "seq")
    best = top(distinct.drop("rank"), ["question_id"], k, F.desc("score"), "n", "seq", "_key")
    line = F.when(F.col("passage").startswith("\n"), F.concat(F.lit("Matching table rows ["), F.col("n").cast("string"), F.lit("]:"), F.col("passage"), F.lit("\n"))).otherwise(
        F.concat(F.lit("- "), F.col("passage"), F.lit(" ["), F.col("n").cast("string"), F.lit("]\n"))
    )
    lines = best.groupBy("question_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "").alias("_lines"))
    text = F.when(F.col("_lines").isNull(), NOT_FOUND).otherwise(F.concat(F.lit(LEAD), F.col("_lines"), F.lit(CLOSING)))
    return questions.select("question_id").join(lines, "question_id", "left").select("question_id", text.alias("answer"))


# -- evaluation


def first_hits(items: DataFrame, ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """question_id, hit, rr over ranked (question_id, id, rank): both null where nothing is expected."""
    found = ranked.join(expected, ["question_id", "id"]).groupBy("question_id").agg(F.min("rank").alias("_first"))
    any_expected = expected.select("question_id").distinct().withColumn("_any", F.lit(True))
    met = items.select("question_id").join(any_expected, "question_id", "left").join(found, "question_id", "left")
    return met.select(
        "question_id", F.when(F.col("_any"), F.col("_first").isNotNull()).alias("hit"), F.when(F.col("_any"), F.coalesce(F.round(1 / F.col("_first"), 6), F.lit(0.0))).alias("rr")
    )


def token_f1(a: DataFrame) -> DataFrame:
    """id, f1 of rows (id, answer, reference): overlap of their keywords as multisets."""
    words = lambda c, name: a.select("id", F.explode(T.keywords(F.col(c))).alias("w")).groupBy("id", "w").agg(F.count("*").alias(name))
    both = words("answer", "_a").join(words("reference", "_b"), ["id", "w"]).groupBy("id").agg(F.sum(F.least("_a", "_b")).alias("_c"))
    sizes = a.select("id", F.size(T.keywords(F.col("answer"))).alias("_na"), F.size(T.keywords(F.col("reference"))).alias("_nb"))
    met = sizes.join(both, "id", "left")
    p, r = F.col("_c") / F.col("_na"), F.col("_c") / F.col("_nb")
    return met.select("id", F.coalesce(2 * p * r / (p + r), F.lit(0.0)).alias("f1"))


def judge(answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """answers (id, question, answer, reference), contexts (id, text) -> faithfulness, relevance, correctness."""
    sources = contexts.select("id", F.explode(T.tokenize(F.col("text"))).alias("w")).distinct()
    bare = F.regexp_replace("answer", r"\[\d{1,2}\]", "")
    claims = answers.select("id", F.posexplode(T.sentences(bare)).alias("seq", "s")).withColumn("_k", T.keywords(F.col("s"))).where(F.size("_k") >= 3)
    words = claims.select("id", "seq", F.explode(F.array_distinct("_k")).alias("w"))
    seen = words.join(sources.withColumn("_in", F.lit(1)), ["id", "w"], "left").groupBy("id", "seq").agg((F.count("_in") / F.count("*")).alias("share"))
    faithful = seen.groupBy("id").agg(F.bround(F.count_if(F.col("share") >= 0.6) / F.count("*"), 3).alias("faithfulness"))
    q = F.array_distinct(T.keywords(F.col("question")))
    relevant = F.when(F.size(q) > 0, F.bround(F.size(F.array_intersect(q, T.keywords(F.col("answer")))) / F.size(q), 3)).otherwise(0.0)
    met = answers.join(faithful, "id", "left").join(token_f1(answers), "id", "left")
    return met.select(
        "id", F.coalesce("faithfulness", F.lit(0.0)).alias("faithfulness"), relevant.alias("relevance"),
        F.when(F.coalesce("reference", F.lit("")) != "", F.bround("f1", 3)).alias("correctness"),
    )


METRICS = ("hit", "rr", "faithfulness", "relevance", "correctness", "latency_ms")


def summarize(results: DataFrame) -> DataFrame:
    """One row a config: means over what is not null, total cost, errors."""
    present = [m for m in METRICS if m in results.columns]
    means = [F.bround(F.avg(F.col(m).cast("double")), 4).alias(m) for m in present]
    return results.groupBy("config").agg(*means, F.bround(F.sum("cost_usd"), 5).alias("cost_usd"), F.count_if("failed").alias("errors"))


def best_values(summary: DataFrame, metrics: dict[str, bool]) -> DataFrame:
    """metric, best for each metric (True: the largest is best); null if fewer than two values or all are equal."""
    rows = summary.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(up).alias("up"), F.col(m).cast("double").alias("v")) for m, up in metrics.items()])))
    several = (F.count("v") >= 2) & (F.min("v") < F.max("v"))
    return rows.groupBy("metric", "up").agg(several.alias("_s"), F.min("v").alias("_lo"), F.max("v").alias("_hi")).select(
        "metric", F.when(F.col("_s"), F.when(F.col("up"), F.col("_hi")).otherwise(F.col("_lo"))).alias("best")
    )


def report_lines(summary: DataFrame) -> DataFrame:
    """A markdown table row for each config."""
    shown = lambda c, text: F.when(F.col(c).isNotNull(), text).otherwise("–")
    pct = lambda c: shown(c, F.format_string("%.0f%%", F.col(c) * 100))
    two = lambda c: shown(c, F.format_string("%.2f", F.col(c)))
    cells = [F.col("config"), pct("hit"), two("rr"), two("faithfulness"), two("relevance"), two("correctness"), F.format_string("%.4f", "cost_usd")]
    return summary.select("config", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
