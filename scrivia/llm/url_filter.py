"""URL filters by host-suffix and path-prefix rules.

Each URL is expanded into the expressions that a rule could equal (the host's label suffixes times the
path's prefixes), the expressions meet the rules in an equi-join on a short hash prefix, full digests
confirm the meeting, and the longest rule decides. All of it is built-in column functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivia.llm.common import table

#: Rules are broadcast up to so many rows, and joined by a shuffle beyond it.
MAX_BROADCAST_RULES = 100_000
#: Hex digits of the digest on which expressions and rules meet.
HASH_PREFIX = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The production rules of `op1_url_filters`: verdict, host, path.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
DEFAULT_VERDICT = "allow"


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    at = F.locate("://", url)
    host = F.regexp_extract(F.substr(url, at + 3), r"^([^/?#]*)", 1)
    return F.coalesce(F.when(at > 0, F.translate(host, UPPER, LOWER)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty for null or without `://`."""
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.regexp_extract(F.substr(url, at + 3), r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def _digest(host: Column, path: Column) -> Column:
    """A host has no slash, so host and path can be joined without mixing two rules up."""
    return F.sha2(F.concat(host, path).cast("binary"), 256)


def filter_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """Add host, path, rule and verdict to every row of `urls`; further columns stay as they are.

    `rules` has verdict, host, path. A rule fits its host and all subdomains whose path starts with the rule's
    path; the longest rule wins, on equal length the one with the longer host, then `block` before `allow`.
    Null or malformed URLs have an empty host and path and take the default verdict; repeated rows each get
    their verdict; rules with a null part are ignored; an empty rule table leaves the default everywhere.
    Columns of `urls` named host, path, rule or verdict are replaced.
    """
    spark = urls.sparkSession
    known = rules.where("host is not null and path is not null and verdict is not null").groupBy("host", "path").agg(
        F.max("verdict").alias("verdict")  # 'block' > 'allow'
    )
    shape = known.agg(
        F.sort_array(F.collect_set(F.size(F.split("host", r"\.")))).alias("depths"),
        F.sort_array(F.collect_set(F.length("path"))).alias("lengths"),
        F.count("*").alias("n"),
    ).first()
    # the row's own columns wait in one, so that none of them meets a name that is used here
    own = F.struct(*[F.col(f"`{c}`") for c in urls.columns if c not in ("host", "path", "rule", "verdict")])
    judged = urls.select(own.alias("_own"), url_host(F.col(f"`{url_col}`")).alias("host"), url_path(F.col(f"`{url_col}`")).alias("path"))
    if not shape["n"]:
        return judged.select("_own.*", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    depths, lengths = F.array(*map(F.lit, shape["depths"])), F.array(*map(F.lit, shape["lengths"]))
    labels = F.size(F.split("host", r"\."))
    # substring_index needs a literal count, so a suffix is cut from the labels themselves
    hosts = F.transform(
        F.filter(depths, lambda d: d <= labels),
        lambda d: F.array_join(F.slice(F.split("host", r"\."), labels - d + 1, d), "."),
    )
    paths = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substr("path", F.lit(1), n))
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: _digest(h, p))))

    marked = known.select(
        _digest(F.col("host"), F.col("path")).alias("_rule_digest"),
        F.concat("host", "path").alias("_rule"),
        F.length("host").alias("_host_length"),
        F.col("verdict").alias("_verdict"),
    ).withColumn("_short", F.substring("_rule_digest", 1, HASH_PREFIX))
    if shape["n"] <= MAX_BROADCAST_RULES:
        marked = F.broadcast(marked)

    # a row is known by its place, so repeated rows stay apart; its expressions never leave their task before
    # the partial aggregate has folded them into one row again
    numbered = judged.withColumn("_row", F.monotonically_increasing_id())
    expanded = numbered.select("*", F.explode_outer(pairs).alias("_digest")).withColumn(
        "_short", F.substring("_digest", 1, HASH_PREFIX)
    )
    met = expanded.join(marked, "_short", "left")
    confirmed = F.col("_digest") == F.col("_rule_digest")
    best = F.max(
        F.when(confirmed, F.struct(F.length("_rule"), "_host_length", "_rule", "_verdict"))
    ).alias("_best")
    return (
        met.groupBy("_row")
        .agg(best, *[F.any_value(c).alias(c) for c in judged.columns])
        .select(
            "_own.*",
            "host",
            "path",
            F.col("_best._rule").alias("rule"),
            F.coalesce(F.col("_best._verdict"), F.lit(default)).alias("verdict"),
        )
    )


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(verdict, host, path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
)
SELECT p.page_id, p.host, p.path, r.rule, coalesce(r.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN LATERAL (
  SELECT rules.host || rules.path AS rule, rules.verdict FROM rules
  WHERE (p.host = rules.host OR ends_with(p.host, '.' || rules.host)) AND starts_with(p.path, rules.path)
  ORDER BY length(rules.host || rules.path) DESC LIMIT 1
) r ON true
"""
