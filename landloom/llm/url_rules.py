"""URL filters: rules found by hashed host-suffix and path-prefix expressions.

A URL is expanded into host suffix + path prefix expressions: suffixes of as many labels, and prefixes of as many
characters, as some rule has, so the work of a URL grows with its length only. Their short hash prefixes are equi-joined to the rules',
full digests confirm the match, and precedence picks one rule: the longest rule string, blocks before allows when
equally long, then the smallest rule string. "/en/1" fits "/en/12" too; hosts are cut at dots only.

Defined cases: a null URL or one without "://" has an empty host and path, and fits no rule; an unmatched URL is
allowed; a host rule with an empty path fits every path; repeated rows each get their row; an empty table or rule
list gives no rows or no rules; other columns are not read unless asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower

#: Digits (hex) of the digest that the join uses; the full digest is compared after it.
PREFIX_DIGITS = 8
#: A rule table of more rows than this is joined by shuffle, not broadcast.
BROADCAST_RULES = 100_000
DEFAULT_VERDICT = "allow"
#: The rules of the query.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """parts(host, path), rules(verdict, host, path) -> host, path, rule, verdict; one row per distinct part that a rule fits."""
    rules = rules.select(F.col("verdict").alias("rule_verdict"), ascii_lower(F.coalesce("host", F.lit(""))).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path")).distinct()
    counts = [r[0] for r in rules.select(F.size(F.split("rule_host", r"\.")).alias("n")).distinct().orderBy("n").collect()]  # distinct label counts, at most the longest rule host
    lengths = [r[0] for r in rules.select(F.length("rule_path")).distinct().orderBy(F.length("rule_path")).collect()]  # distinct lengths, at most the longest rule path
    keyed = rules.withColumn("rule_digest", F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256)).withColumn("short", F.substring("rule_digest", 1, PREFIX_DIGITS))
    if keyed.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        keyed = F.broadcast(keyed)
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -n) for n in counts]))  # a shorter host as a whole
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths] or [F.lit(None).cast("string")]), lambda p: p.isNotNull())
    each = parts.where("host <> ''").distinct().select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
    each = each.select("host", "path", "suffix", F.explode("prefixes").alias("prefix"))
    each = each.withColumn("digest", F.sha2(F.concat_ws("\n", "suffix", "prefix"), 256))
    hits = each.join(keyed, F.substring("digest", 1, PREFIX_DIGITS) == F.col("short")).where("digest = rule_digest AND suffix = rule_host AND prefix = rule_path")
    text = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(text), F.col("rule_verdict") == "block", F.transform(F.split(text, ""), lambda c: -F.ascii(c)), text.alias("rule"), F.col("rule_verdict").alias("verdict"))).alias("best")
    return hits.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.verdict")


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = DEFAULT_VERDICT) -> DataFrame:
    rows = pages.select(*keep, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    judged = judge_urls(rows.select("host", "path"), rules)
    return rows.join(judged, ["host", "path"], "left").select(*keep, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: the verdict on every page's URL."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.createDataFrame(RULES, "verdict string, host string, path string"))


ORACLE = """
WITH rules(rv, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS rid FROM pages),
m AS (SELECT p.rid, rh || rp AS rule, rv, row_number() OVER (PARTITION BY p.rid ORDER BY length(rh || rp) DESC, rv DESC) AS rn
      FROM p JOIN rules ON (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp))
SELECT page_id, host, path, m.rule AS rule, coalesce(m.rv, 'allow') AS verdict FROM p LEFT JOIN m ON p.rid = m.rid AND m.rn = 1
"""
