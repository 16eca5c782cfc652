"""Operator 10, URL filters, with DataFrame functions only.

Each URL is expanded into expressions host-suffix + path-prefix: the suffixes of its host of those numbers
of labels that rules have, and the prefixes of its path of those lengths that rules have, so that a very long
URL has no more expressions than a short one.  Expressions
meet rules in an equi-join on the first PREFIX hexadecimal digits of their SHA-256; the full
digest confirms.  Of the rules that fit a URL the longest wins (host and path together; of
two as long, the one with the longer host, then `block`).

Equal (host, path) pairs are expanded once, so that a hot host or page costs no more than
its distinct paths, and the result is joined back on both columns.  Rules are broadcast
only while there are at most BROADCAST_RULES of them (about 20 MB); beyond that the join is
left to Spark.

host and path are empty for a null url and one without "://".  Equal rows get equal
results; rows without an id are judged like any other; an empty table gives no rows.  Columns of pages other than the id
and the url are ignored, whatever their names.  Of rules, those with a null host or path are passed over; without any rule
all URLs get the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col

PREFIX, BROADCAST_RULES, DEFAULT = 8, 100_000, "allow"

#: The rules of the query: (host, path, verdict).
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules as a DataFrame of literals."""
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def host_and_path(url) -> tuple:
    """host: after the first "://" up to / ? # or the end, A-Z in lower case; path: then up to ? # or the end."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def labels_of(host) -> Column:
    return F.length(host) - F.length(F.replace(F.col(host), F.lit("."), F.lit(""))) + 1


def url_filters(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule (null: none fits), verdict."""
    rules = rules.where("host is not null and path is not null").select(
        F.concat("host", "path").alias("rule"), F.col("verdict").alias("rule_verdict"), F.length("host").alias("rule_host"), F.length("path").alias("rule_path"), labels_of("host").alias("rule_labels")
    ).withColumn("rule_digest", F.sha2("rule", 256)).withColumn("rule_prefix", F.substring("rule_digest", 1, PREFIX))
    size, lengths, depths = rules.agg(F.count("*"), F.sort_array(F.collect_set("rule_path")), F.sort_array(F.collect_set("rule_labels"))).first()  # at most as many as a URL is long
    if size <= BROADCAST_RULES:
        rules = F.broadcast(rules)

    host, path = host_and_path(col(url))
    rows = pages.select(col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    hosts = F.array_compact(F.array(*[F.when(labels_of("host") >= n, F.substring_index("host", ".", -n)) for n in depths])) if depths else F.array().cast("array<string>")
    paths = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = (
        rows.select("host", "path").where("host <> ''").distinct()
        .select("host", "path", F.explode(hosts).alias("h"), paths.alias("ps"))
        .select("host", "path", "h", F.explode("ps").alias("p"))
        .select("host", "path", F.length("h").alias("h_len"), F.sha2(F.concat("h", "p"), 256).alias("digest"))
    )
    best = (
        expressions.join(rules, F.substring("digest", 1, PREFIX) == F.col("rule_prefix"))
        .where("digest = rule_digest and h_len = rule_host")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.col("rule_host") + F.col("rule_path"), "rule_host", F.col("rule_verdict") == "block", "rule", "rule_verdict")).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("rule_verdict"))
    )
    return rows.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict"))


def op10_url_filters(spark, sf_dir) -> DataFrame:
    from .common import read

    return url_filters(read(spark, sf_dir, "pages"), rule_table(spark))


OP10_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, rest, regexp_extract(rest, '^([^/?#]*)', 1) AS raw FROM cut),
rows_ AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1) AS path FROM parts),
rules(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
fits AS (
  SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM (SELECT DISTINCT host, path FROM rows_), rules
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM rows_ LEFT JOIN fits USING (host, path)
"""
