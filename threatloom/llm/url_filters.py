"""URL filters by host and path rules, matched through hashes (native).

A rule names a host and a path; it fits its host and all subdomains, and every path that starts with its own. Each URL is
expanded into the expressions a rule could have: the last labels of its host joined to a beginning of its path, for each
pair of (labels, path length) that occurs among the rules. An equi-join on the first 8 hex digits of their SHA-256 finds
candidates, the whole digest confirms them, and the longest rule wins (of equally long ones that with the longer host; of
equal rules `block`). URLs without a rule get the default verdict.

Nulls and URLs without `://` have an empty host and path, and fit no rule. An empty path fits only rules without a path.
Hosts are compared in lower case (A-Z), with user and port where a URL has them; paths exactly as they are. Repeated rows
stay, as do null ids; no rules or no pages are fine. Columns named like the result's are replaced by these.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.llm.scratch import is_small, store

ALLOW, BLOCK = "allow", "block"
#: (verdict, host, path)
RULES = (
    (ALLOW, "org", "/"),
    (BLOCK, "example.org", "/es/"),
    (BLOCK, "example.org", "/en/1"),
    (ALLOW, "com", "/fr/"),
    (BLOCK, "com", "/de/"),
)
PREFIX_DIGITS = 8
#: At most so many rules (some 200 bytes each) are broadcast; more meet the expressions in a shuffle.
BROADCAST_RULES = 100_000
RESULT = ("host", "path", "rule", "verdict")
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """(verdict, host, path) as a frame."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def _keyed(rules: DataFrame) -> DataFrame:
    """One row per rule with its digest and what decides between rules; of equal rules `block` stays."""
    host = F.translate(F.col("host"), string.ascii_uppercase, string.ascii_lowercase)
    named = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").select(
        host.alias("host"), "path", "verdict"
    )
    once = named.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # `block` is the greater word
    expression = F.concat("host", "path")
    return once.select(
        F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("path_chars"),
        F.sha2(expression, 256).alias("rule_digest"),
        F.struct(
            F.length(expression).alias("chars"), F.length("host").alias("host_chars"), expression.alias("rule"), "verdict"
        ).alias("found"),
    )


def _expressions(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Digests of the expressions that rules of these shapes (labels, path length) could have."""
    labels = F.size(F.split(host, r"\."))
    made = [
        F.when(
            (labels >= n) & (F.length(path) >= chars),
            F.sha2(F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, chars)), 256),
        )
        for n, chars in shapes
    ]
    return F.array_compact(F.array(*made))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = ALLOW) -> DataFrame:
    """Every row of `pages` with `host`, `path`, `rule` (null where none fits) and `verdict`.

    Only URLs are exploded and only matched ones are gathered, a URL that many pages share once per task. The verdicts of
    URLs are stored, so that the last join is one of two plain tables, in which a frequent URL can be split. Select the
    columns wanted before: they pass through that join.
    """
    keyed = _keyed(rules)
    few = is_small(keyed, BROADCAST_RULES)
    # as many as there are lengths of rules, not rules
    shapes = sorted((r.labels, r.path_chars) for r in keyed.select("labels", "path_chars").distinct().collect())
    own = [c for c in pages.columns if c.lower() not in RESULT]
    parsed = pages.select(*own, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    if not shapes:
        return parsed.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    made = pages.select(F.col(url).alias("_url")).where(F.col("_url").contains("://")).select(
        "_url", F.explode(_expressions(url_host(F.col("_url")), url_path(F.col("_url")), shapes)).alias("digest")
    )
    wanted = keyed.select(F.substring("rule_digest", 1, PREFIX_DIGITS).alias("prefix"), "rule_digest", "found")
    candidates = made.withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS)).join(
        F.broadcast(wanted) if few else wanted, "prefix"
    )
    hits = candidates.where("digest = rule_digest").groupBy("_url").agg(F.max("found").alias("_found"))
    verdicts = store(hits, "url-verdicts")
    return (
        parsed.join(verdicts, F.col(url) == F.col("_url"), "left")
        .select(
            *own, "host", "path", F.col("_found.rule").alias("rule"),
            F.coalesce("_found.verdict", F.lit(default)).alias("verdict"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, rule_table(spark)).select("page_id", *RESULT)


_RULES_SQL = ", ".join(f"('{verdict}', '{host}', '{path}')" for verdict, host, path in RULES)
SQL = rf"""
    WITH rules(verdict, host, path) AS (VALUES {_RULES_SQL}),
    parsed AS (SELECT page_id,
                      translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                                '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
                      regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
    judged AS (SELECT *, (SELECT max((length(r.host || r.path), length(r.host), r.host || r.path, r.verdict)) FROM rules r
                          WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS best
               FROM parsed p)
    SELECT page_id, host, path, best[3] AS rule, coalesce(best[4], '{ALLOW}') AS verdict FROM judged"""
