"""Which feed queries a CVE answers: one per target weakness, then one per keyword group.

All queries are evaluated in one pass over the records; the query's rank in the
fixed order says which came first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.constants import CWE_QUERY_LIMIT, KEYWORD_GROUPS, KEYWORD_QUERY_LIMIT, TARGET_CWES
from threatloom.operators.dedup import limit_per_group


def keyword_hit(description: Column, severity: Column, phrase: Column, wanted: Column) -> Column:
    """Same severity, and the phrase occurs in the description in any case."""
    return (severity == wanted) & F.lower(description).contains(F.lower(phrase))


def query_ranks(
    cwe_ids: Column,
    description: Column,
    severity: Column,
    targets: Sequence[str] = TARGET_CWES,
    keywords: Sequence[tuple[str, str]] = KEYWORD_GROUPS,
) -> Column:
    """Ascending ranks of all queries a record answers; a row-local array, no join."""
    return F.array_compact(F.array(*_ranked_hits(cwe_ids, description, severity, targets, keywords)))


def first_query(
    cwe_ids: Column,
    description: Column,
    severity: Column,
    targets: Sequence[str] = TARGET_CWES,
    keywords: Sequence[tuple[str, str]] = KEYWORD_GROUPS,
) -> Column:
    """The least of `query_ranks`, or null; queries behind it are not tested."""
    return F.coalesce(*_ranked_hits(cwe_ids, description, severity, targets, keywords))


def _ranked_hits(
    cwe_ids: Column, description: Column, severity: Column, targets: Sequence[str], keywords: Sequence[tuple[str, str]]
) -> list[Column]:
    """Of each query its rank where the record answers it, else null."""
    hits = [F.array_contains(cwe_ids, target) for target in targets]
    hits += [keyword_hit(description, severity, F.lit(phrase), F.lit(wanted)) for phrase, wanted in keywords]
    return [F.when(hit, F.lit(rank)) for rank, hit in enumerate(hits)]


def matched_queries(cves: DataFrame) -> DataFrame:
    """Bag union of all query results: a record appears once per query it answers."""
    ranks = query_ranks(F.col("cwe_ids"), F.col("description"), F.col("severity"))
    return cves.withColumn("query_rank", F.explode(ranks))


def limit_queries(matches: DataFrame, order: Sequence[Column | str], salts: int = 16) -> DataFrame:
    """At most the fixed number of records per query: one limit for weaknesses, one for keywords."""
    limit = F.when(F.col("query_rank") < len(TARGET_CWES), CWE_QUERY_LIMIT).otherwise(KEYWORD_QUERY_LIMIT)
    top = limit_per_group(
        matches, ["query_rank"], order, max(CWE_QUERY_LIMIT, KEYWORD_QUERY_LIMIT),
        rank_name="in_query", salts=salts,
    )
    return top.where(F.col("in_query") <= limit).drop("in_query")


def keyword_matches(texts: DataFrame, keywords: DataFrame, *, text: str = "description", severity: str = "severity") -> DataFrame:
    """Join texts with a small table (keyword, keyword_severity, ...) of keyword queries.

    An equi-join on severity with the phrase test on top. `keywords` is
    broadcast and has to be a constant table.
    """
    condition = keyword_hit(F.col(text), F.col(severity), F.col("keyword"), F.col("keyword_severity"))
    return texts.join(F.broadcast(keywords), condition)


def by_target(df: DataFrame, tags: str, targets: DataFrame, target: str = "cwe_id") -> DataFrame:
    """One row per (record, target it carries); `targets` is a constant table."""
    exploded = df.withColumn(target, F.explode(F.array_distinct(F.col(tags))))
    return exploded.join(F.broadcast(targets), target)


def moment_of(df: DataFrame, column: str) -> Column:
    """A column of moments as timestamps: text is parsed, in any ISO form and zone, and null where it is no moment."""
    kind = df.schema[column].dataType
    return F.try_to_timestamp(F.col(column)) if isinstance(kind, T.StringType) else F.col(column)


def modified_between(df: DataFrame, moment: str, since: str | None, until: str | None = None) -> DataFrame:
    """Records modified in [since, until], compared as moments; without `since` nothing is filtered (full load).

    Records without a legible moment are in a full load only. On a column of timestamps the filter reaches the scan.
    """
    if since is None:
        return df
    at = moment_of(df, moment)
    kept = df.where(at >= F.to_timestamp(F.lit(since)))
    return kept.where(at <= F.to_timestamp(F.lit(until))) if until is not None else kept
