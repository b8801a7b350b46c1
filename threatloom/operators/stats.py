"""Summaries of findings and of the labelled corpus. Counts are combined before every shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from threatloom.constants import SAFE, SEVERITY_LEVELS, VULNERABLE
from threatloom.functions.verdicts import finding_severity
from threatloom.sources.dimensions import severity_levels


def severity_summary(findings: DataFrame, severity: str = "severity") -> DataFrame:
    """(severity, level_rank, n) for the fixed levels, zero-filled; other levels are in no row."""
    counts = (
        findings.select(finding_severity(F.col(severity)).alias("severity"))
        .where(F.col("severity").isin(*SEVERITY_LEVELS))
        .groupBy("severity").agg(F.count("*").alias("n"))
    )
    # at most one count per fixed level
    filled = severity_levels(findings.sparkSession).join(F.broadcast(counts), "severity", "left")
    return filled.select("severity", "level_rank", F.coalesce("n", F.lit(0)).alias("n"))


def severity_totals(findings: DataFrame, severity: str = "severity") -> DataFrame:
    """One row: a count per fixed level and the total, which also counts other levels."""
    level = finding_severity(F.col(severity))
    per_level = [F.count_if(level == name).alias(name.lower()) for name in SEVERITY_LEVELS]
    return findings.agg(*per_level, F.count("*").alias("total"))


def coverage(snippets: DataFrame, group: Sequence[str] = ("cwe_id",), label: str = "label") -> DataFrame:
    """Vulnerable, safe and total rows per group, in one aggregation."""
    def rows_labelled(value: str) -> Column:
        return F.count_if(F.col(label) == value)

    counts = snippets.groupBy(*group).agg(
        rows_labelled(VULNERABLE).alias("vulnerable"), rows_labelled(SAFE).alias("safe")
    )
    return counts.withColumn("total", F.col("vulnerable") + F.col("safe"))


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def observed(df: DataFrame, seen: Observation | None, **counted: Column) -> DataFrame:
    """Let the row count of a stage be read off whatever action runs it, without a pass of its own.

    `counted` adds counts of the rows for which a condition holds. Without an observation nothing is done.
    """
    if seen is None:
        return df
    counts = [F.count_if(F.coalesce(condition, F.lit(False))).alias(name) for name, condition in counted.items()]
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts)
