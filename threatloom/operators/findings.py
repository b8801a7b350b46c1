"""From answered functions to findings, and their report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.constants import CVE_IDS_SHOWN
from threatloom.functions.text import of_target
from threatloom.functions.verdicts import (
    finding_cwe,
    finding_description,
    finding_severity,
    verdict_array,
)

FUNCTION_COLUMNS = ("name", "code", "start_line", "end_line", "file_path")


def explode_verdicts(answered: DataFrame, response: str = "response") -> DataFrame:
    """One row per verdict of each answer, with its position; duplicates kept."""
    others = [c for c in answered.columns if c != response]
    return answered.select(*others, F.posexplode(verdict_array(F.col(response))).alias("verdict_pos", "verdict"))


def normalised_verdicts(exploded: DataFrame) -> DataFrame:
    """Replace `verdict` by normalised cwe_id, severity and description; keep target weaknesses only."""
    others = [c for c in exploded.columns if c != "verdict"]
    rows = exploded.select(
        *others,
        finding_cwe(F.col("verdict.cwe_id")).alias("cwe_id"),
        finding_severity(F.col("verdict.severity")).alias("severity"),
        finding_description(F.col("verdict.description")).alias("description"),
    )
    return rows.where(of_target(F.col("cwe_id")))


def findings_of(answered: DataFrame, language: Column | None = None) -> DataFrame:
    """Findings of answered functions, in the order given by (file_path, start_line, verdict_pos)."""
    functions = answered.select(*FUNCTION_COLUMNS, "response")
    rows = normalised_verdicts(explode_verdicts(functions))
    return rows.select(
        F.col("name").alias("function_name"), "code", "start_line", "end_line", "file_path",
        (language if language is not None else F.lit("C")).alias("language"),
        "cwe_id", "severity", "description", "verdict_pos",
    )


def shown_ids(ids: Column, shown: int = CVE_IDS_SHOWN) -> Column:
    """The first few non-empty ids as text, or `none`."""
    named = F.filter(F.coalesce(ids, F.array().cast("array<string>")), lambda x: x != "")
    return F.when(F.size(named) == 0, F.lit("none")).otherwise(F.array_join(F.slice(named, 1, shown), ", "))


def report_rows(findings: DataFrame, ids: str = "cve_matches.cve_id") -> DataFrame:
    """One display row per finding."""
    return findings.select(
        finding_severity(F.col("severity")).alias("severity"),
        "function_name", "cwe_id", "start_line", "description",
        shown_ids(F.col(ids)).alias("related_cves"),
    )
