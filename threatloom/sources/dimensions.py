"""Constant tables. Their size is fixed by this package, so they may be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threatloom.constants import KEYWORD_GROUPS, SEVERITY_LEVELS, TARGET_CWES


def target_cwes(spark: SparkSession) -> DataFrame:
    rows = [(cwe, rank) for rank, cwe in enumerate(TARGET_CWES)]
    return spark.createDataFrame(rows, "cwe_id string, query_rank int")


def keyword_groups(spark: SparkSession) -> DataFrame:
    rows = [
        (phrase, severity, len(TARGET_CWES) + rank)
        for rank, (phrase, severity) in enumerate(KEYWORD_GROUPS)
    ]
    return spark.createDataFrame(rows, "keyword string, keyword_severity string, query_rank int")


def severity_levels(spark: SparkSession) -> DataFrame:
    rows = [(level, rank) for rank, level in enumerate(SEVERITY_LEVELS)]
    return spark.createDataFrame(rows, "severity string, level_rank int")
