"""CVE feed: landed JSON lines to flat records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.constants import CPE_KEPT, UNKNOWN
from threatloom.functions.templates import cve_text
from threatloom.functions.text import record_id
from threatloom.operators.stats import observed
from threatloom.schemas import CVE_FEED

# The corrupt-record column has to be declared for malformed lines to be told apart.
FEED_LINES = T.StructType([*CVE_FEED.fields, T.StructField("_corrupt_record", T.StringType())])


MALFORMED, NAMELESS = "malformed", "without id"


def reject_reason() -> Column:
    """Why a line read with `FEED_LINES` is no record, or null."""
    return F.when(F.col("_corrupt_record").isNotNull(), MALFORMED).when(F.col("id").isNull(), NAMELESS)


def well_formed(lines: DataFrame, seen: Observation | None = None) -> DataFrame:
    """Records of lines read with `FEED_LINES`: malformed lines and records without an id are skipped.

    The observation counts `rows`, `malformed` and `nameless` of whatever action runs.
    """
    counted = observed(lines, seen, malformed=reject_reason() == MALFORMED, nameless=reject_reason() == NAMELESS)
    return counted.where(reject_reason().isNull()).drop("_corrupt_record")


def feed_lines(spark: SparkSession, path: str) -> DataFrame:
    """A folder of JSON lines, the malformed ones as `_corrupt_record`."""
    return spark.read.schema(FEED_LINES).option("mode", "PERMISSIVE").json(path)


def rejected(lines: DataFrame) -> DataFrame:
    """(reason, line) of what `well_formed` skips: the line itself, or the record as it was understood."""
    record = F.to_json(F.struct(*[f.name for f in CVE_FEED.fields]))
    return lines.select(reject_reason().alias("reason"), F.coalesce("_corrupt_record", record).alias("line")).where(
        F.col("reason").isNotNull()
    )


def read_feed(
    spark: SparkSession, path: str, *, quarantine: str | None = None, seen: Observation | None = None
) -> DataFrame:
    """Well-formed records of a folder of JSON lines.

    With `quarantine`, the folder of a JSON-lines table, all other lines are added to it with the reason, at once. With an
    observation they are counted by whatever action reads the records.
    """
    lines = feed_lines(spark, path)
    if quarantine is not None:
        rejected(lines).write.mode("append").json(quarantine)
    return well_formed(lines, seen)


def flatten_cves(feed: DataFrame, *, severity_at: int = 1, score_at: int = 2) -> DataFrame:
    """One flat row per CVE with a description.

    The two positions say where the score list holds severity and number; a list
    too short for the number leaves both at their defaults.
    """
    score = F.get("score", F.lit(score_at)).try_cast("double")
    severity = F.get("score", F.lit(severity_at))
    has_score = F.coalesce(F.size("score") > max(severity_at, score_at), F.lit(False))
    values = F.coalesce(F.col("cwe.value"), F.array().cast("array<string>"))
    criteria = F.coalesce(F.col("cpe.criteria"), F.array().cast("array<string>"))
    flat = feed.select(
        F.col("id").alias("cve_id"),
        F.get(F.col("descriptions.value"), F.lit(0)).alias("description"),
        F.when(has_score, score).alias("cvss_score"),
        F.when(has_score, severity).otherwise(F.lit(UNKNOWN)).alias("severity"),
        values.alias("cwe_ids"),
        F.slice(criteria, 1, CPE_KEPT).alias("cpe"),
        F.coalesce("published", F.lit("")).alias("published"),
        F.coalesce("lastModified", F.lit("")).alias("last_modified"),
    )
    return flat.where(F.col("description") != "")


def with_id(cves: DataFrame) -> DataFrame:
    return cves.withColumn("id", record_id(F.col("cve_id")))


def with_text(cves: DataFrame) -> DataFrame:
    """Add the text to embed; best after de-duplication, which then moves each description once, not twice."""
    return cves.withColumn("text", cve_text(F.col("cve_id"), F.col("description"), F.col("cwe_ids")))
