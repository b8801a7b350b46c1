"""Verification of findings by a vote of similar labelled snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.constants import AMBIGUOUS_KEPT_ABOVE, DEFINITE_CONFIDENCE, SAFE, VULNERABLE

FALSE_POSITIVE = "false_positive"
AMBIGUOUS = "ambiguous"


def vote(
    matches: DataFrame, labels: DataFrame, k: int, *, definite: float = DEFINITE_CONFIDENCE
) -> DataFrame:
    """(query_id, verdict, confidence) from `knn_join` output and (id, label) of the snippets."""
    return labelled_vote(matches.join(labels.select("id", "label"), "id"), k, definite=definite)


def labelled_vote(matches: DataFrame, k: int, *aggregates: Column, definite: float = DEFINITE_CONFIDENCE) -> DataFrame:
    """(query_id, verdict, confidence) of matches with their label, and further aggregates of the same rows.

    Similarities below zero count as zero. The label with the larger similarity
    sum wins (a draw is vulnerable), confidence is its sum over `k`; below
    `definite` the verdict is ambiguous.
    """
    weight = F.greatest(F.col("score"), F.lit(0.0))

    def total(label: str) -> Column:
        return F.sum(F.when(F.col("label") == label, weight).otherwise(0.0))

    sums = matches.groupBy("query_id").agg(
        total(VULNERABLE).alias("for_vulnerable"), total(SAFE).alias("for_safe"), *aggregates
    )
    confidence = F.greatest("for_vulnerable", "for_safe") / k
    definite_verdict = F.when(F.col("for_vulnerable") >= F.col("for_safe"), VULNERABLE).otherwise(FALSE_POSITIVE)
    return sums.select(
        "query_id",
        F.when(F.round(confidence, 6) >= definite, definite_verdict).otherwise(AMBIGUOUS).alias("verdict"),
        F.round(confidence, 6).alias("confidence"),
        *sums.columns[3:],
    )


def keep_verified(
    findings: DataFrame,
    *,
    definite: float = DEFINITE_CONFIDENCE,
    ambiguous_above: float = AMBIGUOUS_KEPT_ABOVE,
) -> DataFrame:
    """Drop definite false positives and weak ambiguous findings; findings without a verdict pass."""
    verdict, confidence = F.col("verdict"), F.col("confidence")
    dropped = ((verdict == FALSE_POSITIVE) & (confidence >= definite)) | (
        (verdict == AMBIGUOUS) & (confidence <= ambiguous_above)
    )
    return findings.where(~F.coalesce(dropped, F.lit(False)))
