"""Verification of findings against the labelled corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.constants import AMBIGUOUS_KEPT_ABOVE, DEFINITE_CONFIDENCE, MATCHES_PER_FINDING
from threatloom.operators.embed import Encoder, embed_text, hashed_tokens
from threatloom.operators.enrich import matched_entries, ordered_payloads
from threatloom.operators.knn import knn_join
from threatloom.operators.vote import keep_verified, labelled_vote
from threatloom.session import stored


def verify_findings(
    findings: DataFrame,
    snippets: DataFrame,
    *,
    text: str = "code",
    k: int = MATCHES_PER_FINDING,
    encoder: Callable[[], Encoder] = hashed_tokens,
    definite: float = DEFINITE_CONFIDENCE,
    ambiguous_above: float = AMBIGUOUS_KEPT_ABOVE,
) -> DataFrame:
    """Kept findings with verdict, confidence and the payloads that decided, best first.

    `snippets` is the stored collection (id, embedding, payload). Each distinct
    code text is looked up once; one aggregate of its matches gives its votes and payloads. An empty corpus lets every
    finding pass.
    """
    keyed = findings.withColumn("query_id", F.md5(text))
    probes = findings.select(text).where(F.col(text).isNotNull()).distinct().withColumn("query_id", F.md5(text))
    encoded = stored(embed_text(probes, text, encoder=encoder).select("query_id", "embedding"), "probes")
    matches = stored(knn_join(encoded, snippets, k), "matches")
    labelled = matched_entries(matches, snippets).withColumn("label", F.col("payload.label"))
    verdicts = labelled_vote(labelled, k, ordered_payloads("top_matches"), definite=definite)
    judged = keyed.join(verdicts, "query_id", "left").drop("query_id")
    return keep_verified(judged, definite=definite, ambiguous_above=ambiguous_above)
