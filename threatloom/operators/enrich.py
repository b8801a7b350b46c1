"""Attach the nearest collection entries to each finding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.constants import MATCHES_PER_FINDING
from threatloom.operators.embed import Encoder, embed_text, hashed_tokens
from threatloom.operators.knn import knn_join
from threatloom.session import stored


#: At most so many ids of matched entries (some 20 bytes each) are broadcast; more are shuffled.
BROADCAST_IDS = 1_000_000


def matched_entries(matches: DataFrame, corpus: DataFrame, *, corpus_id: str = "id", payload: str = "payload") -> DataFrame:
    """Rows of `knn_join` output with the payload of the entry found.

    Only entries that are matched leave their place: their ids, few of which are broadcast, are met by a projection of id and
    payload, without the vectors. `matches` is read twice, so it should be stored.
    """
    ids = matches.select("id").distinct()
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    entries = corpus.select(F.col(corpus_id).cast("long").alias("id"), F.col(payload).alias("payload"))
    return matches.join(entries.join(ids, "id", "left_semi"), "id")


def ordered_payloads(out: str) -> Column:
    """Aggregate of `matched_entries`: the payloads of a query, best first, at most `k` of them."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", F.struct("id", "payload").alias("hit"))))
    return F.transform(ranked, lambda m: m["hit"]["payload"]).alias(out)


def collect_matches(matches: DataFrame, corpus: DataFrame, *, corpus_id: str = "id", payload: str = "payload", out: str) -> DataFrame:
    """(query_id, ordered array of payloads) from the stored output of `knn_join`."""
    entries = matched_entries(matches, corpus, corpus_id=corpus_id, payload=payload)
    return entries.groupBy("query_id").agg(ordered_payloads(out))


def attach_matches(
    findings: DataFrame,
    collection: DataFrame,
    *,
    text: str = "description",
    k: int = MATCHES_PER_FINDING,
    encoder: Callable[[], Encoder] = hashed_tokens,
    out: str = "cve_matches",
    **knn_options,
) -> DataFrame:
    """Every finding with the payloads of its `k` nearest entries, best first; an empty array without any.

    Each distinct text is encoded and looked up once, however many findings share it;
    the encoded texts are stored, as the look-up needs their number before their vectors.
    """
    distinct = findings.select(text).where(F.col(text).isNotNull()).distinct()
    probes = distinct.select(F.md5(text).alias("query_id"), text)
    encoded = stored(embed_text(probes, text, encoder=encoder).select("query_id", "embedding"), "probes")
    matches = stored(knn_join(encoded, collection, k, **knn_options), "matches")
    nearest = collect_matches(matches, collection, out=out)
    joined = findings.withColumn("query_id", F.md5(text)).join(nearest, "query_id", "left").drop("query_id")
    empty = F.array().cast(joined.schema[out].dataType)
    return joined.withColumn(out, F.coalesce(F.col(out), empty))
