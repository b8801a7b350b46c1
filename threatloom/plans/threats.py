"""Threat ingestion: CVE feed to a de-duplicated collection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.functions.text import iso_utc
from threatloom.operators.dedup import first_wins
from threatloom.operators.embed import Encoder, hashed_tokens
from threatloom.operators.match import first_query, limit_queries, matched_queries, modified_between
from threatloom.operators.points import cve_points, late_embedding
from threatloom.session import stored
from threatloom.sources.collection import Collection
from threatloom.sources.feed import flatten_cves, with_id, with_text
from threatloom.sources.state import Watermark

# order of the records of one query, and of re-deliveries of one record
_FEED_ORDER = ("published", "last_modified", "cve_id", "description", "severity", "cvss_score", "cwe_ids", "cpe")


def record_order() -> list[Column]:
    """Of several states of a CVE the last modified comes first, then the first query answered; illegible moments are oldest.

    All ascending, so that a sort and the minimum of a struct agree.
    """
    age = F.coalesce(-F.unix_micros(F.try_to_timestamp("last_modified")), F.lit((1 << 63) - 1))
    return [age.alias("age"), F.col("query_rank"), *[F.col(name) for name in _FEED_ORDER]]


def answering(feed: DataFrame, *, since: str | None = None, until: str | None = None) -> DataFrame:
    """Flat records answering at least one query, with the rank of the first; row-local, so for a stream as well."""
    recent = modified_between(flatten_cves(feed), "last_modified", since, until)
    first = first_query(F.col("cwe_ids"), F.col("description"), F.col("severity"))
    # exploding the first rank keeps matching records only and, unlike a filter, tests each query once
    return recent.withColumn("query_rank", F.explode(F.array_compact(F.array(first))))


def threat_records(
    feed: DataFrame, *, since: str | None = None, until: str | None = None, limited: bool = False
) -> DataFrame:
    """Records answering at least one query, one per CVE id, with the record id.

    Of several states of a CVE the last modified one stays, then the first over
    the query order. `limited` applies the per-query record limits, which lose data; without them
    the union of the queries is never spelled out, the first query answered is
    a row-local lookup.
    """
    if limited:
        recent = modified_between(flatten_cves(feed), "last_modified", since, until)
        matched = limit_queries(matched_queries(recent), _FEED_ORDER)
    else:
        matched = answering(feed, since=since, until=until)
    return with_id(first_wins(matched, ["cve_id"], record_order()))


def cve_state() -> Column:
    """When the record of a stored point was last modified; null where that is no timestamp."""
    return F.try_to_timestamp(F.col("payload.last_modified"))


def upsert_threats(records: DataFrame, collection: Collection, encoder: Callable[[], Encoder] = hashed_tokens) -> int:
    """Upsert points of the stored records, which are embedded as they are written; the number of new or changed ones."""
    late = late_embedding(with_text, encoder)
    return collection.upsert(cve_points(records), unique=True, stored=True, state=cve_state(), late=late)


def ingest_threats(
    feed: DataFrame,
    collection: Collection,
    watermark: Watermark,
    *,
    encoder: Callable[[], Encoder] = hashed_tokens,
    until: str | None = None,
    limited: bool = False,
) -> bool:
    """One ingestion run; False, with the watermark untouched, when nothing new was found.

    Records are read from the watermark less its overlap on; what was read before is recognised by its state. The watermark
    is saved after the upsert, as the highest moment of modification read: a crash in between repeats the run, which the
    upsert makes harmless.
    """
    collection.create()
    records = stored(threat_records(feed, since=watermark.since(), until=until, limited=limited), "records")
    fetched = upsert_threats(records, collection, encoder) > 0
    highest = records.agg(iso_utc(F.max(F.try_to_timestamp("last_modified")))).first()[0] if fetched else None
    if highest:
        watermark.save(highest)
    return fetched
