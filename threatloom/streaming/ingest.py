"""Incremental threat ingestion as a file stream.

The stream's checkpoint takes the place of the time-window watermark: each run
sees exactly the files that arrived since the last one, so records changed
while a run is under way are not missed.

The newest state of each CVE is kept by the stream itself, in the state of a streaming aggregation. Each micro-batch gives
the CVEs it touched, in their newest state, and these are upserted into the buckets they belong to: nothing is joined with
the collection as a whole. The state is as large as the records; with many of them set
`spark.sql.streaming.stateStore.providerClass` to the RocksDB provider.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.operators.embed import Encoder, hashed_tokens
from threatloom.plans.threats import answering, record_order, upsert_threats
from threatloom.session import stored
from threatloom.sources.collection import Collection
from threatloom.sources.feed import FEED_LINES, well_formed, with_id


def feed_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Landed JSON-lines files as a stream of raw CVE records, well-formed ones as in a batch."""
    lines = spark.readStream.schema(FEED_LINES).option("maxFilesPerTrigger", max_files).option("mode", "PERMISSIVE")
    return well_formed(lines.json(path))


def newest_records(stream: DataFrame) -> DataFrame:
    """The newest state of each CVE that answers a query, by the rules of a batch; keyed streaming state.

    In update mode a micro-batch gives the CVEs it has met, also where their newest state came before.
    """
    matched = answering(stream)
    newest = F.min_by(F.struct(*matched.columns), F.struct(*record_order())).alias("record")
    return with_id(matched.groupBy("cve_id").agg(newest).select("record.*"))


def run_available(
    stream: DataFrame,
    collection: Collection,
    checkpoint: str,
    *,
    encoder: Callable[[], Encoder] = hashed_tokens,
) -> None:
    """Ingest everything that has arrived, then stop.

    The last modified state of a CVE wins, in whatever order its states are delivered, also against states that
    batch runs have stored. A micro-batch repeated after a failure changes nothing.
    """
    collection.create()

    def apply(records: DataFrame, batch_id: int) -> None:
        # what the stream gives is computed once for each action
        upsert_threats(stored(records, "records"), collection, encoder)

    query = (
        newest_records(stream).writeStream.outputMode("update").foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
