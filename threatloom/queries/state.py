"""Queries over stored and streamed state, and the span join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.operators.range_join import first_point_in_span
from threatloom.queries.standins import feed, table
from threatloom.queries.threats import STORED_SQL, stored_threats
from threatloom.schemas import CVE_POINT
from threatloom.session import open_folders, run_dir
from threatloom.sources.collection import Collection
from threatloom.streaming.ingest import feed_stream, run_available


def upsert_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, with line items as a batch of changes: some replace an order, some are new, many share a key."""
    base = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"),
        F.lit(None).cast("timestamp_ntz").alias("shipped"), F.lit(0).alias("line"),
    )
    updates = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") + 7000).alias("id"), F.col("l_extendedprice").alias("price"),
        F.col("l_linestatus").alias("status"), F.col("l_shipdate").alias("shipped"), F.col("l_linenumber").alias("line"),
    )
    # three deliveries in no order of time
    collection = Collection(spark, run_dir(spark, "orders"), updates.schema)
    collection.create()
    state = F.struct("shipped", "line", "price", "status")
    collection.upsert(base, unique=True, stored=True)
    for part in range(3):
        some = updates.where(F.expr(f"pmod(hash(price, line), 3) = {part}"))
        collection.upsert(some, newest=[state.desc()], state=state)
    return collection.read().select("id", "price", "status")


UPSERT_BY_ID = """
    WITH latest AS (SELECT id, price, status FROM (
        SELECT l_orderkey + 7000 AS id, l_extendedprice AS price, l_linestatus AS status,
               row_number() OVER (PARTITION BY l_orderkey
                   ORDER BY l_shipdate DESC, l_linenumber DESC, l_extendedprice DESC, l_linestatus DESC) AS rn
        FROM lineitem) WHERE rn = 1)
    SELECT * FROM latest UNION ALL
    SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT id FROM latest)"""

_HOUR = 3_600_000_000
_MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"


def range_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event the same user's first purchase within six hours."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.expr(_MICROS).alias("at"))
    spans = events.select("event_id", "user_id", "at", (F.col("at") + 6 * _HOUR).alias("until"))
    points = events.where(F.col("event_type") == "purchase").select(
        "user_id", F.col("at").alias("bought_at"), F.col("event_id").alias("purchase_id")
    )
    first = first_point_in_span(
        spans, points, ["user_id"], start="at", end="until", position="bought_at", value=["purchase_id"],
        bin_rows=20_000,
    )
    return first.select("event_id", "purchase_id", (F.col("bought_at") - F.col("at")).alias("waited"))


RANGE_FIRST = f"""SELECT event_id, purchase_id, waited FROM (
    SELECT e.event_id, p.event_id AS purchase_id, epoch_us(p.ts) - epoch_us(e.ts) AS waited,
           row_number() OVER (PARTITION BY e.event_id ORDER BY p.ts, p.event_id) AS rn
    FROM events e JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase'
     AND p.ts >= e.ts AND epoch_us(p.ts) < epoch_us(e.ts) + {6 * _HOUR}) WHERE rn = 1"""


#: Micro-batches of the stream, about, and records of a landed file.
_TURNS, _FILE_RECORDS = 4, 100_000


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed landed in files in no order of time, with broken lines and records without an id, read in four turns or so.

    A turn takes one file, or as many as it needs for files of a bounded number of records.
    """
    root = run_dir(spark, "stream")
    records = feed(spark, sf_dir, heavy=True)
    of_turn = max(1, -(-table(spark, sf_dir, "events").count() // (_TURNS * _FILE_RECORDS)))
    files = _TURNS * of_turn
    line, dealt = F.to_json(F.struct("*")), F.pmod(F.hash("id", "published", "lastModified"), F.lit(files))
    lines = records.select(line.alias("line"), dealt.alias("file"), F.to_json(F.struct(*records.columns[1:])).alias("nameless"))
    odd = F.pmod(F.hash("line"), F.lit(10))
    # besides every line, one in ten once more without its id and one in ten cut short
    extra = F.when(odd == 0, F.array("nameless")).when(odd == 1, F.array(F.expr("left(line, length(line) - 1)")))
    landed = lines.select("file", F.explode(F.concat(F.array("line"), F.coalesce(extra, F.array().cast("array<string>")))).alias("value"))
    # one file for each, written as its lines come: sorted by file, a task would hold all it writes
    with open_folders(spark, files):
        landed.repartition(files, "file").write.partitionBy("file").text(f"{root}/landed")
    collection = Collection(spark, f"{root}/collection", CVE_POINT)
    run_available(feed_stream(spark, f"{root}/landed/*", max_files=of_turn), collection, f"{root}/checkpoint")
    return stored_threats(collection.read())


QUERIES = {
    "upsert_by_id": (upsert_by_id, UPSERT_BY_ID),
    "range_first": (range_first, RANGE_FIRST),
    "stream_ingest": (stream_ingest, STORED_SQL),
}
