"""CVE-feed queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from threatloom.constants import KEYWORD_GROUPS, TARGET_CWES
from threatloom.functions.templates import cve_text
from threatloom.functions.text import iso_utc
from threatloom.operators.dedup import first_wins, limit_per_group
from threatloom.operators.match import by_target, keyword_matches, matched_queries, modified_between
from threatloom.operators.match import limit_queries as limit_feed_queries
from threatloom.plans.threats import ingest_threats
from threatloom.queries.snippets import sql_record_id
from threatloom.queries.standins import FEED, FLAT_CVES_SQL, FLAT_MIXED_SQL, MIXED_FEED, feed, nested_feed, table
from threatloom.schemas import CVE_POINT
from threatloom.session import run_dir
from threatloom.sources.collection import Collection
from threatloom.sources.dimensions import keyword_groups, target_cwes
from threatloom.sources.feed import flatten_cves, read_feed
from threatloom.sources.state import Watermark

_SHOWN_SQL = """cve_id, description, cvss_score, severity, array_to_string(cwe_ids, ',') AS cwe_ids,
        array_to_string(cpe, ',') AS cpe, published, last_modified"""


def _shown(cves: DataFrame) -> DataFrame:
    return cves.select(
        "cve_id", "description", "cvss_score", "severity", F.array_join("cwe_ids", ",").alias("cwe_ids"),
        F.array_join("cpe", ",").alias("cpe"), "published", "last_modified",
    )


def cve_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lands the feed as JSON lines, some of them cut short, and reads it back."""
    path = run_dir(spark, "feed")
    lines = nested_feed(FEED.frame(spark, sf_dir)).select(F.to_json(F.struct("*")).alias("line"), "published")
    broken = F.col("published").endswith("7")
    cut = F.when(broken, F.expr("left(line, length(line) - 1)")).otherwise(F.col("line"))
    lines.select(cut.alias("value")).write.text(path)
    return _shown(flatten_cves(read_feed(spark, path)))


CVE_FEED = f"SELECT {_SHOWN_SQL} FROM {FLAT_CVES_SQL} WHERE published NOT LIKE '%7'"


def feed_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed with lines cut short and records without an id: what is put aside, and why; the rest is counted as it is read."""
    root = run_dir(spark, "rejects")
    records = nested_feed(FEED.frame(spark, sf_dir))
    last = F.right("published", F.lit(1))
    line = F.to_json(F.struct("*"))
    nameless = F.to_json(F.struct(*records.columns[1:]))
    landed = F.when(last == "7", F.expr("left(line, length(line) - 1)")).when(last == "8", F.col("nameless")).otherwise(F.col("line"))
    lines = records.select(line.alias("line"), nameless.alias("nameless"), "published", last.alias("last"))
    lines.select(landed.alias("value")).write.text(f"{root}/feed")
    seen = Observation()
    kept = read_feed(spark, f"{root}/feed", quarantine=f"{root}/rejects", seen=seen)
    kept.write.format("noop").mode("overwrite").save()
    aside = spark.read.schema("reason string, line string").json(f"{root}/rejects").groupBy("reason").agg(F.count("*").alias("n"))
    counts = seen.get
    observed = [("lines", counts["rows"]), ("lines malformed", counts["malformed"]), ("lines without id", counts["nameless"])]
    return aside.unionByName(spark.createDataFrame(observed, "reason string, n long"))


_LANDED = f"(SELECT right(modified, 1) AS last FROM {FEED.sql()})"
FEED_REJECTS = f"""SELECT 'malformed' AS reason, count(*) AS n FROM {_LANDED} WHERE last = '7' HAVING n > 0
    UNION ALL SELECT 'without id', count(*) AS n FROM {_LANDED} WHERE last = '8' HAVING n > 0
    UNION ALL SELECT 'lines', count(*) FROM {_LANDED}
    UNION ALL SELECT 'lines malformed', count(*) FROM {_LANDED} WHERE last = '7'
    UNION ALL SELECT 'lines without id', count(*) FROM {_LANDED} WHERE last = '8'"""


def cve_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(flatten_cves(feed(spark, sf_dir)))


CVE_FLATTEN = f"SELECT {_SHOWN_SQL} FROM {FLAT_CVES_SQL}"


def cve_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = flatten_cves(feed(spark, sf_dir))
    text = cve_text(F.col("cve_id"), F.col("description"), F.col("cwe_ids"))
    return flat.select("cve_id", "last_modified", text.alias("text"))


_TEXT_SQL = """cve_id || ': ' || description || CASE WHEN len(cwe_ids) > 0
        THEN ' Weakness: ' || array_to_string(cwe_ids, ', ') || '.' ELSE '' END"""
CVE_TEXT = f"SELECT cve_id, last_modified, {_TEXT_SQL} AS text FROM {FLAT_CVES_SQL}"


def by_target_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = flatten_cves(feed(spark, sf_dir)).select("cve_id", "last_modified", "cwe_ids")
    return by_target(flat, "cwe_ids", target_cwes(spark)).select("cve_id", "last_modified", "cwe_id", "query_rank")


_TARGET_ROWS = "(VALUES " + ", ".join(f"('{cwe}', {rank})" for rank, cwe in enumerate(TARGET_CWES)) + ")"
_KEYWORD_ROWS = "(VALUES " + ", ".join(
    f"('{phrase}', '{severity}', {len(TARGET_CWES) + rank})" for rank, (phrase, severity) in enumerate(KEYWORD_GROUPS)
) + ")"
BY_TARGET = f"""SELECT cve_id, last_modified, t.cwe_id, t.query_rank
    FROM {FLAT_CVES_SQL} c JOIN {_TARGET_ROWS} t(cwe_id, query_rank) ON list_contains(c.cwe_ids, t.cwe_id)"""


def keyword_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = flatten_cves(feed(spark, sf_dir)).select("cve_id", "last_modified", "description", "severity")
    return keyword_matches(flat, keyword_groups(spark)).select("cve_id", "last_modified", "keyword", "query_rank")


KEYWORD_MATCH = f"""SELECT cve_id, last_modified, keyword, query_rank
    FROM {FLAT_CVES_SQL} c JOIN {_KEYWORD_ROWS} k(keyword, wanted, query_rank)
      ON c.severity = k.wanted AND contains(lower(c.description), k.keyword)"""


def incremental_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window over moments written in several forms and zones."""
    flat = _shown(flatten_cves(feed(spark, sf_dir, MIXED_FEED)))
    return modified_between(flat, "last_modified", "2024-01-10T00:00:00", "2024-01-20T12:00:00")


INCREMENTAL_SINCE = f"""SELECT {_SHOWN_SQL} FROM {FLAT_MIXED_SQL}
    WHERE modified_at BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'"""


def incremental_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No run was recorded yet: everything is read."""
    last_run = Watermark(spark, run_dir(spark, "watermark")).read()
    return modified_between(_shown(flatten_cves(feed(spark, sf_dir))), "last_modified", last_run)


def union_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = matched_queries(flatten_cves(feed(spark, sf_dir)))
    return matched.select("cve_id", "last_modified", F.col("query_rank").cast("int").alias("query_rank"))


def _matched_sql(flat: str) -> str:
    return f"""(
    SELECT c.*, t.query_rank FROM {flat} c
    JOIN {_TARGET_ROWS} t(cwe_id, query_rank) ON list_contains(c.cwe_ids, t.cwe_id)
    UNION ALL
    SELECT c.*, k.query_rank FROM {flat} c
    JOIN {_KEYWORD_ROWS} k(keyword, wanted, query_rank)
      ON c.severity = k.wanted AND contains(lower(c.description), k.keyword))"""


_MATCHED = _matched_sql(FLAT_CVES_SQL)
UNION_QUERIES = f"SELECT cve_id, last_modified, query_rank FROM {_MATCHED}"


def dedup_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = matched_queries(flatten_cves(feed(spark, sf_dir, heavy=True)))
    first = first_wins(matched, ["cve_id"], ["query_rank", "published"])
    return _shown(first)


DEDUP_KEY = f"""SELECT {_SHOWN_SQL} FROM (
    SELECT *, row_number() OVER (PARTITION BY cve_id ORDER BY query_rank, published) AS rn FROM {_MATCHED})
    WHERE rn = 1"""


def limit_per_group_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    order = [F.col("o_totalprice").desc(), "o_orderkey"]
    return limit_per_group(orders, ["o_orderpriority"], order, 500, rank_name="position", salts=16)


LIMIT_PER_GROUP = """SELECT o_orderkey, o_orderpriority, o_totalprice, cast(rn AS INTEGER) AS position FROM (
    SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn
    FROM orders) WHERE rn <= 500"""


def limit_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = matched_queries(flatten_cves(feed(spark, sf_dir)))
    kept = limit_feed_queries(matched, ["published", "cve_id"])
    return kept.select("cve_id", "published", F.col("query_rank").cast("int").alias("query_rank"))


LIMIT_QUERIES = f"""SELECT cve_id, published, query_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_rank ORDER BY published, cve_id) AS rn FROM {_MATCHED})
    WHERE rn <= CASE WHEN query_rank < {len(TARGET_CWES)} THEN 500 ELSE 200 END"""


def iso_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(F.col("event_id").cast("string").alias("event_id"), iso_utc(F.col("ts")).alias("iso"))


ISO_TIMESTAMP = """SELECT cast(event_id AS VARCHAR) AS event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso
    FROM events"""


def stored_threats(collection: DataFrame) -> DataFrame:
    """What the collection holds, with the size of each vector."""
    rows = collection.select("id", F.size("embedding").alias("dims"), "payload.*")
    return _shown_with_id(rows)


def _shown_with_id(rows: DataFrame) -> DataFrame:
    return rows.select(
        "id", "dims", "cve_id", "description", "cvss_score", "severity",
        F.array_join("cwe_ids", ",").alias("cwe_ids"), F.array_join("cpe", ",").alias("cpe"),
        "published", "last_modified",
    )


def threat_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full ingestion run into a new collection, read back."""
    root = run_dir(spark, "threats")
    collection = Collection(spark, f"{root}/collection", CVE_POINT)
    ingest_threats(feed(spark, sf_dir, heavy=True), collection, Watermark(spark, f"{root}/watermark"))
    return stored_threats(collection.read())


def incremental_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run up to a moment and one from the watermark it saved: together a full load. Moments are in several forms."""
    root = run_dir(spark, "runs")
    collection, mark = Collection(spark, f"{root}/collection", CVE_POINT), Watermark(spark, f"{root}/watermark")
    landed = feed(spark, sf_dir, MIXED_FEED, heavy=True)
    ingest_threats(modified_between(landed, "lastModified", "0001-01-01", "2024-01-12T00:00:00"), collection, mark)
    ingest_threats(landed, collection, mark)
    return stored_threats(collection.read())


def _rows_sql(flat: str) -> str:
    """Last state of each CVE, then the first query it answers; of CVEs sharing an id the last in feed order."""
    latest = f"""(SELECT *, {sql_record_id("cve_id")} AS id FROM (
    SELECT *, row_number() OVER (PARTITION BY cve_id ORDER BY modified_at DESC, query_rank) AS rn
    FROM {_matched_sql(flat)}) WHERE rn = 1)"""
    return f"""(SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY query_rank DESC, published DESC) AS in_id
    FROM {latest}) WHERE in_id = 1)"""


def _stored_sql(flat: str) -> str:
    return f"SELECT id, 384 AS dims, {_SHOWN_SQL} FROM {_rows_sql(flat)}"


THREAT_ROWS_SQL = _rows_sql(FLAT_CVES_SQL)
STORED_SQL = _stored_sql(FLAT_CVES_SQL)
TEXT_SQL = _TEXT_SQL


QUERIES = {
    "cve_feed": (cve_feed, CVE_FEED),
    "feed_rejects": (feed_rejects, FEED_REJECTS),
    "cve_flatten": (cve_flatten, CVE_FLATTEN),
    "cve_text": (cve_text_query, CVE_TEXT),
    "by_target": (by_target_query, BY_TARGET),
    "keyword_match": (keyword_match, KEYWORD_MATCH),
    "incremental_since": (incremental_since, INCREMENTAL_SINCE),
    "incremental_full": (incremental_full, CVE_FLATTEN),
    "union_queries": (union_queries, UNION_QUERIES),
    "dedup_key": (dedup_key, DEDUP_KEY),
    "limit_per_group": (limit_per_group_query, LIMIT_PER_GROUP),
    "limit_queries": (limit_queries, LIMIT_QUERIES),
    "iso_timestamp": (iso_timestamp, ISO_TIMESTAMP),
    "threat_ingest": (threat_ingest, STORED_SQL),
    "incremental_runs": (incremental_runs, _stored_sql(FLAT_MIXED_SQL)),
}
