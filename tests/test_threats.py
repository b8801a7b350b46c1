"""CVE feed, query matching, ingestion and its state."""

import json
from datetime import timedelta

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from threatloom.operators.match import by_target, limit_queries, matched_queries, modified_between, query_ranks
from threatloom.plans.threats import ingest_threats, threat_records
from threatloom.schemas import CVE_FEED, CVE_POINT
from threatloom.sources.collection import Collection
from threatloom.sources.dimensions import target_cwes
from threatloom.sources.feed import flatten_cves, read_feed, with_text
from threatloom.sources.state import Watermark
from threatloom.streaming.ingest import feed_stream, run_available


def cve(name, description="A buffer overflow", score=("V31", "CRITICAL", "9.8"), cwes=("CWE-120",), cpes=0, modified="2024-01-01"):
    record = {"id": name, "published": "2023-12-01", "lastModified": modified}
    if description is not None:
        record["descriptions"] = [{"lang": "en", "value": description}, {"lang": "fr", "value": "autre"}]
    if score is not None:
        record["score"] = list(score)
    record["cwe"] = [{"value": c} for c in cwes]
    record["cpe"] = [{"criteria": f"cpe:{i}"} for i in range(cpes)]
    return record


RECORDS = [
    cve("CVE-1", cwes=("CWE-120", "CWE-119", "CWE-79"), cpes=7),
    cve("CVE-2", description=None),
    cve("CVE-3", description=""),
    cve("CVE-4", score=None),
    cve("CVE-5", score=("V31",), cwes=()),
    cve("CVE-6", description="BUFFER OverFlow and use after free", cwes=()),
    cve("CVE-7", cwes=("CWE-79",), score=("V31", "LOW", "x")),
]


def land(path, records, extra=""):
    path.mkdir(parents=True, exist_ok=True)
    count = len(list(path.iterdir()))
    (path / f"part-{count}.json").write_text("\n".join(json.dumps(r) for r in records) + "\n" + extra)
    return str(path)


@pytest.fixture(scope="module")
def flat(spark, tmp_path_factory):
    return flatten_cves(read_feed(spark, land(tmp_path_factory.mktemp("feed") / "f", RECORDS, '{"id": "CVE-8", "desc')))


def test_flatten(flat):
    rows = {r.cve_id: r for r in flat.collect()}
    assert set(rows) == {"CVE-1", "CVE-4", "CVE-5", "CVE-6", "CVE-7"}
    assert rows["CVE-1"].description == "A buffer overflow"
    assert (rows["CVE-1"].severity, rows["CVE-1"].cvss_score) == ("CRITICAL", 9.8)
    assert rows["CVE-1"].cpe == [f"cpe:{i}" for i in range(5)]
    for name in ("CVE-4", "CVE-5"):
        assert (rows[name].severity, rows[name].cvss_score) == ("UNKNOWN", None)
    assert (rows["CVE-7"].severity, rows["CVE-7"].cvss_score) == ("LOW", None)


def test_text(flat):
    rows = {r.cve_id: r.text for r in with_text(flat).collect()}
    assert rows["CVE-1"] == "CVE-1: A buffer overflow Weakness: CWE-120, CWE-119, CWE-79."
    assert rows["CVE-5"] == "CVE-5: A buffer overflow"


def test_matches(flat, spark):
    ranks = flat.select("cve_id", query_ranks(F.col("cwe_ids"), F.col("description"), F.col("severity")).alias("r"))
    # weaknesses first, then keyword groups; the severity has to agree too
    assert {r.cve_id: r.r for r in ranks.collect()} == {
        "CVE-1": [0, 1, 15], "CVE-4": [1], "CVE-5": [], "CVE-6": [15, 16], "CVE-7": [],
    }
    assert matched_queries(flat).count() == 6
    tagged = by_target(flat, "cwe_ids", target_cwes(spark)).select("cve_id", "cwe_id").collect()
    assert {tuple(r) for r in tagged} == {("CVE-1", "CWE-120"), ("CVE-1", "CWE-119"), ("CVE-4", "CWE-120")}


def test_records_are_first_wins_by_cve(flat, spark):
    again = [cve("CVE-1", description="newer", modified="2024-02-01")]
    feed = spark.createDataFrame(RECORDS + again, CVE_FEED)
    rows = {r.cve_id: r for r in threat_records(feed).collect()}
    assert set(rows) == {"CVE-1", "CVE-4", "CVE-6"}
    assert rows["CVE-1"].description == "newer"
    assert {r.cve_id for r in threat_records(feed, limited=True).collect()} == set(rows)


def test_limits(spark):
    rows = spark.range(700).select(F.format_string("CVE-%04d", "id").alias("cve_id"), (F.col("id") * 0).cast("int").alias("query_rank"))
    both = rows.unionByName(rows.withColumn("query_rank", F.lit(15)))
    kept = limit_queries(both, ["cve_id"]).groupBy("query_rank").count().collect()
    assert {r.query_rank: r["count"] for r in kept} == {0: 500, 15: 200}


def test_modified_between_keeps_both_ends(spark):
    moments = ["2024-01-01", "2024-01-02T00:00:00", "2024-01-02T10:00:00+14:00", "2024-01-03 00:00:00.000Z", "2024-01-03T00:00:01", "", "x", None]
    df = spark.createDataFrame([(m,) for m in moments], "m string")
    kept = modified_between(df, "m", "2024-01-02", "2024-01-03").collect()
    assert sorted(r.m for r in kept) == ["2024-01-02T00:00:00", "2024-01-03 00:00:00.000Z"]
    kept = modified_between(df, "m", "2024-01-01T20:00:00Z").collect()
    assert sorted(r.m for r in kept) == sorted([moments[1], moments[2], moments[3], moments[4]])
    assert modified_between(df, "m", None).count() == len(moments)


def test_watermark(spark, tmp_path):
    mark = Watermark(spark, str(tmp_path / "w"))
    assert mark.read() is None
    mark.save("2024-01-01T00:00:00")
    mark.save("2024-03-01T00:00:00")
    assert mark.read() == "2024-03-01T00:00:00"
    mark.save()
    assert mark.read() > "2024-03-01" and mark.read().endswith("+00:00")


def test_ingestion_in_runs_equals_full_load(spark, tmp_path):
    early = [cve(f"CVE-{i}", modified="2024-01-01") for i in range(20)]
    late = [cve(f"CVE-{i}", description="changed buffer overflow", modified="2024-02-01") for i in range(15, 25)]
    collection = Collection(spark, str(tmp_path / "c"), CVE_POINT)
    mark = Watermark(spark, str(tmp_path / "w"))
    assert ingest_threats(spark.createDataFrame(early, CVE_FEED), collection, mark)
    assert mark.read() == "2024-01-01T00:00:00.000000" and mark.since() == "2023-12-31T00:00:00.000000"
    feed = spark.createDataFrame(early + late, CVE_FEED)
    assert ingest_threats(feed, collection, mark, until="2024-02-15")
    assert not ingest_threats(feed, collection, mark, until="2024-03-01")
    assert mark.read() == "2024-02-01T00:00:00.000000"
    whole = Collection(spark, str(tmp_path / "whole"), CVE_POINT)
    ingest_threats(feed, whole, Watermark(spark, str(tmp_path / "w2")))
    assert collection.read().exceptAll(whole.read()).count() == 0
    assert collection.read().count() == whole.read().count() == 25


def test_a_record_that_lands_late_is_read(spark, tmp_path):
    mark = Watermark(spark, str(tmp_path / "w"), overlap=timedelta(hours=6))
    collection = Collection(spark, str(tmp_path / "c"), CVE_POINT)
    first = [cve("CVE-1", modified="2024-01-02T12:00:00Z")]
    landed = [cve("CVE-2", modified="2024-01-02T07:00:00"), cve("CVE-3", modified="2024-01-02T05:00:00")]
    assert ingest_threats(spark.createDataFrame(first, CVE_FEED), collection, mark)
    assert ingest_threats(spark.createDataFrame(first + landed, CVE_FEED), collection, mark)
    # modified five hours before the highest record: within the overlap; seven hours before: not
    assert {r.cve_id for r in collection.read().select("payload.*").collect()} == {"CVE-1", "CVE-2"}


def test_newest_state_by_time_not_by_text(spark):
    states = [cve("CVE-1", "A buffer overflow, older", modified="2024-01-02T01:00:00+14:00"),
              cve("CVE-1", "A buffer overflow, newer", modified="2024-01-01T23:00:00Z"),
              cve("CVE-2", "A buffer overflow, dated", modified="2020-01-01"),
              cve("CVE-2", "A buffer overflow, undated", modified="someday")]
    rows = {r.cve_id: r.description for r in threat_records(spark.createDataFrame(states, CVE_FEED)).collect()}
    assert rows == {"CVE-1": "A buffer overflow, newer", "CVE-2": "A buffer overflow, dated"}


def test_nothing_fetched_leaves_the_watermark(spark, tmp_path):
    mark = Watermark(spark, str(tmp_path / "w"))
    collection = Collection(spark, str(tmp_path / "c"), CVE_POINT)
    assert not ingest_threats(spark.createDataFrame([cve("CVE-5", cwes=(), description="x")], CVE_FEED), collection, mark)
    assert mark.read() is None
    assert collection.read().count() == 0


def test_stream_sees_only_new_files(spark, tmp_path):
    path = land(tmp_path / "landed", [cve("CVE-1"), cve("CVE-2")])
    collection = Collection(spark, str(tmp_path / "c"), CVE_POINT)
    checkpoint = str(tmp_path / "checkpoint")
    run_available(feed_stream(spark, path), collection, checkpoint)
    assert collection.read().count() == 2
    land(tmp_path / "landed", [cve("CVE-2", description="new buffer overflow", modified="2024-02-01"), cve("CVE-3")])
    run_available(feed_stream(spark, path), collection, checkpoint)
    rows = {r.cve_id: r.description for r in collection.read().select("payload.*").collect()}
    assert rows == {"CVE-1": "A buffer overflow", "CVE-2": "new buffer overflow", "CVE-3": "A buffer overflow"}
    run_available(feed_stream(spark, path), collection, checkpoint)
    assert collection.read().count() == 3


@pytest.mark.parametrize("splits", [1, 2, 5])
def test_stream_of_any_splits_gives_the_batch(spark, tmp_path, splits):
    states = [cve(f"CVE-{n % 7}", f"A buffer overflow, state {n}", modified=f"2024-01-{(n * 11) % 28 + 1:02}T{n % 24:02}:00:00")
              for n in range(40)]
    folder = tmp_path / "feed"
    for at in range(splits):
        land(folder, states[at::splits], "not a line")
    collection = Collection(spark, str(tmp_path / "c"), CVE_POINT, buckets=2)
    run_available(feed_stream(spark, str(folder), max_files=1), collection, str(tmp_path / "checkpoint"))
    want = {r.cve_id: r.description for r in threat_records(spark.createDataFrame(states, CVE_FEED)).collect()}
    assert {r.cve_id: r.description for r in collection.read().select("payload.*").collect()} == want


def test_stream_leaves_newer_states_of_batches(spark, tmp_path):
    collection = Collection(spark, str(tmp_path / "c"), CVE_POINT)
    newer = [cve("CVE-1", "A buffer overflow, by batch", modified="2024-05-01")]
    ingest_threats(spark.createDataFrame(newer, CVE_FEED), collection, Watermark(spark, str(tmp_path / "w")))
    path = land(tmp_path / "landed", [cve("CVE-1", modified="2024-02-01"), cve("CVE-2")])
    run_available(feed_stream(spark, path), collection, str(tmp_path / "checkpoint"))
    rows = {r.cve_id: r.description for r in collection.read().select("payload.*").collect()}
    assert rows == {"CVE-1": "A buffer overflow, by batch", "CVE-2": "A buffer overflow"}


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 2, 0)])
def test_stream_gives_the_full_load_in_any_order(spark, tmp_path, order):
    states = [
        [cve("CVE-1", "A buffer overflow, first", modified="2024-01-01T00:00:00"), cve("CVE-2", modified="2024-02-01T00:00:00")],
        [cve("CVE-1", "A buffer overflow, last", modified="2024-05-01T00:00:00"), {**cve("CVE-3"), "id": None}],
        [cve("CVE-1", "A buffer overflow, between", modified="2024-02-01T00:00:00"), cve("CVE-4")],
    ]
    folder = tmp_path / "feed"
    folder.mkdir()
    collection = Collection(spark, str(tmp_path / "c"), CVE_POINT, buckets=2)
    for n, at in enumerate(order):
        lines = [json.dumps(r) for r in states[at]] + ['{"id": "CVE-9", "desc']
        (folder / f"{n}.json").write_text("\n".join(lines))
        run_available(feed_stream(spark, str(folder), max_files=1), collection, str(tmp_path / "checkpoint"))
    stored = {r.cve_id: r.description for r in collection.read().select("payload.*").collect()}
    full = Collection(spark, str(tmp_path / "full"), CVE_POINT)
    ingest_threats(read_feed(spark, str(folder)), full, Watermark(spark, str(tmp_path / "w")))
    assert stored == {r.cve_id: r.description for r in full.read().select("payload.*").collect()}
    assert stored["CVE-1"] == "A buffer overflow, last" and set(stored) == {"CVE-1", "CVE-2", "CVE-4"}


def test_lines_put_aside_are_kept_and_counted(spark, tmp_path):
    path = land(tmp_path / "feed", [cve("CVE-1"), cve("CVE-2"), {**cve("CVE-3"), "id": None}], '{"id": "CVE-4", "desc\nnonsense\n')
    seen = Observation()
    feed = read_feed(spark, path, quarantine=str(tmp_path / "aside"), seen=seen)
    assert {r.id for r in feed.collect()} == {"CVE-1", "CVE-2"}
    assert seen.get == {"rows": 5, "malformed": 2, "nameless": 1}
    aside = {(r.reason, r.line) for r in spark.read.json(str(tmp_path / "aside")).collect()}
    assert {line for reason, line in aside if reason == "malformed"} == {'{"id": "CVE-4", "desc', "nonsense"}
    [(_, record)] = [a for a in aside if a[0] == "without id"]
    assert json.loads(record)["lastModified"] == "2024-01-01" and len(aside) == 3


def test_feed_columns_are_computed_once(spark, sf_dir):
    """What a record's fields are made of stands once in the plan, however often flattening and matching read them."""
    from threatloom.plans.threats import answering
    from threatloom.queries.standins import feed

    plan = answering(feed(spark, sf_dir, heavy=True))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 1


def test_first_query_is_the_least_rank(spark, sf_dir):
    from threatloom.operators.match import first_query, query_ranks
    from threatloom.queries.standins import feed
    from threatloom.sources.feed import flatten_cves

    columns = [F.col("cwe_ids"), F.col("description"), F.col("severity")]
    flat = flatten_cves(feed(spark, sf_dir))
    odd = flat.limit(3).withColumns({"cwe_ids": F.array(F.lit(None).cast("string")), "severity": F.lit(None).cast("string")})
    both = flat.unionByName(odd).select(first_query(*columns).alias("first"), query_ranks(*columns).alias("ranks"))
    assert both.where(~F.col("first").eqNullSafe(F.get("ranks", F.lit(0)))).count() == 0
    assert both.where("first IS NULL").count() >= 3 and both.where("first > 0").count()
