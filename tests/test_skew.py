"""A third of all rows on one key: results stay whole and the hot key is cut down before it meets one task."""

import pytest
from pyspark.sql import functions as F

from threatloom.operators.dedup import first_wins, limit_per_group
from threatloom.operators.embed import embed_text
from threatloom.operators.enrich import attach_matches
from threatloom.operators.knn import knn_join
from threatloom.sources.collection import Collection
from threatloom.operators import range_join
from threatloom.operators.range_join import first_point_in_span

ROWS = 120_000


@pytest.fixture(scope="module")
def hot(spark):
    """(key, id): key 0 holds a third of the rows."""
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1000 + 1)
    return spark.range(ROWS, numPartitions=8).select(key.alias("key"), "id").cache()


def shuffled_rows(df):
    """Rows written by each shuffle of the executed plan."""
    df.collect()
    found = []

    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in node.nodeName():
            return walk(node.plan())
        if node.nodeName() == "Exchange":
            found.append(node.metrics().get("shuffleRecordsWritten").get().value())
        children = node.children()
        for at in range(children.size()):
            walk(children.apply(at))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_first_wins_moves_one_row_per_key_and_partition(hot):
    kept = first_wins(hot, ["key"], ["id"])
    keys = hot.select("key").distinct().count()
    assert kept.count() == keys
    assert kept.where("key = 0").first().id == 0
    assert max(shuffled_rows(kept)) <= 8 * keys


def test_limit_moves_few_rows_of_the_hot_group(hot):
    kept = limit_per_group(hot, ["key"], [F.col("id").desc()], 10, salts=4)
    hot_rows = [r.id for r in kept.where("key = 0").collect()]
    assert sorted(hot_rows) == [i for i in range(ROWS) if i % 3 == 0][-10:]
    assert max(shuffled_rows(kept)) < ROWS


def test_upsert_of_a_key_changed_very_often(spark, hot, tmp_path):
    base = spark.range(2000).select(F.col("id").alias("key"), F.lit(-1).cast("long").alias("id"))
    collection = Collection(spark, str(tmp_path / "c"), base.schema, key="key")
    collection.create()
    collection.upsert(base, unique=True)
    collection.upsert(hot.select("key", "id"), newest=[F.col("id").desc()])
    merged = {r.key: r.id for r in collection.read().collect()}
    newest = {r.key: r.id for r in hot.groupBy("key").agg(F.max("id").alias("id")).collect()}
    assert merged == {**{k: -1 for k in range(2000)}, **newest}


def test_span_join_on_a_hot_key(hot):
    points = hot.select("key", F.col("id").alias("at"), F.col("id").alias("name")).where("id % 2 = 0")
    spans = hot.select("key", "id", F.col("id").alias("a"), (F.col("id") + 7).alias("b"))
    found = first_point_in_span(
        spans, points, ["key"], start="a", end="b", position="at", value=["name"], bin_rows=5000
    )
    # ids of the hot key go up in threes, so the next even one is at most three away; other keys only hit themselves
    rows = found.select("key", "id", "at").collect()
    assert len(rows) == sum(1 for i in range(ROWS) if i % 3 == 0 and (i % 2 == 0 or i + 3 < ROWS)) + sum(
        1 for i in range(ROWS) if i % 3 and i % 2 == 0
    )
    assert all(r.at == r.id if r.id % 2 == 0 else r.at == r.id + 3 for r in rows)


def test_bins_of_one_key_are_bounded(spark):
    """A hundred thousand points of one key, most of them close together: no bin holds many more rows than the bound."""
    at = F.when(F.col("id") < 90_000, F.col("id")).otherwise(F.col("id") * 1_000_000)
    points = spark.range(100_000).select(F.lit("k").alias("key"), at.alias("at"), F.col("id").alias("name"))
    spans = points.where("name % 10 = 0").select("key", (F.col("at") - 3).alias("a"), (F.col("at") + 1).alias("b"))
    binned = range_join._binned(
        spans.select("key", F.col("a").alias("__pos")),
        points.select("key", F.col("at").alias("__pos"), F.struct("at", "name").alias("__point")), ["key"], 22,
    )
    sizes = [r["count"] for r in binned.groupBy("__bin").count().collect()]
    assert sum(sizes) == 110_000 and len(sizes) >= 20 and max(sizes) <= 2 * 5_000
    found = first_point_in_span(
        spans, points, ["key"], start="a", end="b", position="at", value=["name"], bin_rows=5_000
    )
    # three below a point lies another one, but for the first and those far apart
    rows = {r.b - 1: r.at for r in found.collect()}
    assert len(rows) == 10_000
    assert all(hit == (max(p - 3, 0) if p < 90_000 else p) for p, hit in rows.items())


@pytest.mark.parametrize("options", [{}, {"broadcast_cells": 1, "cells": 5}])
def test_knn_in_a_collection_of_copies(spark, options):
    copies = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(
            F.array(F.lit(0.0), (F.col("id") + 1).cast("double"))
        ).cast("array<float>").alias("embedding")
    )
    queries = spark.createDataFrame([(7, [3.0, 0.0])], "query_id long, embedding array<float>")
    rows = knn_join(queries, copies, 4, **options).orderBy("rank").collect()
    assert [(r.id, r.score) for r in rows] == [(0, 1.0), (3, 1.0), (6, 1.0), (9, 1.0)]


def test_findings_sharing_one_description(spark):
    findings = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "buffer overflow").otherwise(F.concat(F.lit("word"), F.col("id") % 50)).alias("description")
    )
    rows = spark.createDataFrame([(1, "a buffer overflow"), (2, "word7"), (3, "race")], "id long, text string")
    collection = embed_text(rows, "text").select("id", "embedding", F.struct("text").alias("payload"))
    matched = attach_matches(findings, collection, k=1)
    assert matched.count() == 3000
    best = matched.groupBy("description").agg(F.collect_set(F.col("cve_matches.text")[0]).alias("best"))
    assert {r.description: r.best for r in best.collect()}["buffer overflow"] == ["a buffer overflow"]
