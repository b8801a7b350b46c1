"""Labelled datasets, de-duplication and statistics."""

import hashlib

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.functions.text import first_usable, label_from_target, not_blank, strip, truncate
from threatloom.operators.dedup import first_wins, limit_per_group
from threatloom.operators.stats import coverage, severity_summary, severity_totals
from threatloom.plans import corpus
from threatloom.plans.corpus import build_corpus, dedup_snippets, stored_unique
from threatloom.schemas import SNIPPET_POINT
from threatloom.sources.collection import Collection
from threatloom.sources.labelled import dataset_a, dataset_b

A_SCHEMA = "row long, func string, func_before string, `CWE ID` string, target int, `CVE ID` string"
LONG = "int f(int a) { /* same first 32 characters */ "
A_ROWS = [
    (0, "", "void before(void) {}", "CWE-119,CWE-120", 1, "CVE-1"),
    (1, "\t\n  ", "kept only if func is empty", "119", 1, "CVE-2"),
    (2, "int a;", None, "119", 0, ""),
    (3, "int b;", None, "NVD-CWE-noinfo", 1, "CVE-3"),
    (4, "int c;", None, None, 1, "CVE-4"),
    (5, "int d;", None, "CWE-20", None, "CVE-5"),
    (6, "int e;", None, "CWE-20", 2, "CVE-6"),
    (7, LONG + "bad }", None, "CWE-787", 1, "CVE-7"),
    (8, LONG + "fixed }", None, "CWE-787", 0, "CVE-7"),
    (9, "x" * 511, None, "CWE-20", 0, "CVE-9"),
    (10, "y" * 512, None, "CWE-20", 0, "CVE-10"),
    (11, "z" * 513, None, "CWE-20", 0, "CVE-11"),
]


@pytest.fixture(scope="module")
def rows_a(spark):
    return dataset_a(spark.createDataFrame(A_ROWS, A_SCHEMA), row_order="row")


def test_dataset_a(rows_a):
    rows = {r.order_pos: r for r in rows_a.collect()}
    assert set(rows) == {0, 2, 7, 8, 9, 10, 11}
    assert rows[0].cwe_id == "CWE-119" and rows[0].code_snippet == "void before(void) {}"
    assert rows[2].file_path == "unknown" and rows[2].id_key == "bigvul:unknown:" + hashlib.md5(b"int a;").hexdigest()
    assert rows[10].code_snippet == "y" * 512
    assert rows[11].code_snippet == "z" * 512 + "..."


def test_versions_sharing_a_prefix(spark, rows_a):
    kept = {r.order_pos for r in dedup_snippets(rows_a).collect()}
    assert 7 in kept and 8 in kept
    short = dataset_a(spark.createDataFrame(A_ROWS, A_SCHEMA), row_order="row", id_chars=32)
    kept = {r.order_pos for r in dedup_snippets(short, "id").collect()}
    assert 7 in kept and 8 not in kept


def test_dataset_b_reads_columns_differing_in_case(spark):
    schema = T.StructType([
        T.StructField("code", T.StringType()), T.StructField("CWE", T.ArrayType(T.StringType())),
        T.StructField("cwe", T.StringType()), T.StructField("target", T.DoubleType()),
        T.StructField("CVE_ID", T.StringType()), T.StructField("cve_id", T.StringType()),
    ])
    raw = spark.createDataFrame(
        [("int a;", ["CWE-416"], "CWE-20", 1.0, None, "c1"), ("int b;", [], "CWE-20", 0.0, "C2", "c2")], schema
    )
    rows = {r.code_snippet: r for r in dataset_b(raw).collect()}
    assert (rows["int a;"].cwe_id, rows["int a;"].file_path, rows["int a;"].label) == ("CWE-416", "c1", "vulnerable")
    assert (rows["int b;"].cwe_id, rows["int b;"].file_path, rows["int b;"].label) == ("CWE-20", "C2", "safe")


def test_missing_columns(spark):
    raw = spark.createDataFrame([("int a;",)], "func string")
    assert dataset_a(raw).count() == 0
    assert raw.select(first_usable(raw, ("nope",)).alias("v")).first().v == ""


def test_text_targets_are_no_labels(spark):
    for value, kind, label in [(1, "int", "vulnerable"), (1.0, "double", "vulnerable"), (True, "boolean", "vulnerable"),
                               (0, "int", "safe"), (False, "boolean", "safe"), ("1", "string", None), (2, "int", None)]:
        raw = spark.createDataFrame([(value,)], f"target {kind}")
        assert raw.select(label_from_target(raw, ("target",)).alias("v")).first().v == label


def test_blank_and_strip_follow_unicode(spark):
    values = ["", " ", "\t\n\r", "  ", "\x1c\x1f", " a ", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.select("i", not_blank(F.col("v")).alias("ok"), strip(F.col("v")).alias("s")).orderBy("i").collect()
    assert [r.ok for r in rows] == [bool(v and v.strip()) for v in values]
    assert [r.s for r in rows] == [None if v is None else v.strip() for v in values]


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 2000])
def test_truncated_length(spark, n):
    cut = spark.range(1).select(truncate(F.lit("é" * n)).alias("v")).first().v
    assert cut == ("é" * n if n <= 512 else "é" * 512 + "...")


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_first_wins_does_not_depend_on_partitioning(spark, partitions):
    df = spark.range(2000).select((F.col("id") % 3 * (F.col("id") % 7)).alias("key"), "id")
    kept = first_wins(df.repartition(partitions), ["key"], ["id"]).collect()
    expected = {}
    for i in range(2000):
        expected.setdefault(i % 3 * (i % 7), i)
    assert {r.key: r.id for r in kept} == expected


@pytest.mark.parametrize("salts", [1, 8])
def test_limit_per_group_with_a_hot_group(spark, salts):
    df = spark.range(3000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 5).alias("g"), "id")
    rows = limit_per_group(df, ["g"], [F.col("id").desc()], 50, rank_name="r", salts=salts).collect()
    by_group = {}
    for i in range(3000):
        by_group.setdefault(0 if i < 2000 else i % 5, []).append(i)
    expected = {(g, r + 1): i for g, ids in by_group.items() for r, i in enumerate(sorted(ids, reverse=True)[:50])}
    assert {(r.g, r.r): r.id for r in rows} == expected


def test_coverage_sorts_as_text(spark):
    df = spark.createDataFrame(
        [("CWE-20", "safe"), ("CWE-119", "vulnerable"), ("CWE-78", "safe"), ("CWE-20", "vulnerable")],
        "cwe_id string, label string",
    )
    rows = [tuple(r) for r in coverage(df).orderBy("cwe_id").collect()]
    assert rows == [("CWE-119", 1, 0, 1), ("CWE-20", 1, 1, 2), ("CWE-78", 0, 1, 1)]


def test_severity_summary(spark):
    df = spark.createDataFrame([("critical",), ("HIGH",), (None,), ("INFO",)], "severity string")
    rows = {r.severity: r.n for r in severity_summary(df).collect()}
    assert rows == {"CRITICAL": 1, "HIGH": 1, "MEDIUM": 1, "LOW": 0}
    assert severity_totals(df).first().total == 4
    assert {r.n for r in severity_summary(df.limit(0)).collect()} == {0}


def test_build_corpus_stores_points(spark, rows_a, tmp_path):
    collection = Collection(spark, str(tmp_path / "c"), SNIPPET_POINT)
    stored = build_corpus(rows_a, collection)
    assert stored.schema == SNIPPET_POINT
    assert stored.count() == dedup_snippets(rows_a).count()
    assert stored.where(F.size("embedding") != 384).count() == 0
    again = build_corpus(rows_a, collection)
    assert again.count() == dedup_snippets(rows_a).count()
    by_key = build_corpus(rows_a, Collection(spark, str(tmp_path / "k"), SNIPPET_POINT), dedup_on="id_key")
    assert by_key.count() == again.count()


@pytest.mark.parametrize("limit", [1_000_000, 1])
@pytest.mark.parametrize("dedup_on", ["id", "id_key", "file_path"])
def test_only_rows_that_share_their_id_are_compared(spark, monkeypatch, limit, dedup_on):
    """The rows are those of `dedup_snippets`; but for many shared ids nothing is shuffled or sorted on the way to them."""
    monkeypatch.setattr(corpus, "BROADCAST_IDS", limit)
    rows = dataset_a(spark.range(300).select(
        F.concat(F.lit("int f"), F.when(F.col("id") < 200, F.col("id")).otherwise(F.col("id") % 9), F.lit(";")).alias("func"),
        F.lit("CWE-20").alias("CWE ID"), (F.col("id") % 2).cast("int").alias("target"),
        F.concat(F.lit("CVE-"), F.col("id") % 2).alias("CVE ID"),
    ), id_chars=6)
    unique = stored_unique(rows.repartition(5), dedup_on)
    key = lambda row: tuple(row)
    assert sorted(unique.collect(), key=key) == sorted(dedup_snippets(rows, dedup_on).collect(), key=key)
    text = unique._jdf.queryExecution().executedPlan().toString()
    assert not any(name in text for name in ("Exchange hash", "Sort", "Window"))
    spread = limit > 1 and dedup_on != "file_path"
    assert ("snippets-" in text) == spread and ("unique-" in text) == (not spread)


def test_texts_stay_in_place_when_labels_are_joined(spark, sf_dir, monkeypatch):
    """Labels of bounded number go to the texts, whatever size Spark takes for small; of more, both sides are dealt by key."""
    from threatloom.queries import standins

    found = []
    for limit in (2_000_000, 10):
        monkeypatch.setattr(standins, "BROADCAST_ROWS", limit)
        with_setting = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            raw = standins.dataset_a_raw(spark, sf_dir)
            text = raw._jdf.queryExecution().executedPlan().toString()
            found.append(sorted(map(str, raw.collect())))
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_setting)
        assert ("Exchange hash" in text) == (limit == 10)
    assert found[0] == found[1] and found[0]


def test_stage_counts_are_observed(spark, rows_a):
    from threatloom.operators.stats import observed

    seen = Observation("labelled")
    rows = observed(rows_a, seen, vulnerable=F.col("label") == "vulnerable", none=F.lit(None).cast("boolean"))
    assert rows.count() == 7
    assert seen.get == {"rows": 7, "vulnerable": rows_a.where("label = 'vulnerable'").count(), "none": 0}
    assert observed(rows_a, None) is rows_a
