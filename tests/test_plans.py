"""Physical plans have the shape meant."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from threatloom.constants import TARGET_CWES
from threatloom.operators.dedup import first_wins
from threatloom.operators.match import keyword_matches, modified_between
from threatloom.operators.range_join import first_point_in_span
from threatloom.operators.stats import coverage
from threatloom.sources.dimensions import keyword_groups


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = plan(parts.where(F.col("p_brand").isin(*TARGET_CWES)).select("p_partkey"))
    assert "PushedFilters: [In(p_brand" in text
    assert "ReadSchema: struct<p_partkey:bigint,p_brand:string>" in text
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    dated = orders.select("o_orderkey", "o_orderdate")
    text = plan(modified_between(dated, "o_orderdate", "1995-01-01", "1996-01-01").select("o_orderkey"))
    assert "GreaterThanOrEqual(o_orderdate,1995-01-01" in text and "LessThanOrEqual(o_orderdate,1996-01-01" in text


def test_first_wins_limits_before_the_shuffle(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = plan(first_wins(docs, ["source"], ["doc_id"]))
    before, after = text.index("WindowGroupLimit"), text.index("Exchange")
    assert before >= 0 and after >= 0 and "Partial" in text and "Final" in text


def test_keyword_join_is_a_hash_join(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("text").alias("description"), F.col("lang").alias("severity")
    )
    text = plan(keyword_matches(texts, keyword_groups(spark)))
    assert "BroadcastHashJoin" in text and "NestedLoop" not in text


def test_coverage_shuffles_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert plan(coverage(docs, ["source"], "lang")).count("Exchange\n") <= 1


def test_span_join_has_no_cross_join(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey")
    points = orders.select("o_custkey", F.col("o_orderkey").alias("at"), F.lit(1).alias("n"))
    spans = orders.select("o_custkey", F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + 9).alias("b"))
    text = plan(first_point_in_span(spans, points, ["o_custkey"], start="a", end="b", position="at", value=["n"], bin_rows=100))
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_no_exchange_before_row_local_work(spark, sf_dir):
    from threatloom.queries import QUERIES

    for name in ("keyword_match", "hash_embed"):
        text = plan(QUERIES[name](spark, sf_dir))
        assert text.replace("BroadcastExchange", "").count("Exchange") == 0, name
