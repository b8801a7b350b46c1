"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.llm.scratch import drop_table, read_table, write_table


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Link the larger (or smaller and own) neighbours of each node to the smallest node it knows."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    moved = both.join(least, "a")
    if larger:
        return moved.where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    own = least.where("a <> m").select("a", F.col("m").alias("b"))
    return moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(own).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Number and order-free sum of the edges, to see whether a step changed them."""
    total: Column = F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))
    return tuple(edges.agg(F.count("*"), total).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """Node `a` -> smallest node `b` of its component, for every node that is not the smallest of its own.

    `edges` has two columns of an orderable type, `a` and `b`; loops and repeated edges do no harm. Each step is
    written to the shared folder and its predecessor removed.
    """
    spark = edges.sparkSession
    oriented = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    path = write_table(oriented, "edges")
    current = read_table(spark, path, oriented)
    before = _mark(current)
    while before[0]:
        step = _star(_star(current, larger=True), larger=False)
        after_path = write_table(step, "edges")
        current = read_table(spark, after_path, oriented)
        drop_table(spark, path)
        path, after = after_path, _mark(current)
        if after == before:
            break
        before = after
    return current
