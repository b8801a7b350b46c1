"""First point inside each span, without pairing spans with points.

Starts and points are sorted by key and position once, in as many ranges as their number asks for, so that a key with most of
the rows has many bins and a bin of any key has a bounded number of rows. The next point is searched for at two levels: in the
bin of a start, and, from one row per bin, in the bins after it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threatloom.session import stored

#: Starts and points of one bin, about; a task's window holds one bin at a time.
BIN_ROWS = 200_000


def first_point_in_span(
    spans: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    *,
    start: str,
    end: str,
    position: str,
    value: Sequence[str],
    bin_rows: int = BIN_ROWS,
) -> DataFrame:
    """Spans with the `value` columns of the first point in [start, end); spans without one are dropped.

    Positions are whole numbers; points are ordered by position, then by `value`. Spans without a start, end or key and
    points without a position or key match nothing.
    """
    point = F.struct(F.col(position).alias("at"), *value)
    named = points.where(F.col(position).isNotNull())
    marks = named.groupBy(*keys, F.col(position).cast("long").alias("__pos")).agg(F.min(point).alias("__point"))
    starts = spans.where(F.col(start).isNotNull()).select(*keys, F.col(start).cast("long").alias("__pos"))
    bins = max(1, -(-(_distinct(starts, keys) + _distinct(named.select(*keys, F.col(position).alias("__pos")), keys)) // bin_rows))
    in_bin = _next_in_bin(_binned(starts.distinct(), marks, keys, bins), keys)
    beyond = _next_beyond_bin(in_bin, keys)
    nearest = (
        in_bin.where("__is_start")
        .join(beyond, [*keys, "__bin"], "left")
        .select(*keys, "__pos", F.coalesce("__next", "__later").alias("__hit"))
        .where(F.col("__hit").isNotNull())
    )
    return (
        spans.withColumn("__pos", F.col(start).cast("long"))
        .join(nearest, [*keys, "__pos"])
        .where(F.col("__hit.at") < F.col(end))
        .select(*spans.columns, F.col("__hit.at").alias(position), *[F.col(f"__hit.{v}") for v in value])
    )


def _distinct(positions: DataFrame, keys: Sequence[str]) -> int:
    """About how many positions there are, without gathering them; they need not be distinct."""
    return positions.agg(F.approx_count_distinct(F.struct(*keys, "__pos"))).first()[0]


def _binned(starts: DataFrame, marks: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    """Starts and marks with the number of their bin, one of `bins` ranges of (key, position) with about as many of them.

    Stored, as the ranges are drawn from a sample and have to be the same for all that follows.
    """
    both = starts.withColumn("__is_start", F.lit(True)).unionByName(
        marks.withColumn("__is_start", F.lit(False)), allowMissingColumns=True
    )
    dealt = both.repartitionByRange(bins, *keys, "__pos").withColumn("__bin", F.spark_partition_id())
    return stored(dealt, "bins")


def _next_in_bin(binned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every start and mark of a bin with the nearest mark at or after it in the bin, or null."""
    # walking backwards, the last mark seen is the next one; at one position the mark comes first
    backwards = (
        Window.partitionBy(*keys, "__bin")
        .orderBy(F.col("__pos").desc(), "__is_start")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return binned.withColumn("__next", F.last("__point", ignorenulls=True).over(backwards))


def _next_beyond_bin(in_bin: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(key, bin) -> first mark of the later bins."""
    bins = in_bin.groupBy(*keys, "__bin").agg(F.min("__point").alias("__first"))
    later = (
        Window.partitionBy(*keys).orderBy(F.col("__bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    )
    found: Column = F.last("__first", ignorenulls=True).over(later)
    return bins.select(*keys, "__bin", found.alias("__later"))
