"""Bag union of snippet sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, duplicates kept; columns are matched by name."""
    return reduce(DataFrame.unionByName, frames)
