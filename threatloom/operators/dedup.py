"""First-wins de-duplication and per-group limits.

Both rank inside a group and keep low ranks. Spark applies the rank limit
before the shuffle as well (WindowGroupLimit), so a group holding a large part
of all rows reaches its final task as at most `n` rows per input partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_RANK = "__rank"
_SALT = "__salt"


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of every key under `order`, which should be a total order."""
    return limit_per_group(df, keys, order, 1)


def limit_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    n: int,
    *,
    rank_name: str | None = None,
    salts: int = 1,
) -> DataFrame:
    """The first `n` rows of every group under `order`.

    With few large groups and a large `n`, `salts` > 1 first takes the best `n`
    of that many slices of each group, so that no single task merges them all.
    """
    if salts > 1:
        sliced = df.withColumn(_SALT, F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
        df = _ranked(sliced, [*keys, _SALT], order, n).drop(_RANK, _SALT)
    ranked = _ranked(df, keys, order, n)
    return ranked.withColumnRenamed(_RANK, rank_name) if rank_name else ranked.drop(_RANK)


def _ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(_RANK, F.row_number().over(window)).where(F.col(_RANK) <= n)
