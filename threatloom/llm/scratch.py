"""Tables of intermediate results in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.session import run_dir


def write_table(df: DataFrame, name: str) -> str:
    """Write a frame below the shared folder; the path of the new table."""
    path = run_dir(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return path


def read_table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path)


def store(df: DataFrame, name: str) -> DataFrame:
    """The frame, read from a table written once: cuts the lineage and survives lost executors."""
    return read_table(df.sparkSession, write_table(df, name), df)


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a table that no later step reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether a frame has at most `rows` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def once(column: Column) -> Column:
    """The column, computed where it is defined: a filter on it is not moved below, which would compute it again there."""
    return F.when(F.monotonically_increasing_id() >= 0, column)
