"""High watermark of incremental ingestion."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.functions.text import iso_utc, utc_now

#: How late a record may land, counted in moments of modification.
OVERLAP = timedelta(days=1)

_SCHEMA = "last_run string"


def read_if_present(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """JSON-lines table at `path`, or None before its first write."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return None
    return spark.read.schema(schema).json(path)


class Watermark:
    """The highest moment of modification read so far, kept as an append-only table so that a failed write loses nothing.

    It follows the records, not the clock: what was modified before a run but lands after it is still read, if it lands while
    no record later by more than the overlap has been read.
    """

    def __init__(self, spark: SparkSession, path: str, overlap: timedelta = OVERLAP):
        self._spark = spark
        self._path = path
        self._overlap = overlap

    def read(self) -> str | None:
        """ISO time of the highest record; None means a full load."""
        runs = read_if_present(self._spark, self._path, _SCHEMA)
        return None if runs is None else runs.agg(F.max_by("last_run", F.try_to_timestamp("last_run"))).first()[0]

    def since(self) -> str | None:
        """ISO time from which the next run has to read."""
        highest = self.read()
        if highest is None:
            return None
        start = F.to_timestamp(F.lit(highest)) - F.lit(self._overlap)
        return self._spark.range(1).select(iso_utc(start)).first()[0]

    def save(self, moment: str | None = None) -> None:
        """Record a moment, by default the present."""
        stamp = F.lit(moment) if moment else utc_now()
        self._spark.range(1).select(stamp.alias("last_run")).write.mode("append").json(self._path)
