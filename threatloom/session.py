"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # keeps one Arrow batch of long source texts within a worker's memory
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
}

_local_dirs: dict[str, str] = {}


def build_session(app_name: str = "threatloom", master: str | None = None, **settings: str) -> SparkSession:
    """Session with the settings the library expects; `settings` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**_SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir` of the session, or the checkpoint folder of its context.

    A single-machine session without that setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.applicationId not in _local_dirs:
        if folder := context.getCheckpointDir():
            return folder.rstrip("/")
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        path = tempfile.mkdtemp(prefix="threatloom-")
        context.setCheckpointDir(path)
        _local_dirs[context.applicationId] = path
    return _local_dirs[context.applicationId]


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan over all cores, before heavy per-row work, when it has fewer partitions than that.

    Splits of many files are left as they are; only a scan of few large pieces is shuffled. Filters stay behind the shuffle:
    Spark would move them to the few pieces, with all that they are computed from.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return computed_once(scan.repartition(cores))


def computed_once(df: DataFrame) -> DataFrame:
    """The columns as they are here: neither filters nor what is made of a column compute it again."""
    here = F.monotonically_increasing_id() >= 0  # nothing passes what is not deterministic
    return df.select(*[F.when(here, F.col(f"`{c}`")).alias(c) for c in df.columns])


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a frame to the shared folder and read it back, so that dear steps before it run once."""
    path = run_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def open_folders(spark: SparkSession, folders: int) -> Iterator[None]:
    """Tasks that write to at most so many folders at once keep a file open in each and do not sort their rows by folder."""
    setting = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(folders))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder for one run."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
