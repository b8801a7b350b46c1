"""The shared folder and spreading."""

import pytest

from threatloom.session import run_dir, shared_dir, spread, stored


class Setting:
    def __init__(self, value):
        self._value = value

    def get(self, key, default=None):
        assert key == "spark.checkpoint.dir"
        return self._value or default


class Cluster:
    """A session on a cluster, as far as the shared folder is concerned."""

    class sparkContext:
        master, applicationId = "yarn", "application-0"
        folder = None

        @classmethod
        def getCheckpointDir(cls):
            return cls.folder

    def __init__(self, folder=None):
        self.conf = Setting(folder)


def test_a_cluster_names_its_folder():
    assert shared_dir(Cluster("hdfs://name/shared/")) == "hdfs://name/shared"
    with pytest.raises(RuntimeError):
        shared_dir(Cluster())


def test_the_folder_of_the_context_is_used(monkeypatch):
    monkeypatch.setattr(Cluster.sparkContext, "folder", "hdfs://name/checkpoints/1/")
    assert shared_dir(Cluster()) == "hdfs://name/checkpoints/1"
    assert shared_dir(Cluster("hdfs://name/shared")) == "hdfs://name/shared"


def test_runs_get_folders_of_their_own(spark):
    assert run_dir(spark, "x") != run_dir(spark, "x")
    assert run_dir(spark, "x").startswith(shared_dir(spark))


def test_stored_frames_read_back(spark):
    df = spark.range(10)
    again = stored(df, "numbers")
    assert again.schema.fieldNames() == ["id"] and again.count() == 10
    assert len(again.inputFiles()) > 0


def test_spread_leaves_wide_scans_alone(spark):
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == cores
    wide = spark.range(10, numPartitions=cores + 3)
    assert spread(wide) is wide
