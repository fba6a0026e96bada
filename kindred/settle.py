"""Cut the lineage of a table, in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one where none is set, in local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="kindred-"))
    return sc.getCheckpointDir()


def shuffle_tasks(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, for rows that are small and stand for much work."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
