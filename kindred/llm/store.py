"""Tables that cut lineage, kept in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.settle import shared_dir

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that go to Python at a time, where the session has Spark's own default: texts can be long.
BATCH = ("10000", "2000")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The shuffle files of the write are dropped with it, so that steps which follow one another
    do not hold their exchanges on disk at the same time. A lost executor costs only tasks of
    the step that runs: earlier steps are read from the shared folder.
    """
    spark = df.sparkSession
    # Columns that are null by type can't be written; as strings they are null all the same.
    if untyped := [c for c, kind in df.dtypes if kind == "void"]:
        df = df.withColumns({c: F.col(f"`{c}`").cast("string") for c in untyped})
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = {CLEANUP: spark.conf.get(CLEANUP, "false"), ARROW: spark.conf.get(ARROW)}
    spark.conf.set(CLEANUP, "true")
    if before[ARROW] == BATCH[0]:
        spark.conf.set(ARROW, BATCH[1])
    try:
        df.write.parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    out = spark.read.schema(df.schema).parquet(path)
    out._kindred_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._kindred_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
