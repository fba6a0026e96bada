"""Mails that arrive in a drop folder, deduplicated against all that came before, as a stream."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kindred.config import Config
from kindred.plans.dedup import keyed


def first_arrivals(parsed_stream: DataFrame, config: Config, watermark: str = "7 days") -> DataFrame:
    """Of PARSED rows with an ``arrived`` timestamp, the first of each key within the watermark.

    Rejected mails are dropped; the state holds one key for as long as the watermark lasts.
    """
    rows = keyed(parsed_stream, config).filter("rejection is null")
    return rows.withWatermark("arrived", watermark).dropDuplicatesWithinWatermark(["mail_hash"])


def remember(spark: SparkSession, parsed_stream: DataFrame, config: Config, table: str, checkpoint: str) -> StreamingQuery:
    """Append keys that the Parquet table ``table`` has not seen, batch by batch."""

    def merge(batch: DataFrame, _: int) -> None:
        fresh = keyed(batch, config).filter("rejection is null").groupBy("mail_hash").agg(F.min("path").alias("path"))
        try:
            seen = spark.read.schema(fresh.schema).parquet(table)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # the first batch finds no table
                raise
        else:
            fresh = fresh.join(seen.select("mail_hash"), "mail_hash", "left_anti")
        fresh.write.mode("append").parquet(table)

    return parsed_stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
