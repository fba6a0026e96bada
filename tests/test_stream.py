import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from kindred.config import Config
from kindred.streaming.arrivals import first_arrivals, remember

SCHEMA = "source_path string, mail_id string, path string, box_format string, ctime double, headers array<struct<name:string,value:string>>, parsed_date double, body_lines array<string>, parse_error string, encoding_error boolean, arrived timestamp"
CONFIG = Config(hash_headers=("message-id",))


def drop(spark, folder, ids, at):
    data = [("b", f"{at}-{i}", f"b/{at}-{i}", "table", 0.0, [("message-id", m)], 1.0, ["x"], None, False) for i, m in enumerate(ids)]
    spark.createDataFrame(data, SCHEMA.rsplit(",", 1)[0]).withColumn("arrived", F.lit(f"2024-01-01 00:00:{at:02d}").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)


def test_first_arrivals(spark, tmp_path):
    folder = str(tmp_path / "in")
    drop(spark, folder, ["a", "b", "a"], 1)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    q = first_arrivals(stream, CONFIG).writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    drop(spark, folder, ["b", "c"], 2)
    q.processAllAvailable()
    q.stop()
    assert spark.table("firsts").count() == 3


def test_remember(spark, tmp_path):
    folder, table = str(tmp_path / "in"), str(tmp_path / "keys")
    for at, ids in ((1, ["a", "b"]), (2, ["b", "c"])):
        drop(spark, folder, ids, at)
        remember(spark, spark.readStream.schema(SCHEMA).parquet(folder), CONFIG, table, str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(table).count() == 3


def test_remember_does_not_take_a_failing_read_for_a_missing_table(spark, tmp_path):
    folder, table = str(tmp_path / "in"), tmp_path / "keys"
    drop(spark, folder, ["a"], 1)
    table.mkdir()
    (table / "part-0.parquet").write_bytes(b"not Parquet")
    with pytest.raises(StreamingQueryException):
        remember(spark, spark.readStream.schema(SCHEMA).parquet(folder), CONFIG, str(table), str(tmp_path / "c")).awaitTermination()
    assert [f.name for f in table.iterdir() if f.suffix == ".parquet"] == ["part-0.parquet"]
