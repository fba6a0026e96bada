"""Mails as DataFrames: a data source that lists boxes, and a parser of listed mails."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from kindred import schema
from kindred.config import FOLDER_FORMATS
from kindred.functions import mime
from kindred.settle import shuffle_tasks
from kindred.sources import boxes

# Characters of parsed mails that a batch holds before it goes on, and what any string counts besides.
BATCH, OBJECT = 4_000_000, 60
LISTED = [c.split()[0] for c in schema.LISTING.split(", ")]


class Box(InputPartition):
    def __init__(self, path: str, box_format: str):
        self.path, self.box_format = path, box_format


class _BoxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.sources = json.loads(options["sources"])
        self.box_format = options.get("boxformat") or options.get("boxFormat") or None

    def partitions(self) -> list[Box]:
        return [Box(*b) for b in boxes.plan(self.sources, self.box_format)]

    def read(self, partition: Box) -> Iterator[tuple]:
        return boxes.listing(partition.path, partition.box_format)


class MailboxSource(DataSource):
    """``spark.read.format("mailbox").option("sources", <JSON list of paths>)``: one row a mail.

    Boxes are found on the driver; each is listed by a task of its own.
    """

    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return schema.LISTING

    def reader(self, schema: StructType) -> _BoxReader:
        return _BoxReader(self.options)


def list_mails(spark: SparkSession, sources: list[str], box_format: str | None = None) -> DataFrame:
    spark.dataSource.register(MailboxSource)
    reader = spark.read.format("mailbox").option("sources", json.dumps([str(s) for s in sources]))
    return (reader.option("boxFormat", box_format) if box_format else reader).load()


def parsed(batches: Iterator[pd.DataFrame], body: bool = True) -> Iterator[pd.DataFrame]:
    """Parsed mails of batches of listing rows, in batches of about ``BATCH`` characters."""
    reader = boxes.Reader()
    for pdf in batches:
        rows, first, held = [], 0, 0
        for at, r in enumerate(pdf.itertuples(index=False), 1):
            try:
                rows.append(mime.columns(reader.message(r.source_path, r.mail_id, r.path, r.box_format), body))
            except OSError as e:
                rows.append({"headers": [], "parsed_date": None, "body_lines": None, "parse_error": f"unreadable file: {e.strerror}", "encoding_error": False})
            except Exception as e:  # whatever a malformed mail does to the parser is a fact about that mail
                rows.append({"headers": [], "parsed_date": None, "body_lines": None, "parse_error": f"{type(e).__name__}: {e}", "encoding_error": False})
            held += sum(len(h["value"]) + OBJECT for h in rows[-1]["headers"]) + sum(len(x) + OBJECT for x in rows[-1]["body_lines"] or ())
            if held >= BATCH or at == len(pdf):
                more = pd.DataFrame(rows, columns=["headers", "parsed_date", "body_lines", "parse_error", "encoding_error"])
                yield pd.concat([pdf[LISTED].iloc[first:at].reset_index(drop=True), more], axis=1)
                rows, first, held = [], at, 0
    reader.close()


def parse(mails: DataFrame, body: bool = True) -> DataFrame:
    """PARSED rows of LISTING rows; what can't be read or parsed has a parse_error.

    Mails with files of their own are dealt out evenly; those of a file box stay together, as their
    place in it is found by reading it from the start.
    """
    own = F.col("box_format").isin(*FOLDER_FORMATS)
    spread = mails.repartition(shuffle_tasks(mails.sparkSession), F.when(own, F.xxhash64("path")).otherwise(F.xxhash64("source_path"))).sortWithinPartitions("source_path")
    return spread.select(*LISTED).mapInPandas(lambda batches: parsed(batches, body), schema.PARSED)
