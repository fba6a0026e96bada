"""Any table as mails: columns stand for a mail's parts."""

from __future__ import annotations

import email.utils
import os
import uuid
from collections.abc import Iterator, Mapping
from itertools import groupby
from operator import itemgetter
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.settle import shared_dir, shuffle_tasks
from kindred.sources import boxes


def mails_from_table(
    df: DataFrame,
    source_path: Column,
    mail_id: Column,
    headers: Mapping[str, Column],
    body: Column | None = None,
    path: Column | None = None,
    date: Column | None = None,
    size: Column | None = None,
) -> DataFrame:
    """PARSED-shaped rows: a null header column is an absent header; ``date`` is in epoch seconds."""
    where = F.concat_ws("/", source_path, mail_id.cast("string")) if path is None else path
    pairs = F.array(*[F.struct(F.lit(k.lower()).alias("name"), v.cast("string").alias("value")) for k, v in headers.items()])
    lines = F.array().cast("array<string>") if body is None else F.when(F.coalesce(body, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))
    out = df.select(
        source_path.cast("string").alias("source_path"),
        mail_id.cast("string").alias("mail_id"),
        where.alias("path"),
        F.lit("table").alias("box_format"),
        F.lit(None).cast("bigint").alias("file_size"),
        F.lit(None).cast("bigint").alias("mtime_ns"),
        F.lit(None).cast("double").alias("ctime"),
        F.filter(pairs, lambda h: h["value"].isNotNull()).alias("headers"),
        (F.lit(None) if date is None else date).cast("double").alias("parsed_date"),
        lines.alias("body_lines"),
        F.lit(None).cast("string").alias("parse_error"),
        F.lit(False).alias("encoding_error"),
        *([] if size is None else [size.cast("long").alias("size")]),
    )
    return out


def boxes_from_table(rows: DataFrame, box_format: str) -> list[str]:
    """Write ``rows`` (box, doc_id, text) as mail boxes in the shared folder, one task a box; returns their paths.

    A task writes its boxes one after another, mail by mail, in order of doc_id. A box is written beside its
    place and renamed, so a task that runs again does no harm.
    """
    root = os.path.join(urlparse(shared_dir(rows.sparkSession)).path, f"boxes-{uuid.uuid4().hex}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, mails in groupby(_mails(batches), key=itemgetter(0)):
            os.makedirs(root, exist_ok=True)
            path, draft = os.path.join(root, name), os.path.join(root, f".{uuid.uuid4().hex}")
            box = boxes.open_box(draft, box_format, create=True)
            for _, i, text in mails:
                head = f"Message-ID: <{i}@table>\nFrom: table@list.org\nSubject: document {i}\nDate: {email.utils.formatdate(1_000_000_000 + 3600 * int(i))}\nMIME-Version: 1.0\nContent-Type: text/plain; charset=utf-8\n\n"
                box.add((head + text).encode())
            box.flush()
            box.close()
            if not os.path.exists(path):
                os.rename(draft, path)
            yield pa.RecordBatch.from_pydict({"path": [path]})

    # A number of tasks that is given isn't made smaller by the little that the rows may weigh.
    dealt = rows.select("box", "doc_id", "text").repartition(shuffle_tasks(rows.sparkSession), "box").sortWithinPartitions("box", "doc_id")
    return [r.path for r in dealt.mapInArrow(write, "path string").collect()]  # one row a box


def _mails(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of batches, one in Python at a time."""
    for batch in batches:
        for row in zip(*batch.columns):
            yield tuple(x.as_py() for x in row)
