"""Readable diffs of contested sets: each member against the first of its set."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pretty(a: list[str], b: list[str], name_a: str, name_b: str) -> str:
    return "\n".join(difflib.unified_diff(a, b, fromfile=name_a, tofile=name_b, n=0, lineterm=""))


def contested_diffs(run) -> DataFrame:
    from kindred.operators import gate
    from kindred.sources import mail

    asked = gate.contested(run.mails.filter("rejection is null").drop("body_lines"), run.config.size_threshold, run.config.content_threshold).filter("contested")
    lines = mail.parse(asked).select("source_path", "mail_id", "body_lines")
    w = Window.partitionBy("mail_hash").orderBy("repr")
    pairs = asked.join(lines, ["source_path", "mail_id"]).withColumn("first", F.first(F.struct("repr", "body_lines")).over(w)).filter("repr != first.repr")

    def show(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"diff": [pretty(list(a), list(b), x, y) for a, b, x, y in zip(pdf.a, pdf.b, pdf.x, pdf.y)]})

    chosen = pairs.select(F.col("first.body_lines").alias("a"), F.col("body_lines").alias("b"), F.col("first.repr").alias("x"), F.col("repr").alias("y"))
    return chosen.mapInPandas(show, "diff string")
