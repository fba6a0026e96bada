"""Small tables with the awkward rows that every operator has to stand."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["a", "z", "key", "span", "fp", "quality", "base", "added", "ids", "decoded", "f", "q_lang", "size", "taken", "_s", "_h"]


def prose(seed: int, n: int, words: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


def rows() -> list[tuple]:
    long = " ".join(f"long{i % 997}" for i in range(30_000))
    base = prose(1, 120)
    near = base.replace(" w1", " x1", 1)
    texts = [base, base, near, prose(2, 200), prose(3, 60) + "\n" + base, None, "", " \t\n ", "one", "a b c d", long, "é" * 700, "x" * 2500, "ab " * 600, prose(4, 30) + " 日本語 🙂 " + prose(4, 30)]
    out = [(i, t, ["en", "fr", None, "xx"][i % 4], ["s1", "s2", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[3], (None, base, None, None, None)]


def docs(spark: SparkSession, data: list[tuple] | None = None, extra: bool = False) -> DataFrame:
    df = spark.createDataFrame(rows() if data is None else data, COLUMNS).repartition(3)
    if extra:
        from pyspark.sql import functions as F

        for c in CLASH:
            df = df.withColumn(c, F.lit("clash"))
    return df


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], COLUMNS)
