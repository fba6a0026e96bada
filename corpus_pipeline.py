"""From documents to training tokens: five stages, each one of the operators in kindred.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of ``documents``, and any more that
``docs`` has, whatever their names. No stage needs doc_ids that differ or are there: a row is known
by what it holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.llm import bpe, mixing, quality, secrets, similar
from kindred.llm.store import settle

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def _aside(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with extra columns under names that nothing else has, and what gives them theirs back."""
    names = [c if c in DOCUMENT else f"__kindred_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), lambda out: out.select(*names).toDF(*docs.columns)


def _rest(docs: DataFrame) -> Column:
    """A value that orders rows which agree in what a stage looks at; alike rows are alike to every stage."""
    return F.xxhash64(*[F.col(c) for c in docs.columns if c != "text"])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the base rules or their language's references reject.

    Null and blank texts have fewer words than asked for and go; rows are judged one by one, so repeated rows
    share their fate; texts of any length are read whole. An empty table stays empty.
    """
    rows, back = _aside(docs)
    # A settled copy of the texts would lie on disk for as long as this table can be read, so through all later stages.
    return back(quality.judge(rows, settled=False).filter("quality.kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of texts whose five-word shingles have a similarity of 0.8 or more.

    It is the one of smallest doc_id (null after all others), then of least MD5 of its text; of rows that agree in
    both, one stays. Rows of one doc_id replace each other only within their group: other texts are
    no copies. Null and blank texts are one group. An empty table stays empty.
    """
    rows, back = _aside(docs)
    groups = similar.similar_groups(rows, width=5, least=0.8)
    rows = rows.withColumn("_key", similar.text_key(F.col("text")))
    who = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_key").alias("key"))
    stay = rows.select("_key", who.alias("who")).join(groups, F.col("_key") == F.col("text_key")).groupBy("root").agg(F.min("who").alias("who")).select("who.*")
    kept = rows.join(stay, F.col("_key") == F.col("key"))
    # A text has one group, and a group one survivor, so the rows of a survivor's text that have its doc_id agree in all else that counts.
    order = Window.partitionBy("_key").orderBy(~F.col("doc_id").eqNullSafe(F.col("id")), _rest(rows))
    return back(kept.withColumn("_row", F.row_number().over(order)).filter("_row = 1"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask every secret; no document goes.

    Null and empty texts have none; n_chars, where there is such a column, is counted anew for texts that
    change. Rows are scanned one by one, texts of any length whole. An empty table stays empty.
    """
    rows, back = _aside(docs)
    found = secrets.scan(rows)
    spans = F.concat("base", "added")
    found = found.withColumn("_text", secrets.redact(F.col("text"), spans))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("_text").cast("long")).otherwise(F.col("n_chars")))
    return back(found.withColumn("text", F.col("_text")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give out each document as often as the mix takes it.

    Null and blank texts have no words and are never taken; a null source is a source. Rows that agree in doc_id,
    source and words share what is taken of them, in order of what they hold. An empty table stays empty.
    """
    rows, back = _aside(docs)
    # What a row holds, as one value: the same for rows that are the same.
    held = F.concat(similar.text_key(F.col("text")), F.unhex(F.lpad(F.hex(F.xxhash64(F.isnull("doc_id"), "doc_id", F.isnull("source"), "source")), 16, "0")))
    rows = rows.withColumn("_held", held)
    sizes = settle(rows.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), "_held"), "sizes")
    mixed = mixing.mix(sizes).filter("taken > 0")
    taken = mixed.groupBy("doc_id", "source", "size").agg(F.sum(F.col("taken") / F.col("size")).cast("long").alias("times"))
    taken = taken.select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("size").alias("n"), "times")
    alike = sizes.groupBy("doc_id", "source", "size", "_held").agg(F.count("*").alias("rows"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("n"))
    all_of = Window.partitionBy("doc_id", "source", "size")
    before = all_of.orderBy("_held").rowsBetween(Window.unboundedPreceding, -1)
    shared = alike.join(taken, same).select("_held", "times", F.sum("rows").over(all_of).alias("_all"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_before"))
    out = rows.join(shared, "_held")
    at = F.col("_before") + F.row_number().over(Window.partitionBy("_held").orderBy(_rest(rows)))
    times = F.floor(F.col("times") / F.col("_all")) + F.when(at <= F.col("times") % F.col("_all"), 1).otherwise(0)
    return back(out.withColumn("_times", times.cast("int")).filter("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text.

    A null text is encoded as an empty one. Rows are encoded one by one, texts of any length whole; extra
    columns end here. An empty table stays empty.
    """
    done = bpe.encode(docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text")), decoded="decoded")
    return done.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.col("text")).alias("round_trip"), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("byte_bpe", byte_bpe),
]

#: Shingle fingerprints and BPE are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
