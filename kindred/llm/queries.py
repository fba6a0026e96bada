"""The registered queries of the training-data operators: one thin opN_<name> each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import bpe, chat, mixing, oracle, passages, quality, secrets, simhash, substrings, urls, vectors
from kindred.llm.store import settle


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """13-word windows of all documents that start in an earlier document, removed."""
    done = substrings.dedup(_table(spark, sf_dir, "documents"), length=13)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution divergence of every document from its language."""
    judged = quality.judge(_table(spark, sf_dir, "documents"), min_words=50, carry=["doc_id"])
    return judged.select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all rows with cosine 0.9 or more, by sorted projection passes."""
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, and what they decode to."""
    done = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), decoded="decoded", vocabulary="byte_bpe_50k.tiktoken")
    digest = lambda c: F.sha2(c, 256)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """200-byte strings of all documents that start anywhere else, removed."""
    done = passages.dedup(_table(spark, sf_dir, "documents"), length=200)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed patterns and the randomness battery over every document."""
    found = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(secrets.listing(F.col("base")), 256).alias("base_sha256"),
        secrets.listing(F.concat("base", "added")).alias("spans"),
    )


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted fair queueing of all documents: weights 5, 2, 1, 150 % of all words."""
    docs = _table(spark, sf_dir, "documents")
    sizes = settle(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")), "sizes")
    return mixing.mix(sizes, weights=(5, 2, 1), share=1.5, passes=2)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of all documents: 4-word shingles, linked at 4 or fewer differing bits."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), radius=4, width=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, then the ratio of character language models, for every page's url."""
    return urls.judge(_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted; every column is read back from the output."""
    said = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    out = chat.format_chats(rows, loss_role="assistant")
    turns, loss = chat.parse(F.col("formatted")), F.array_join(chat.loss_texts(F.col("formatted"), F.col("loss_spans")), "")
    return out.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_quality_rules,
        op3_embedding_near_dedup,
        op4_byte_bpe,
        op5_suffix_array_dedup,
        op6_secret_scan,
        op7_url_filter,
        op8_mix_sources,
        op9_simhash_near_dedup,
        op10_chat_format,
    )
}

SQL: dict[str, str] = dict(oracle.SQL)
