"""The whole run: list, remember, parse, key, decide, act, report."""

from __future__ import annotations

import logging
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred import schema
from kindred.config import FOLDER_FORMATS, MINIMAL_HEADERS, Config
from kindred.functions import hashing, normalize
from kindred.operators import cascade, gate, memo, sinks, stats
from kindred.settle import settle
from kindred.sources import mail


LISTED = [c.split()[0] for c in schema.LISTING.split(", ")]


def display_name() -> Column:
    """What a mail is called; ties between mails are broken by it."""
    own = F.col("box_format").isin(*FOLDER_FORMATS, "table")
    name = F.when(own, F.col("path")).otherwise(F.concat_ws(":", "source_path", "mail_id"))
    return F.concat(F.lit("<"), F.col("box_format"), F.lit(" "), name, F.lit(">"))


def keyed(parsed: DataFrame, config: Config, bits: int = 224) -> DataFrame:
    """PARSED rows with canonical_headers, n_headers, mail_hash, timestamp, size, body_hash, rejection, repr."""
    canonical = normalize.canonical_headers(F.col("headers"), config.hash_headers, F.col("parsed_date"))
    rows = parsed.withColumn("canonical_headers", canonical).withColumn("n_headers", F.size("canonical_headers"))
    least = min(MINIMAL_HEADERS, len(config.hash_headers))
    few = F.concat(F.col("n_headers").cast("string"), F.lit(f" headers found out of {len(config.hash_headers)}."))
    rows = rows.withColumn("rejection", F.coalesce("parse_error", F.when(F.col("n_headers") < least, few)))
    rows = rows.withColumn("header_hash", hashing.header_key(F.col("canonical_headers"), bits))
    lines = F.coalesce("body_lines", F.array().cast("array<string>"))
    rows = rows.withColumn("mail_hash", F.when(F.col("rejection").isNull(), F.concat("header_hash", hashing.BODY_HASHERS[config.hash_body](lines, bits))))
    rows = rows.withColumn("timestamp", F.col("ctime") if config.time_source == "ctime" else F.col("parsed_date"))
    if "size" not in parsed.columns:
        rows = rows.withColumn("size", hashing.body_size(lines))
    rows = rows.withColumn("body_hash", hashing.raw_body(lines, bits)).withColumn("repr", display_name())
    return rows.drop("headers", "parsed_date")


class Dedup:
    """A run over mail boxes.

    ``add_source`` plans, ``hash_all`` keys, ``build_sets`` decides, ``act`` changes the disk, ``report`` and
    ``check_stats`` count. Decisions are settled before the first change.
    """

    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config = spark, config
        self.sources: list[str] = []
        self.mails: DataFrame | None = None
        self.decided: DataFrame | None = None
        self.done: dict | None = None

    def add_source(self, path: str) -> None:
        where = str(Path(path).resolve(strict=True))
        if where in self.sources:
            raise ValueError(f"{path} was given before")
        self.sources.append(where)

    def listing(self) -> DataFrame:
        return mail.list_mails(self.spark, self.sources, self.config.input_format)

    def hash_all(self) -> DataFrame:
        """Keyed mails, without their bodies, settled: each mail is read once. With memories on, only
        mails that are new or changed are opened."""
        c, listing = self.config, self.listing()
        if not c.cache:
            self.mails = settle(self._keyed(listing), "mails")
            return self.mails
        store = memo.Memo(self.spark, c.cache_path, hashing.settings_fingerprint(c.hash_headers, c.hash_body, c.time_source))
        listing, old = settle(listing, "listing"), store.load()
        fresh = settle(self._keyed(memo.misses(listing, old)), "fresh")
        known = memo.hits(listing, old).withColumn("timestamp", F.col("ctime") if c.time_source == "ctime" else F.col("timestamp"))
        known = known.withColumn("rejection", F.lit(None).cast("string")).withColumn("encoding_error", F.lit(False)).withColumn("repr", display_name())
        self.mails = settle(fresh.unionByName(known.select(*fresh.columns)), "mails")
        there = [(r.source_path,) for r in old.select("source_path").distinct().toLocalIterator() if os.path.exists(r.source_path)]
        # Mails whose bodies can't be encoded are opened again each time, as the rejected ones are.
        keep = fresh.filter("rejection is null and mtime_ns is not null and not encoding_error")
        store.commit(memo.merged(old, listing, keep, self.spark.createDataFrame(there, "source_path string")))
        return self.mails

    def _keyed(self, listing: DataFrame) -> DataFrame:
        return keyed(mail.parse(listing), self.config).select(*LISTED, "repr", "mail_hash", "timestamp", "size", "body_hash", "rejection", "encoding_error")

    def build_sets(self) -> DataFrame:
        mails, c = self.hash_all() if self.mails is None else self.mails, self.config
        # Bodies don't travel with the mails: those of contested sets are read again.
        bodies = None
        if c.content_threshold >= 0:
            asked = gate.contested(mails.filter("rejection is null"), c.size_threshold, c.content_threshold).filter("contested")
            bodies = mail.parse(asked).select("source_path", "mail_id", "body_lines").join(asked.select("source_path", "mail_id", "repr"), ["source_path", "mail_id"])
        self.decided = settle(cascade.decide(mails, c, bodies), "decided")
        return self.decided

    def views(self) -> None:
        """Temp views for SQL: ``mails`` (keyed), ``decisions`` and ``duplicate_sets``."""
        self.mails.createOrReplaceTempView("mails")
        self.decided.createOrReplaceTempView("decisions")
        cascade.sets(self.decided).createOrReplaceTempView("duplicate_sets")

    def act(self) -> dict:
        if self.config.export and sinks.verb(self.config.action) in ("copy", "move") and os.path.exists(self.config.export) and not self.config.export_append:
            raise FileExistsError(f"{self.config.export} exists already")
        self.done = sinks.perform(self.decided, self.config)
        return self.done

    def stats(self) -> DataFrame:
        verb = sinks.verb(self.config.action) if self.done is not None else None
        extra = {"done": self.done["done"] + self.done["skipped"], "hardlink_skipped": self.done["skipped"]} if self.done else {}
        return stats.stats(self.decided, verb, sinks.subset(self.config.action), **extra)

    def report(self) -> DataFrame:
        return stats.report(self.stats())

    def check_stats(self) -> None:
        verb = sinks.verb(self.config.action) if self.done is not None else None
        broken = stats.broken_laws(self.stats().first().asDict(), verb, sinks.subset(self.config.action))
        if broken:
            logging.error("counters contradict each other: %s", "; ".join(broken))
            raise SystemExit(stats.EXIT_INCONSISTENT)

    def run(self) -> DataFrame:
        self.config.check(bool(self.sources))
        self.build_sets()
        self.act()
        self.check_stats()
        return self.report()


def hash_only(spark: SparkSession, sources: list[str], config: Config) -> DataFrame:
    """(source_path, mail_id, canonical_headers, header_hash): a map over the mails, without an exchange of sets."""
    rows = keyed(mail.parse(mail.list_mails(spark, sources, config.input_format), body=False), config)
    return rows.filter("rejection is null").select("source_path", "mail_id", "canonical_headers", "header_hash")
