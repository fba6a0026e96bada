"""Remembered keys from run to run, as a versioned Parquet table.

The folder is named by a fingerprint of the settings that keys depend on; other settings' folders
are dropped. A mail's memory holds while its file's size and time are the same, taken before it is read.
"""

from __future__ import annotations

import logging
import os
import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred import schema

KEYS = ["source_path", "mail_id", "file_size", "mtime_ns"]
COLUMNS = [c.split()[0] for c in schema.CACHE.split(", ")]


def default_path() -> str:
    base = os.environ.get("XDG_CACHE_HOME") or os.path.join(os.path.expanduser("~"), ".cache")
    return os.path.join(base, "kindred")


def hits(listing: DataFrame, memo: DataFrame) -> DataFrame:
    """Listed mails that are remembered as they are now, with what is remembered."""
    return listing.join(memo.select(*COLUMNS), KEYS)


def misses(listing: DataFrame, memo: DataFrame) -> DataFrame:
    return listing.join(memo.select(*KEYS), KEYS, "left_anti")


def vanished(memo: DataFrame, listing: DataFrame) -> DataFrame:
    """Memories of mails that are no longer in boxes that were opened."""
    opened = memo.join(listing.select("source_path").distinct(), "source_path", "left_semi")
    return opened.join(listing.select("source_path", "mail_id"), ["source_path", "mail_id"], "left_anti")


def merged(memo: DataFrame, listing: DataFrame, fresh: DataFrame, existing: DataFrame) -> DataFrame:
    """The next version: fresh keys (never of rejected mails), memories still true, and all of boxes
    that were not opened but are still there (``existing``: source_path)."""
    opened = listing.select("source_path").distinct()
    still = memo.join(listing.select(*KEYS), KEYS, "left_semi")
    away = memo.join(opened, "source_path", "left_anti").join(existing, "source_path", "left_semi")
    return still.select(*COLUMNS).unionByName(away.select(*COLUMNS)).unionByName(fresh.select(*COLUMNS))


class Memo:
    """Opens, reads and commits the table; any trouble means a run without memories, never a failed one."""

    def __init__(self, spark: SparkSession, path: str | None, fingerprint: str):
        self.spark, self.root, self.fingerprint = spark, Path(path or default_path()), fingerprint

    @property
    def folder(self) -> Path:
        return self.root / self.fingerprint

    def load(self) -> DataFrame:
        try:
            self.root.mkdir(parents=True, exist_ok=True)
            for other in self.root.iterdir():
                if other.is_dir() and other.name != self.fingerprint and len(other.name) == 64:
                    shutil.rmtree(other)
            versions = sorted(self.folder.glob("v-*")) if self.folder.is_dir() else []
            if versions:
                table = self.spark.read.schema(schema.CACHE).parquet(str(versions[-1]))
                table.limit(1).count()
                return table
        except Exception as e:
            logging.warning("no memories: %s", e)
        return self.spark.createDataFrame([], schema.CACHE)

    def commit(self, table: DataFrame) -> bool:
        """Write a whole new version beside the old one and put it in place by a rename."""
        try:
            before = sorted(self.folder.glob("v-*"))
            number = int(before[-1].name[2:]) + 1 if before else 1
            draft = self.folder / f".draft-{uuid.uuid4().hex}"
            table.write.parquet(str(draft))
            draft.rename(self.folder / f"v-{number:08d}")
            for old in before[:-1]:  # what this run has read stays until the next
                shutil.rmtree(old, ignore_errors=True)
            return True
        except Exception as e:
            logging.warning("memories were not kept: %s", e)
            return False
