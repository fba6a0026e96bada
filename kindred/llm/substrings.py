"""Substring deduplication over a log-structured fingerprint index.

A document's windows of ``length`` words are fingerprinted by their minimizer, the least hash of the
``k``-word pieces in them; windows in a row that share one are a zone, known by the XXH3-128 digest
of its words' bytes. The index is a list of immutable runs: tables bucketed and sorted by
fingerprint, one row for each distinct zone with the smallest document it was seen in. A batch of new
documents becomes a run and is merge-joined with the runs before it, without moving them; runs of
like size are merged, which keeps the rows of zones' first documents only. A zone that an earlier
document has, byte for byte, is removed; zones of one fingerprint that differ are verified window by
window, by the XXH3-128 digest of each window's bytes, read from the documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.rolling import Sums, digests, word_hashes, word_parts, zones
from kindred.llm.store import CLEANUP, discard, settle

LENGTH, PIECE = 13, 5
#: Bytes of short texts that are hashed together.
CHUNK = 1 << 20
#: Places are kept as (first word << 7 | windows); a zone has fewer than 64 windows.
WINDOWS = (1 << 7) - 1
#: Words whose zones are found at a time; windows overlap from one part of a long text to the next.
MOST_WORDS = 1 << 20
ZONE = ["a", "z", "y"]


def plain(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(words joined by one space, hash of each word, bytes of each word)."""
    if len(text) <= CHUNK:
        values, size = word_hashes(text)
        return b" ".join(text.split()), values, size
    parts = [(b" ".join(p.split()), *word_hashes(p)) for p in word_parts(text)]
    return b" ".join(p[0] for p in parts if p[0]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], list[bytes]]]:
    """(doc, sub) and texts: as many short texts as make a chunk, or one long one."""
    ids, parts, size = [], [], 0
    for b in batches:
        for doc, sub, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            data = text.as_buffer()
            if data is None or not len(data):
                continue
            if size and size + len(data) > CHUNK:
                yield ids, parts
                ids, parts, size = [], [], 0
            ids.append((doc, sub))
            parts.append(data.to_pybytes())
            size += len(parts[-1]) + 1
    if ids:
        yield ids, parts


def _zones(length: int, k: int):
    """(doc, sub, text) -> (a, z, y, doc, sub, at) of every zone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _groups(batches):
            joined, values, size = plain(b" ".join(texts))
            if len(texts) > 1:
                counts = [len(t.split()) for t in texts]
            else:
                counts = [len(values)]
            ends = np.cumsum(counts)
            stop = np.cumsum(size + 1) - 1  # in joined
            keys = np.array(ids, np.int64)
            for lo in range(0, max(1, len(values)), MOST_WORDS):
                hi = min(len(values), lo + MOST_WORDS + length - 1)
                inside = np.unique(np.concatenate([np.clip(ends - lo, 0, hi - lo), [hi - lo]]))
                inside = inside[inside > 0]
                if not len(inside):
                    continue
                a, _, first, n = zones(Sums(values[lo:hi]), inside, length, k)
                first = first + lo
                last = first + n - 2 + length
                zy = digests(joined, stop[first] - size[first], stop[last])
                doc = np.searchsorted(ends, first, side="right")
                at = (first - np.concatenate([[0], ends])[doc]) << 7 | n
                columns = [a.view(np.int64), zy[:, 0], zy[:, 1], keys[doc, 0], keys[doc, 1], at]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [*ZONE, "doc", "sub", "at"])

    return run


@contextmanager
def _merging(spark: SparkSession) -> Iterator[None]:
    """Joins on zones of tables that are bucketed by a move no rows; exchanges end with their write."""
    wanted = {"spark.sql.requireAllClusterKeysForCoPartition": "false", CLEANUP: "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class RunIndex:
    """Sorted runs of (a, z, y, doc, sub, at): zones, their first document and place.

    ``manifest`` names the runs; an index of the same session catalog is opened again with it, so that
    batches of later runs are compared with all that came before.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, manifest: list[tuple[int, str]] | None = None):
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[int, str]] = [tuple(r) for r in manifest or []]  # (level, table)

    @property
    def manifest(self) -> list[tuple[int, str]]:
        return list(self.runs)

    def _write(self, rows: DataFrame, dealt: bool = False) -> str:
        """Save a run; ``dealt`` says that the rows come from a join of runs, and so by bucket already."""
        name = f"kindred_run_{uuid.uuid4().hex}"
        with _merging(self.spark):
            (rows if dealt else rows.repartition(self.buckets, "a")).write.bucketBy(self.buckets, "a").sortBy(*ZONE).format("parquet").saveAsTable(name)
        return name

    def append(self, zones_: DataFrame) -> DataFrame:
        """Add a batch's zones (one row each, with m, its rows in the batch) as a run; returns
        (a, z, y, first, again): zones that have more than one row in the batch or were in an earlier
        run, and the smallest document of each. ``again``: its first document holds it more than once."""
        name = self._write(zones_)
        met = self.spark.table(name).select(*ZONE, "doc", "m", "again")
        first = F.col("doc")
        for i, (_, run) in enumerate(self.runs):
            old = self.spark.table(run).select(*ZONE, F.col("doc").alias(f"doc{i}"))
            met = met.join(old, ZONE, "left")
            first = F.least(first, F.col(f"doc{i}"))
        found = met.filter((F.col("m") > 1) | (first < F.col("doc"))).select(*ZONE, first.alias("first"), "again")
        with _merging(self.spark):
            found = settle(found, "met")
        self.runs.append((0, name))
        while len(self.runs) > 1 and self.runs[-1][0] == self.runs[-2][0]:
            self._merge()
        return found

    def _merge(self) -> None:
        (level, left), (_, right) = self.runs[-2:]
        rows = [self.spark.table(t).select(*ZONE, F.struct("doc", "sub", "at").alias(f"f{i}"), F.col("m").alias(f"m{i}"), F.col("again").alias(f"g{i}")) for i, t in enumerate((left, right))]
        both = rows[0].join(rows[1], ZONE, "full")
        again = F.when(F.coalesce(F.col("f0") <= F.col("f1"), F.col("f0").isNotNull()), F.col("g0")).otherwise(F.col("g1"))
        merged = both.select(*ZONE, F.least("f0", "f1").alias("f"), (F.coalesce("m0", F.lit(0)) + F.coalesce("m1", F.lit(0))).alias("m"), again.alias("again"))
        name = self._write(merged.select(*ZONE, "f.doc", "f.sub", "f.at", "m", "again"), dealt=True)
        self.runs[-2:] = [(level + 1, name)]
        for t in (left, right):
            self.spark.sql(f"drop table {t}")

    def compact(self) -> str:
        """Merge all runs into one, and return its table's name."""
        while len(self.runs) > 1:
            self._merge()
        return self.runs[0][1]

    def drop(self) -> None:
        for _, t in self.runs:
            self.spark.sql(f"drop table if exists {t}")
        self.runs = []


def distinct_zones(seen: DataFrame) -> DataFrame:
    """(a, z, y, doc, sub, at, m, again) of a batch's zone rows: what a run holds."""
    place = F.struct("doc", "sub", "at")
    # The last place of the first document is the one whose complement is least.
    other = F.min(F.struct(F.col("doc"), F.bitwise_not("sub").alias("s"), F.bitwise_not("at").alias("t")))
    rows = seen.groupBy(*ZONE).agg(F.min(place).alias("f"), other.alias("g"), F.count("*").alias("m"))
    again = (F.bitwise_not("g.s") != F.col("f.sub")) | (F.bitwise_not("g.t") != F.col("f.at"))
    return rows.select(*ZONE, "f.doc", "f.sub", "f.at", "m", again.alias("again"))


def _windows(length: int):
    """Rows (doc, sub, text, places of zones) -> (doc, sub, pos, h1, h2) of every window of the zones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(5)]
            for doc, sub, text, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                joined, _, size = plain(text.as_buffer().to_pybytes())
                at = places.values.to_numpy()
                first, n = at >> 7, at & WINDOWS
                pos = np.unique(np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum())))
                pos = pos[pos + length <= len(size)]
                stop = np.cumsum(size + 1) - 1
                h = digests(joined, stop[pos] - size[pos], stop[pos + length - 1])
                for column, v in zip(out, (np.full(len(pos), doc, np.int64), np.full(len(pos), sub, np.int64), pos, h[:, 0], h[:, 1])):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], ["doc", "sub", "pos", "h1", "h2"])

    return run


def _remove(length: int):
    """(doc_id, text, ranges) -> counts, and the words outside the ranges joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], []]
            for text, ranges in zip(b.column(1), b.column(2)):
                data = text.as_buffer()
                data = data.to_pybytes() if data is not None else b""
                at = ranges.values.to_numpy() if ranges.is_valid else ()
                n, left, parts = 0, 0, []
                if len(at):
                    first, last = at >> 7, (at >> 7) + (at & WINDOWS) - 1 + length
                for part in word_parts(data):
                    words = part.split()
                    if len(at):
                        cover = np.zeros(len(words) + 1, np.int64)
                        here = (first < n + len(words)) & (last > n)
                        np.add.at(cover, np.maximum(first[here] - n, 0), 1)
                        np.add.at(cover, np.minimum(last[here] - n, len(words)), -1)
                        kept = [w for w, c in zip(words, np.cumsum(cover).tolist()) if not c]
                    else:
                        kept = words
                    n, left = n + len(words), left + len(kept)
                    if kept:
                        parts.append(b" ".join(kept))
                for column, v in zip(out, (n, n - left, b" ".join(parts))):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.binary()))]], ["doc_id", "n_words", "n_removed", "kept"])

    return run


LAST = (1 << 63) - 1


def dedup(docs: DataFrame, length: int = LENGTH, piece: int = PIECE, batches: int = 4) -> DataFrame:
    """One row (doc_id, n_words, n_removed, kept) for each row of ``docs`` (doc_id, text).

    ``kept`` are the words, joined by one space, outside every ``length``-word window whose words also
    start in a document with a smaller doc_id. ``batches`` is how many steps of doc_id order the index is
    built in; it changes no result. Null and blank texts have no words. Rows without doc_id come after all
    others, as one document; rows that repeat a doc_id are one document too: its rows, whatever their texts,
    never remove each other's words, and each loses what earlier documents have. Very long texts are hashed in
    parts of a megabyte; about three times a text's bytes are held at once. Other columns are ignored. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    # Rows of one document are told apart by their texts, so that a range is never applied to another text.
    key = [F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("sub")]
    texts = docs.select("doc_id", *key, "text")
    cuts = docs.agg(F.percentile_approx(key[0], [i / batches for i in range(1, batches)], 10000)).first()[0] if batches > 1 else []
    cuts = sorted({c for c in cuts or [] if c < LAST})
    index, found = RunIndex(spark), []
    try:
        for lo, hi in zip([None, *cuts], [*cuts, None]):
            batch = docs
            if lo is not None:
                batch = batch.filter((F.col("doc_id") > lo) | F.col("doc_id").isNull())
            if hi is not None:
                batch = batch.filter(F.col("doc_id") <= hi)
            seen = settle(batch.select(*key, "text").mapInArrow(_zones(length, piece), "a long, z long, y long, doc long, sub long, at long"), "zones")
            met = index.append(distinct_zones(seen))
            # Rows of earlier documents' zones, and all places of zones that their first document repeats.
            hits = seen.join(met, ZONE).filter("doc > first or again")
            found.append(settle(hits.select(*ZONE, "doc", "sub", "at", (F.col("doc") > F.col("first")).alias("out")), "found"))
            discard(seen, met)
        table = spark.table(index.compact())
        # Fingerprints with zones that differ: their windows are verified.
        several = table.groupBy("a").agg(F.count("*").alias("n"), F.min("doc").alias("low"), F.max("doc").alias("high")).filter("n > 1 and low < high").select("a")
        with _merging(spark):
            contested = settle(table.join(several, "a").select(*ZONE, "doc", "sub", "at", "again"), "contested")
    finally:
        index.drop()
    places = contested.select("doc", "sub", "at")
    repeated = contested.filter("again").select(*ZONE)
    for part in found:
        places = places.unionByName(part.filter("not out").join(repeated, ZONE, "left_semi").select("doc", "sub", "at"))
    places = places.groupBy("doc", "sub").agg(F.collect_set("at").alias("places"))
    windows = settle(texts.filter("text is not null").join(places, ["doc", "sub"]).select("doc", "sub", "text", "places").mapInArrow(_windows(length), "doc long, sub long, pos long, h1 long, h2 long"), "windows")
    least = windows.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").select("h1", "h2", "first")
    verified = settle(windows.join(least, ["h1", "h2"]).filter("doc > first").select("doc", "sub", F.shiftleft("pos", 7).bitwiseOR(F.lit(1).cast("long")).alias("at")), "verified")
    discard(windows, contested)
    ranges = verified
    for part in found:
        ranges = ranges.unionByName(part.filter("out").select("doc", "sub", "at"))
    ranges = ranges.groupBy("doc", "sub").agg(F.collect_set("at").alias("ranges"))
    done = texts.join(ranges, ["doc", "sub"], "left").select("doc_id", "text", "ranges")
    return done.mapInArrow(_remove(length), "doc_id long, n_words long, n_removed long, kept binary").withColumn("kept", F.col("kept").cast("string"))
