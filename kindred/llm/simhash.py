"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits agree up to ``radius // 2`` bits in at least one 32-bit
half. Every distinct fingerprint therefore emits, for either half, all variants of that half
within half of that radius (33 for radius 4); two fingerprints that are near in a half meet at
the variant between them. Rows are shuffled on the variant and each meeting is verified over all
64 bits. Variants of the whole word (2,081 for radius 4) would give the same links with 31 times
as many rows; they are emitted only for fingerprints of crowded variants, where every two that
meet are linked without a comparison, so that no bucket is ever compared in squares of its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.components import components
from kindred.llm.store import settle

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: A variant shared by more fingerprints than this is crowded.
CROWD = 1024


def fingerprint(text: str | None, width: int = 4) -> int:
    """64-bit SimHash of word shingles (XXH64, seed 42); a bit is 1 if set in over half of them."""
    words = (text or "").encode().translate(LOWER).split()  # bytes.split() splits on SPACE exactly
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size + 1) - (size + 1)
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(start[: 1 - width].tolist(), (start + size)[width - 1 :].tolist())), np.uint64, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp): ``fp`` is the fingerprint's 64 bits as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints(width), "doc_id long, fp long")


def masks(bits: int, radius: int) -> list[int]:
    """Every word of ``bits`` bits with at most ``radius`` ones, as signed longs."""
    out = [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in out]


def _spanning(fps: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links that join what is within ``radius`` here: at most one for each fingerprint."""
    left = np.arange(len(fps))
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            near = np.bitwise_count(fps[left] ^ fps[todo[-1]]) <= radius
            hub = todo.pop()
            for i in left[near]:
                yield int(fps[hub].view(np.int64)), int(fps[i].view(np.int64))
            todo += left[near].tolist()
            left = left[~near]


def _meet(radius: int, crowd: int):
    """Rows sorted by (variant, fp) -> links; the members of a crowded variant come out as (fp, null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, dense = None, np.empty(0, np.int64), False

        def close(held: np.ndarray) -> list[tuple[int, int | None]]:
            if len(held) < 2:
                return []
            return list(_spanning(held.view(np.uint64), radius))

        def batch(rows: list) -> pa.RecordBatch:
            a, b = zip(*rows) if rows else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for b in batches:
            k, f = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(k):
                continue
            cut = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            size = np.diff(np.append(cut, len(k)))
            # Runs of one fingerprint meet nothing: only the first run (it may go on), the last and longer ones count.
            rows: list[tuple[int, int | None]] = []
            for j in np.unique(np.concatenate([[0, len(cut) - 1], np.flatnonzero(size > 1)])):
                run_ = f[cut[j] : cut[j] + size[j]]
                if k[cut[j]] != key:
                    rows += [] if dense else close(held)
                    key, held, dense = k[cut[j]], np.empty(0, np.int64), False
                if not dense:
                    held = np.concatenate([held, run_])
                    if len(held) > crowd:
                        dense, run_, held = True, held, np.empty(0, np.int64)
                if dense:
                    rows += [(int(x), None) for x in run_]
            yield batch(rows)
        if not dense:
            yield batch(close(held))

    return run


def near_links(distinct: DataFrame, radius: int = 4, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) among the distinct fingerprints in column ``fp``.

    They join exactly what is joined by chains of fingerprints with at most ``radius`` differing
    bits; links implied by others may be left out, and no link is longer than ``radius``.
    """
    half = masks(32, radius // 2 // 2 if radius // 2 % 2 == 0 else (radius // 2 + 1) // 2)
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    flips = F.array(*[F.lit(m).cast("long") for m in half])
    variants = F.concat(F.transform(flips, lambda m: low.bitwiseXOR(m)), F.transform(flips, lambda m: high.bitwiseXOR(m).bitwiseOR(F.lit(1 << 32))))
    rows = distinct.select(F.explode(variants).alias("variant"), "fp")
    met = settle(rows.repartition("variant").sortWithinPartitions("variant", "fp").mapInArrow(_meet(radius, crowd), "a long, b long"), "met")
    full = F.array(*[F.lit(m).cast("long") for m in masks(64, (radius + 1) // 2)])
    crowded = met.filter("b is null").select(F.col("a").alias("fp")).distinct()
    balls = crowded.select(F.explode(F.transform(full, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"), "fp")
    hubs = balls.groupBy("variant").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    within = F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= radius
    stars = balls.join(hubs, "variant").filter((F.col("fp") != F.col("hub")) & within).select(F.col("hub").alias("a"), F.col("fp").alias("b"))
    links = met.filter("b is not null")
    return links.unionByName(stars).distinct() if radius % 2 == 0 and met.filter("b is null").limit(1).count() else links.distinct()


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id reachable over near fingerprints.

    Null and blank texts have fingerprint zero and are linked like any other. Rows that repeat a
    doc_id come out once each. A null doc_id is returned; it never names a component unless its
    component has no other id. Very long texts are read whole, their shingles counted in steps of 65,536.
    Other columns are ignored. An empty table gives an empty result.
    """
    if radius % 2:
        raise ValueError("the radius has to be even, so that a ball has a middle")
    marked = settle(fingerprints(docs, width), "fingerprints")
    first = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(near_links(first.select("fp"), radius, crowd))
    place = first.join(roots, first.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = place.groupBy("root").agg(F.min("first").alias("component_id"))
    place = settle(place.join(least, "root").select("fp", "component_id"), "places")
    return marked.join(place, "fp").select("doc_id", "fp", "component_id")
