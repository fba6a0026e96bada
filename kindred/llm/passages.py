"""Suffix-array deduplication of byte strings that are found anywhere else.

Every window of ``length`` bytes is represented by its minimizer (see rolling.py). Zones of windows whose
anchor is found once need no further look. Equal zones are copies of one another, and collapse to
one text with a count. Texts of one anchor that differ meet in one task: they are laid end to end, cut
into phrases at places that their content determines, and the phrase sequence is suffix-sorted by
Lyndon groups (suffixes.py). Windows that start with the same bytes before the same phrase order stand
next to each other, where all their bytes are compared; a window that stands for two places or more is
removed. An anchor with more than ``crowd`` different texts is not gathered: its windows are counted
one by one, spread over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.rolling import BYTE, U, Sums, zones
from kindred.llm.store import discard, settle
from kindred.llm.suffixes import suffix_array

LENGTH, PIECE = 200, 64
CHUNK = 1 << 20
CROWD = 2000


def row_key(docs: DataFrame) -> Column:
    """One key for all rows of equal doc_id and text: copies of a row share their fate."""
    return F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit("")))


def chunks(batches: Iterator[pa.RecordBatch], overlap: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(keys, offsets, pieces) of about CHUNK bytes; longer texts are cut with ``overlap`` bytes in common."""
    keys, offsets, parts, size = [], [], [], 0
    for b in batches:
        for key, text in zip(b.column(0).to_pylist(), b.column(1)):
            data = text.as_buffer()
            if data is None or len(data) <= overlap:
                continue
            data = data.to_pybytes()
            for at in range(0, max(1, len(data) - overlap), CHUNK):
                keys.append(key)
                offsets.append(at)
                parts.append(data[at : at + CHUNK + overlap])
                size += len(parts[-1])
                if size >= CHUNK:
                    yield keys, offsets, parts
                    keys, offsets, parts, size = [], [], [], 0
    if keys:
        yield keys, offsets, parts


def _occurrences(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, offsets, parts in chunks(batches, length - 1):
            raw = np.frombuffer(b"".join(parts), np.uint8)
            ends = np.cumsum([len(p) for p in parts])
            a, z, first, n = zones(Sums(BYTE[raw]), ends, length, k)
            doc = np.searchsorted(ends, first, side="right")
            at = first - (ends - np.array([len(p) for p in parts]))[doc] + np.array(offsets, np.int64)[doc]
            columns = [a.view(np.int64), z.view(np.int64), np.array(keys, np.int64)[doc], at << 16 | n]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "z", "key", "span"])

    return run


def _contents(length: int):
    """Rows (key, text, zones of it) -> (a, z, m, content) or, for crowded anchors, (a, z, m, window, h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for text, found in zip(b.column(0), b.column(1)):
                data = memoryview(text.as_buffer())
                for r in found.as_py():
                    at, n = r["span"] >> 16, r["span"] & 0xFFFF
                    if r["crowded"]:
                        for w in range(n):
                            for column, v in zip(out, (r["a"], r["z"], r["m"], None, w, hashlib.blake2b(data[at + w : at + w + length], digest_size=16).digest())):
                                column.append(v)
                    else:
                        for column, v in zip(out, (r["a"], r["z"], r["m"], bytes(data[at : at + n - 1 + length]), None, None)):
                            column.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["a", "z", "m", "content", "window", "h"])

    return run


def repeated_windows(texts: list[bytes], copies: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each text, which windows stand for two places or more over all ``texts`` with ``copies``."""
    size = np.array([len(t) for t in texts], np.int64)
    stop = np.cumsum(size)
    raw = np.frombuffer(b"".join(texts) + bytes(length + 8), np.uint8)
    total = int(stop[-1]) if len(stop) else 0
    if not total or int(size.max()) < length:
        return [np.zeros(0, bool) for _ in texts]
    word = raw[: total + length].astype(U)
    for shift in (1, 2, 4):
        word = word[: len(word) - shift] | (word[shift:] << U(8 * shift))
    # Phrases start where the next four bytes hash low, and at the start of each text.
    cut = ((((word[:total] & U(0xFFFFFFFF)) * U(0x9E3779B97F4A7C15)) >> U(40)) % U(20)) == 0
    start_of = stop - size
    owner = np.repeat(np.arange(len(texts)), size)
    inside = np.arange(total) + 4 <= stop[owner]
    cut &= inside
    head = np.zeros(total, bool)
    head[start_of[size > 0]] = True
    starts = np.flatnonzero(cut | head)
    text_of = owner[starts]
    following = np.append(starts[1:], total)
    ends_text = np.append(text_of[1:] != text_of[:-1], True)
    until = np.where(ends_text, stop[text_of], np.minimum(following + 4, stop[text_of]))
    buffer = raw.tobytes()
    phrases = [buffer[s:e] for s, e in zip(starts.tolist(), until.tolist())]
    rank = {p: i + 2 for i, p in enumerate(sorted(set(phrases)))}
    symbols: list[int] = []
    where = np.empty(len(starts), np.int64)
    for i, (p, e) in enumerate(zip(phrases, ends_text.tolist())):
        where[i] = len(symbols)
        symbols.append(rank[p])
        if e:
            symbols.append(1)
    order = np.empty(len(symbols), np.int64)
    order[np.array(suffix_array(symbols), np.int64)] = np.arange(len(symbols))
    windows = np.maximum(0, size - length + 1)
    at = np.repeat(start_of - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    if not len(at):
        return [np.zeros(0, bool) for _ in texts]
    # A phrase that starts inside the window orders what follows; heads of texts aren't such phrases.
    real = cut[starts]
    next_real = np.append(starts[real], 1 << 60)
    j = np.searchsorted(next_real, at)
    q = np.where(next_real[j] + 4 <= at + length, next_real[j], at + length)  # else bytes beyond the window decide
    follow = np.where(q < at + length, order[where[np.flatnonzero(real)]][np.minimum(j, max(0, int(real.sum()) - 1))] if real.any() else 0, 0)
    before = Sums(BYTE[raw[:total]]).span(at, q) ^ (q - at).astype(U)
    by = np.lexsort((follow, before))
    s = at[by]
    same = before[by][1:] == before[by][:-1]
    for o in [*range(0, length - 8, 8), length - 8]:
        left = np.flatnonzero(same)
        same[left] = word[s[left] + o] == word[s[left + 1] + o]
    group = np.concatenate([[0], np.cumsum(~same)])
    weight = np.bincount(group, copies[owner[s]].astype(np.float64))
    hit = np.empty(len(at), bool)
    hit[by] = weight[group] >= 2
    return np.split(hit, np.cumsum(windows)[:-1])


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of the maximal runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


def _sorted_buckets(length: int, most: int = 1 << 19):
    """Texts in order of anchor -> (a, z, from, to): runs of windows that are repeated."""

    def close(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        if rows:
            found = repeated_windows([r[3] for r in rows], np.array([r[2] for r in rows]), length)
            for (a, z, _, _), hit in zip(rows, found):
                for lo, hi in runs(hit):
                    for column, v in zip(out, (a, z, lo, hi)):
                        column.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["a", "z", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for b in batches:
            for a, z, m, content in zip(*(b.column(i).to_pylist() for i in range(4))):
                if (a, z) == last:
                    continue  # the same row of the input came twice
                if size > most and a != held[-1][0]:
                    yield close(held)
                    held, size = [], 0
                held.append((a, z, m, content))
                size += len(content)
                last = (a, z)
        yield close(held)

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, piece: int = PIECE, crowd: int = CROWD) -> DataFrame:
    """(key, start, stop): byte ranges of ``docs`` (doc_id, text) covered by strings of ``length`` bytes
    that also start elsewhere. ``key`` is row_key(); ranges may touch or overlap."""
    spark = docs.sparkSession
    texts = docs.select(row_key(docs).alias("key"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    seen = settle(texts.mapInArrow(_occurrences(length, piece), "a long, z long, key long, span long"), "occurrences")
    several = settle(seen.groupBy("a").agg(F.count("*").alias("n"), (F.min("z") != F.max("z")).alias("mixed")).filter("n > 1").select("a", "mixed"), "anchors")
    hits = settle(seen.join(several, "a"), "hits")
    discard(seen, several)
    counted = hits.groupBy("a", "z").agg(F.count("*").alias("m"), F.min(F.struct("key", "span")).alias("first"), F.first("mixed").alias("mixed"))
    mixed = settle(counted.filter("mixed").select("a", "z", "m", "first.*"), "zones")
    crowded = mixed.groupBy("a").agg(F.count("*").alias("n")).select("a", (F.col("n") > crowd).alias("crowded"))
    asked = mixed.join(crowded, "a").groupBy("key").agg(F.collect_list(F.struct("a", "z", "m", "span", "crowded")).alias("zones"))
    fetched = texts.join(asked, "key").select("text", "zones").mapInArrow(_contents(length), "a long, z long, m long, content binary, window int, h binary")
    fetched = settle(fetched, "contents")
    ordered = fetched.filter("content is not null").select("a", "z", "m", "content").repartition("a").sortWithinPartitions("a", "z")
    found = ordered.mapInArrow(_sorted_buckets(length), "a long, z long, lo int, hi int")
    singles = fetched.filter("content is null").dropDuplicates(["a", "z", "window"])
    often = singles.groupBy("h").agg(F.sum("m").alias("n")).filter("n > 1").select("h")
    found = settle(found.unionByName(singles.join(often, "h").select("a", "z", F.col("window").alias("lo"), F.col("window").alias("hi"))), "windows")
    discard(fetched)
    at, n = F.shiftright("span", 16), F.col("span").bitwiseAND(F.lit(0xFFFF))
    # An anchor with equal zones only is repeated as a whole wherever it stands, and so is any zone with copies.
    whole = hits.filter("not mixed").unionByName(hits.filter("mixed").join(mixed.filter("m > 1").select("a", "z"), ["a", "z"], "left_semi"))
    parts = hits.filter("mixed").join(found, ["a", "z"])
    out = whole.select("key", at.alias("start"), (at + n - 1 + length).alias("stop")).unionByName(parts.select("key", (at + F.col("lo")).alias("start"), (at + F.col("hi") + length).alias("stop")))
    return settle(out, "ranges")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, ranges) -> what is left of each text, and counts."""
    for b in batches:
        out: list[list] = [[], [], [], []]
        for text, ranges in zip(b.column(1), b.column(2)):
            data, at, spans, kept = memoryview(text.as_buffer()), 0, 0, []
            edge = -1
            for r in sorted((r["start"], r["stop"]) for r in ranges.as_py() or ()):
                if r[0] > edge:
                    spans += 1
                if r[0] > at:
                    kept.append(data[at : r[0]])
                at, edge = max(at, r[1]), max(edge, r[1])
            kept.append(data[at:])
            left = b"".join(kept)
            for column, v in zip(out, (len(data), len(data) - len(left), spans, left)):
                column.append(v)
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def dedup(docs: DataFrame, length: int = LENGTH, piece: int = PIECE, crowd: int = CROWD) -> DataFrame:
    """One row (doc_id, n_bytes, n_removed, n_spans, kept) for each row of ``docs`` (doc_id, text).

    ``kept`` are the UTF-8 bytes outside every ``length``-byte string that also starts at another place
    of the table, the same row included; all such strings go, first places too. Null texts are
    empty; texts shorter than ``length`` lose nothing; repeated rows are copies of one another, so each
    loses what it shares. Other columns are ignored. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranges = repeated_spans(docs, length, piece, crowd).groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), row_key(docs).alias("key"))
    return texts.join(ranges, "key", "left").select("doc_id", "text", "ranges").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
