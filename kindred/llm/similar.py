"""SimHash near-duplicates by the true similarity of word shingles.

simhash.py links fingerprints by a few of 64 bits, which reaches only texts that are almost the same. Here texts
are linked whose sets of ``width``-word shingles have a Jaccard similarity of ``least`` or more. The method is
the same: a text's fingerprint is cut into blocks, each of bits of its own, and every block emits all variants
within one bit of it (half of the radius of two within which blocks are looked for); rows are shuffled on the
variant, and colliding pairs are verified, by 64 bits of another block first and then by all their shingles.
There are as many blocks as bring a pair at ``least`` together with probability ``recall``; as they grow with
the number of texts, chance meetings do not. Blocks are taken in passes, so that the variants of a few blocks
are on disk at a time, and what a pass has joined is not compared again. Where more meet at a variant
than can be compared pair by pair, all are compared to the middle of them first, and only those that
are still apart after that to one another. Pairs that can't be similar, because too many shingles of one
are in no other candidate, are never made; this bound is exact and loses no pair.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.bpe import release
from kindred.llm.components import components
from kindred.llm.rolling import PART, Sums, U, mix, word_hashes, word_parts
from kindred.llm.simhash import LOWER
from kindred.llm.store import discard, settle

#: Rows of a variant that are looked at pair by pair, to tell whether any are near each other.
CROWD = 16
#: Texts that a shingle may be in to be rare: pairs that share it are made from it.
RARE = 16
#: Pairs for each text that a step may make of the crowded variants; most of them are the same pairs again.
PAIRS = 100
#: Blocks of the first pass, which joins most of what is alike, and of each pass after it; variants of FIRST blocks are on disk at a time.
FIRST, PASS = 4, 11
LANES = U(0x0101010101010101)
SEEDS = mix(np.arange(1, 65, dtype=np.uint64) * U(0x9E3779B97F4A7C15))


class Plan:
    """How many blocks of how many bits ``n`` texts take."""

    def __init__(self, n: int, least: float, recall: float):
        # Bits differ in proportion to the angle of the shingle sets.
        self.bit = math.acos(2 * least / (1 + least)) / math.pi
        self.bits = min(56, max(16, math.ceil(math.log2(max(2, n))) + 6))
        self.blocks = math.ceil(math.log(1 - recall) / math.log(1 - self.within(self.bits, 2)))
        self.each = 64 // self.bits
        #: One word more, whose bits no block next to it has.
        self.words = -(-self.blocks // self.each) + 1
        #: Differing bits of 64 that one pair in 10,000 at ``least`` exceeds.
        self.most = next(r for r in range(64) if self.within(64, r) > 0.9999)

    def within(self, bits: int, radius: int) -> float:
        return sum(math.comb(bits, r) * self.bit**r * (1 - self.bit) ** (bits - r) for r in range(radius + 1))


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles, text after text; shingles of each text).

    A text of fewer than ``width`` words is one shingle, one without words has none.
    """
    values, ends = [], []
    for t in texts:
        parts = [word_hashes(p)[0] for p in word_parts(t)]
        values += parts
        ends.append(sum(map(len, parts)))
    flat, size = np.concatenate([np.empty(0, U), *values]), np.array(ends, np.int64)
    n = np.where(size > 0, np.maximum(1, size - width + 1), 0)
    stop = np.cumsum(size)
    first = np.repeat(stop - size - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    hashes = mix(Sums(flat).span(first, np.minimum(first + width, np.repeat(stop, n))))
    owner = np.repeat(np.arange(len(texts)), n)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.bincount(owner[new], minlength=len(texts))


def fingerprints(hashes: np.ndarray, n: np.ndarray, words: int) -> np.ndarray:
    """(texts, words): SimHash fingerprints of sets of shingle hashes; 0 for texts without any."""
    out = np.zeros((len(n), words), U)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    size = n[some]
    # Set bits are counted in bytes of a word, for at most 255 shingles at a time.
    k = -(-size // 255)
    start = np.repeat(np.cumsum(size) - size - 255 * (np.cumsum(k) - k), k) + 255 * np.arange(int(k.sum()))
    of_text = np.cumsum(k) - k
    for w in range(words):
        h = mix(hashes ^ SEEDS[w])
        ones = np.empty((len(size), 64), np.int64)
        for b in range(8):
            lanes = np.add.reduceat((h >> U(b)) & LANES, start)
            ones[:, b::8] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), of_text, axis=0)
        out[some, w] = np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view(U)[:, 0]
    return out


def _folded(texts: pa.Array) -> Iterator[list[bytes]]:
    """Lower-cased texts, about a part at a time."""
    out, size = [], 0
    for t in texts:
        out.append(t.as_buffer().to_pybytes().translate(LOWER))
        size += len(out[-1])
        if size >= PART:
            yield out
            out, size = [], 0
    if out:
        yield out


def _signed(width: int, words: int):
    """(id, text) -> (id, fingerprint words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            done = [fingerprints(*shingle_sets(part, width), words) for part in _folded(b.column(1))]
            flat = np.concatenate([np.empty(0, U), *[d.reshape(-1) for d in done]]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, words), pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["key", "words"])

    return run


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of shingles; texts without words are equal."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _sets(width: int):
    """(id, text) -> (id, shingles): the sorted hashes of a text's distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [shingle_sets(part, width) for part in _folded(b.column(1))]
            flat = np.concatenate([np.empty(0, U), *[h for h, _ in done]]).view(np.int64)
            ends = np.cumsum(np.concatenate([[0], *[n for _, n in done]]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["id", "shingles"])

    return run


def _verify(least: float):
    """(a, b, shingles of a, shingles of b) -> the pairs (a, b) that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for c in (batch.column(2), batch.column(3)):
                values, ends = c.values.to_numpy(), c.offsets.to_numpy()
                sets.append([values[i:j] for i, j in zip(ends[:-1], ends[1:])])
            same = pa.array([similarity(x, y) >= least for x, y in zip(*sets)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(same) for i in (0, 1)], ["a", "b"])

    return run


def _meet(most: int, crowd: int):
    """(variant, id, root, check) sorted by variant -> members (variant, id, check) near one of another root, and all of crowded variants."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def members(rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[k])) for k in (0, 1, 3)], ["variant", "id", "check"])

        def close(rows: np.ndarray) -> pa.RecordBatch:
            v, _, r, c = rows
            stay = np.zeros(len(v), bool)
            if len(v) > crowd:
                at = np.flatnonzero(v[crowd:] == v[:-crowd])
                stay = np.isin(v, np.unique(v[at]))
            dense = stay.copy()
            for off in range(1, min(crowd, len(v) - 1) + 1):
                same = np.flatnonzero((v[off:] == v[:-off]) & (r[off:] != r[:-off]) & ~dense[off:])
                near = same[np.bitwise_count((c[same] ^ c[same + off]).view(np.uint64)) <= most]
                stay[near] = stay[near + off] = True
            return members(rows[:, stay])

        held, going = np.empty((4, 0), np.int64), None
        for b in batches:
            rows = np.concatenate([held, np.stack([b.column(i).to_numpy() for i in range(4)])], axis=1)
            if not rows.shape[1]:
                continue
            last = rows[0, -1]
            if going is not None:
                # A crowded variant that goes on: its members pass through and are not kept.
                yield members(rows[:, rows[0] == going])
                rows = rows[:, rows[0] != going]
                if last == going:
                    held = rows
                    continue
                going = None
            whole = rows[0] != last
            held = rows[:, ~whole]
            yield close(rows[:, whole])
            if held.shape[1] > crowd:
                yield members(held)
                held, going = np.empty((4, 0), np.int64), last
        yield close(held)

    return run


def _rare(most: int):
    """(h, id) sorted by h -> (id, h, 0) for each shingle of 2 to ``most`` texts; (id, null, n) for n shingles that no other text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(h: np.ndarray, i: np.ndarray) -> pa.RecordBatch:
            first = np.ones(len(h), bool)
            first[1:] = h[1:] != h[:-1]
            n = np.diff(np.append(np.flatnonzero(first), len(h)))
            n = np.repeat(n, n)
            some = (n > 1) & (n <= most)
            alone, times = np.unique(i[n == 1], return_counts=True)
            ids = pa.array(np.concatenate([i[some], alone]))
            hashes = pa.concat_arrays([pa.array(h[some]), pa.nulls(len(alone), pa.int64())])
            return pa.RecordBatch.from_arrays([ids, hashes, pa.array(np.concatenate([np.zeros(int(some.sum()), np.int64), times]))], ["id", "h", "n"])

        held: list[np.ndarray] = [np.empty(0, np.int64)] * 2
        for b in batches:
            if not b.num_rows:
                continue
            h, i = (np.concatenate([x, b.column(k).to_numpy()]) for k, x in enumerate(held))
            whole = int(np.searchsorted(h, h[-1]))
            # Of a shingle that goes on no more is held than tells that it is not rare.
            held = [h[whole:][: most + 1], i[whole:][: most + 1]]
            yield told(h[:whole], i[:whole])
        yield told(*held)

    return run


def _variants(nodes: DataFrame, plan: Plan, blocks: range) -> DataFrame:
    """(variant, id, root, check) of every node (id, root, words): each block as it is, and with each of its bits flipped."""
    full = (1 << plan.bits) - 1
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(plan.bits)])

    def one(k: int):
        word = k // plan.each
        bits = F.shiftrightunsigned(F.col("words")[word], k % plan.each * plan.bits).bitwiseAND(F.lit(full))
        return F.struct(bits.bitwiseOR(F.lit(k << 56)).alias("v"), F.col("words")[word + 1].alias("check"))

    blocked = nodes.select("id", "root", F.explode(F.array(*[one(k) for k in blocks])).alias("k")).select("id", "root", "k.v", "k.check", flips.alias("flips"))
    return blocked.select("v", "id", "root", "check", F.explode("flips").alias("flip")).select(F.col("v").bitwiseXOR(F.col("flip")).alias("variant"), "id", "root", "check")


def _likely(rows: DataFrame, some: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is in ``some``, and one in 16 or so of the others: what needn't be shuffled stays where it is."""
    slot = F.pmod(F.xxhash64(key), F.lit(16 * max(1, some.count())))
    bucket, bit = F.bitmap_bucket_number(slot), F.bitmap_bit_position(slot)
    marks = F.broadcast(some.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(bit).alias("_marks")))
    byte = F.conv(F.hex(F.substring("_marks", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.join(marks, bucket == F.col("_bucket")).filter(F.getbit(byte, (bit % 8).cast("int")) == 1).select(*rows.columns)


def similar_groups(docs: DataFrame, width: int = 5, least: float = 0.8, recall: float = 0.99) -> DataFrame:
    """(text_key, root): one row for each different text of ``docs`` (column text), root equal for texts of one component.

    ``text_key`` is text_key() of the text. Texts are compared by their words, A-Z lower-cased; null and
    blank texts are alike. Very long texts are hashed in parts; equal texts are one. Other columns are
    ignored. An empty table gives an empty result.
    """
    plan = Plan(docs.count(), least, recall)
    keyed = docs.select(text_key(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    signed = settle(keyed.mapInArrow(_signed(width, plan.words), "key binary, words array<long>"), "signed")
    nodes = settle(signed.groupBy("key").agg(F.first("words").alias("words")).select("key", F.monotonically_increasing_id().alias("id"), "words"), "nodes")
    discard(signed)
    limit = PAIRS * nodes.count()
    links: list[DataFrame] = []
    roots = None

    def facts(ids: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(id, shingles) and (id, size, rare, core, first) of the texts ``ids``.

        Shingles in one of these texts, then those in up to RARE, then all others, each kind in order of its hashes: the
        prefixes of two similar texts in that order have one in common. ``first`` are the shingles of a text's
        prefix that a few others have; its prefix has others too only in a ``core`` text.
        """
        keys = settle(nodes.join(ids, "id").select("id", "key"), "keys")
        made.append(keys)
        texts = _likely(keyed, keys, "key").join(keys, "key").groupBy("key").agg(F.first("id").alias("id"), F.first("text").alias("text")).select("id", "text")
        sets = settle(texts.mapInArrow(_sets(width), "id long, shingles array<long>"), "sets")
        each = sets.select(F.explode("shingles").alias("h"), "id").repartition("h").sortWithinPartitions("h")
        told = each.mapInArrow(_rare(RARE), "id long, h long, n long").groupBy("id").agg(F.sum("n").alias("lone"), F.collect_list("h").alias("few"))
        sized = sets.select("id", F.size("shingles").alias("size")).join(told, "id", "left")
        lone, few = F.coalesce("lone", F.lit(0)), F.coalesce("few", F.array().cast("array<long>"))
        prefix = F.col("size") - F.ceil(least * F.col("size") - 1e-6) + 1
        rare = lone + F.size(few)
        first = F.slice(F.sort_array(few), 1, F.greatest(prefix - lone, F.lit(0)).cast("int"))
        return sets, settle(sized.select("id", "size", rare.alias("rare"), (rare < prefix).alias("core"), first.alias("first")), "sizes")

    def fit(a: str, b: str) -> Column:
        """Whether two texts that share no rare shingle can be similar: they share at most the others of either."""
        most = F.least(F.col(f"size{a}") - F.col(f"rare{a}"), F.col(f"size{b}") - F.col(f"rare{b}"))
        return (1 + least) * most >= least * (F.col(f"size{a}") + F.col(f"size{b}")) - 1e-6

    def sharing(sizes: DataFrame) -> DataFrame:
        """Pairs (a, b) of different roots that share a rare shingle of their prefixes: at most RARE for each."""
        rows = rooted(sizes.select("id", F.explode("first").alias("h")))
        ab = [rows.select("h", F.col("id").alias(e), F.col("root").alias(f"root{e}")) for e in "ab"]
        return ab[0].join(ab[1], "h").filter((F.col("a") < F.col("b")) & (F.col("roota") != F.col("rootb"))).select("a", "b")

    def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        pairs = settle(pairs.distinct(), "candidates")
        left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
        both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb")
        out = settle(both.mapInArrow(_verify(least), "a long, b long"), "similar")
        discard(pairs)
        return out

    def join(found: DataFrame) -> None:
        nonlocal roots
        if not found.limit(1).count():
            return
        links.append(found)
        every = links[0]
        for more in links[1:]:
            every = every.unionByName(more)
        before, roots = roots, settle(components(every), "roots")
        if before is not None:
            discard(before)

    def rooted(rows: DataFrame) -> DataFrame:
        if roots is None:
            return rows.withColumn("root", F.col("id"))
        return rows.join(roots.select(F.col("node").alias("id"), F.col("root").alias("r")), "id", "left").withColumn("root", F.coalesce("r", "id")).drop("r")

    def meeting(blocks: range) -> DataFrame:
        """Members (variant, id, check) of the variants where texts of different roots meet, a few blocks on disk at a time."""
        parts = []
        for at in range(blocks.start, blocks.stop, FIRST):
            rows = _variants(rooted(nodes.select("id", "words")), plan, range(at, min(blocks.stop, at + FIRST))).repartition("variant").sortWithinPartitions("variant")
            parts.append(settle(rows.mapInArrow(_meet(plan.most, CROWD), "variant long, id long, check long"), "met"))
        made.extend(parts)
        return functools.reduce(DataFrame.unionByName, parts)

    at = 0
    while at < plan.blocks:
        made: list[DataFrame] = []
        blocks = range(at, min(plan.blocks, at + (PASS if at else FIRST)))
        at = blocks.stop
        left = meeting(blocks)
        # Variants whose members are all in one component are done.
        open_ = rooted(left).groupBy("variant").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
        left = settle(left.join(open_.select("variant"), "variant"), "open")
        discard(*made)
        made = [left]
        if left.limit(1).count():
            sets, sizes = facts(left.select("id").distinct())
            made += [sets, sizes]
            # What shares a rare shingle is compared at once; others only where they meet, and only if nearly all that they hold is common.
            pairs = sharing(sizes)
            left = left.join(sizes.filter("core").select("id", "size", "rare"), "id")
            # The first pass joins most copies by stars; after it few pairs are left.
            pending, here, starred = True, None, roots is not None
            while True:
                rows = rooted(left)
                small = rows.groupBy("variant").agg(F.min("size").alias("small"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
                rows = rows.join(small.select("variant", "small"), "variant").filter((1 + least) * (F.col("size") - F.col("rare")) >= least * (F.col("size") + F.col("small")) - 1e-6).drop("small")
                per = rows.groupBy("variant", "root").agg(F.count("*").alias("n"), F.min(F.struct((F.col("rare") / F.greatest("size", F.lit(1))).alias("share"), "id")).alias("least"))
                across = ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("across")
                open_ = per.groupBy("variant").agg(F.min("least").alias("hub"), F.count("*").alias("roots"), across).filter("roots > 1")
                before, here = here, settle(rows.join(open_.select("variant", F.col("hub.id").alias("hub"), "across"), "variant"), "crowded")
                if before is not None:
                    discard(before)
                wanted = here.filter("id = hub").agg(F.sum("across")).first()[0] or 0
                ab = [here.select("variant", *[F.col(c).alias(f"{c}{e}") for c in ("id", "check", "root", "size", "rare", "hub")]) for e in "ab"]
                near = (F.bit_count(F.col("checka").bitwiseXOR(F.col("checkb"))) <= plan.most) & (F.col("roota") != F.col("rootb")) & fit("a", "b")
                crowded = wanted > limit or (wanted > 0 and not starred)
                if crowded:
                    # All members are compared to the one of the least share of rare shingles, the middle of its copies.
                    found = ab[0].filter("ida = huba").join(ab[1], "variant").filter(near)
                    left = here.filter("id != hub").select("variant", "id", "check", "size", "rare") if starred else left
                    starred = True
                else:
                    found = ab[0].join(ab[1], "variant").filter((F.col("ida") < F.col("idb")) & near)
                found = found.select(F.col("ida").alias("a"), F.col("idb").alias("b"))
                if wanted or pending:
                    join(verified(found.unionByName(pairs) if wanted and pending else found if wanted else pairs, sets))
                pending = False
                if not crowded:
                    break
            made.append(here)
        discard(*made)
    return rooted(nodes.select("key", "id")).select(F.col("key").alias("text_key"), "root")


def text_key(text):
    """MD5 of a text, null like the empty one: which texts are the same."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))
