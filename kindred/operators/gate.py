"""The likeness gate: members of a set whose size or content differs too much are set aside.

Sets that are plainly alike are passed by window expressions. The rest are contested. Members of one size and
body (of one size, where contents aren't compared) have the same offences, so a set is judged by such classes:
the first member that goes is followed by all of its class, as its offences stay while those of others fall.
A class with its count and least name is all that a set's task holds.

Bodies without a common line have a diff whose length follows from their line counts and lengths. Only pairs
that share lines and may therefore be judged otherwise are compared; they come from a join on lines, rarest
first, that loses none of them (see ``exceptions``). What is held is linear in classes and exceptions.
"""

from __future__ import annotations

import difflib
import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.settle import settle

# Characters of a unified diff's two title lines, and of a hunk's header besides its ranges.
TITLES, HUNK = 12, 10


def diff_length(a: list[str], b: list[str]) -> int:
    """Characters of the unified diff without context of two bodies."""
    return sum(map(len, difflib.unified_diff(a, b, fromfile="a", tofile="b", n=0, lineterm="\n")))


def within(a: list[str], b: list[str], limit: int) -> bool:
    """Is the diff no longer than ``limit``? Lines that no line of the other equals are enough to say no."""
    if a == b:
        return True
    apart, back = Counter(a), Counter(b)
    apart.subtract(back)
    if TITLES + HUNK + 2 + sum(abs(n) * (len(x) + 1) for x, n in apart.items()) > limit:
        return False
    return diff_length(a, b) <= limit


def cost(lines: list[str]) -> int:
    """What a body adds to the diff with one that it shares no line with: its lines, marked, and its range."""
    n = len(lines)
    return sum(map(len, lines)) + n + (1 if n == 1 else 2 + len(str(n)))


def outcasts(size: np.ndarray, cost: np.ndarray, count: np.ndarray, one: np.ndarray, two: np.ndarray, like: np.ndarray, size_threshold: int, content_threshold: int) -> np.ndarray:
    """Which classes, given in order of their least names, are set aside.

    Two classes are alike if their sizes and the sum of their costs allow it, but for the pairs (one, two), which
    are as ``like`` says and not as their costs. Fewest alike is most offences. Classes of equal size and cost are
    of one kind; all that are alike by no cost make up the last kind.
    """
    n, room = len(size), content_threshold - TITLES - HUNK if content_threshold >= 0 else 0
    able = cost <= room - cost.min()
    kinds, kind = np.unique(np.stack([size[able], cost[able]]), axis=1, return_inverse=True)
    k = kinds.shape[1]
    of = np.full(n, k)
    of[able] = kind.reshape(-1)
    low = np.searchsorted(kinds[0], kinds[0] - size_threshold) if size_threshold >= 0 else np.zeros(k, int)
    high = np.searchsorted(kinds[0], kinds[0] + size_threshold, "right") if size_threshold >= 0 else np.full(k, k)
    total = np.bincount(of, count, k + 1).astype(np.int64)
    alike = np.zeros(k + 1, np.int64)
    for t in range(k):
        alike[t] = total[low[t] : high[t]][kinds[1, low[t] : high[t]] <= room - kinds[1, t]].sum()
    own = np.append(2 * kinds[1] <= room, False)[of]
    extra = np.where(own, 0, count).astype(np.int64)
    sign = np.where(like, 1, -1)
    np.add.at(extra, one, sign * count[two])
    np.add.at(extra, two, sign * count[one])
    a, b, s = np.concatenate([one, two]), np.concatenate([two, one]), np.concatenate([sign, sign])
    order = np.argsort(a, kind="stable")
    b, s, start = b[order].tolist(), s[order].tolist(), np.searchsorted(a[order], np.arange(n + 1)).tolist()
    extra, weight, of = extra.tolist(), count.tolist(), of.tolist()
    never = np.iinfo(np.int64).max // 4
    heaps: list[list[tuple[int, int]]] = [[] for _ in range(k + 1)]
    for i in range(n):
        heaps[of[i]].append((extra[i], i))
    out, first, fewest = np.zeros(n, bool), np.full(k + 1, n), np.full(k + 1, never)

    def look(t: int) -> None:
        heap = heaps[t]
        while heap and (out[heap[0][1]] or extra[heap[0][1]] != heap[0][0]):
            heapq.heappop(heap)
        first[t], fewest[t] = (heap[0][1], alike[t] + heap[0][0]) if heap else (n, never)

    for t in range(k + 1):
        heapq.heapify(heaps[t])
        look(t)
    left = sum(weight)
    while left:
        least = fewest.min()
        if least >= left:
            break
        i = int(first[fewest == least].min())
        t, w = of[i], weight[i]
        out[i] = True
        left -= w
        if t < k:
            lost = np.where(kinds[1, low[t] : high[t]] <= room - kinds[1, t], w, 0)
            alike[low[t] : high[t]] -= lost
            fewest[low[t] : high[t]] -= lost
        changed = {t}
        for at in range(start[i], start[i + 1]):
            j = b[at]
            if not out[j]:
                extra[j] -= s[at] * w
                heapq.heappush(heaps[of[j]], (extra[j], j))
                changed.add(of[j])
        for t in changed:
            look(t)
    return out


def reason(size: np.ndarray, count: np.ndarray, out: np.ndarray, size_threshold: int) -> str | None:
    """Why a set is skipped: fewer than two of its members are left."""
    if not out.any() or count[~out].sum() >= 2:
        return None
    return "skipped_size" if 0 <= size_threshold < size.max() - size.min() else "skipped_content"


def evict(members: list[tuple[str, int, str, list[str] | None]], size_threshold: int, content_threshold: int) -> tuple[set[str], str | None]:
    """(reprs that are set aside, reason to skip the set if fewer than two are left), for a set held here as a whole.

    ``members`` are (repr, size, body hash, lines). Two offend each other if their sizes differ by
    more than one threshold or else their diff is longer than the other; -1 turns a test off. The member
    with most offences goes first, then the one of least repr, until none is left. A diff depends on
    its direction: it runs from the body of the member of least repr.
    """
    classes: dict[tuple[int, str], list[str]] = {}
    bodies: dict[str, list[str]] = {}
    for name, size, digest, lines in sorted(members):
        classes.setdefault((size, digest), []).append(name)
        bodies.setdefault(digest, lines or [])
    kinds = list(classes)  # in order of least repr
    size, count = np.array([s for s, _ in kinds], np.int64), np.array([len(m) for m in classes.values()], np.int64)
    costs = np.array([cost(bodies[d]) if content_threshold >= 0 else 0 for _, d in kinds], np.int64)
    odd = []
    for i, (size_a, a) in enumerate(kinds if content_threshold >= 0 else ()):
        for j in range(i + 1, len(kinds)):
            size_b, b = kinds[j]
            if not 0 <= size_threshold < abs(size_a - size_b):
                like = a == b or diff_length(bodies[a], bodies[b]) <= content_threshold
                if like != (TITLES + HUNK + costs[i] + costs[j] <= content_threshold):
                    odd.append((i, j, like))
    one, two, like = np.array(odd, np.int64).reshape(-1, 3).T
    out = outcasts(size, costs, count, one, two, like.astype(bool), size_threshold, content_threshold)
    return {name for k, gone in zip(kinds, out) if gone for name in classes[k]}, reason(size, count, out, size_threshold)


def contested(df: DataFrame, size_threshold: int, content_threshold: int) -> DataFrame:
    """``df`` (mail_hash, size, body_hash) with ``contested``: true where a set needs a closer look."""
    w = Window.partitionBy("mail_hash")
    size_ok = F.lit(True) if size_threshold < 0 else F.max("size").over(w) - F.min("size").over(w) <= size_threshold
    content_ok = F.lit(True) if content_threshold < 0 else F.min("body_hash").over(w) == F.max("body_hash").over(w)
    fine = F.lit(True) if size_threshold < 0 and content_threshold < 0 else size_ok & content_ok
    return df.withColumn("contested", ~fine & (F.count("*").over(w) > 1) & ~F.max("encoding_error").over(w))


def _added(lines: Column) -> Column:
    """Characters that lines have in a diff."""
    return F.aggregate(lines, F.lit(0).cast("bigint"), lambda n, x: n + F.length(x) + 1)


def measured(classes: DataFrame) -> DataFrame:
    """``classes`` with n_lines, weight (of all lines in a diff) and cost."""
    lines = F.coalesce("body_lines", F.array().cast("array<string>"))
    rows = classes.withColumn("body_lines", lines).withColumn("n_lines", F.size("body_lines")).withColumn("weight", _added(F.col("body_lines")))
    digits = F.length(F.col("n_lines").cast("string"))
    return rows.withColumn("cost", F.col("weight") + F.when(F.col("n_lines") == 1, 1).otherwise(2 + digits))


PAIRS = "mail_hash string, one bigint, two bigint, like boolean"


def exceptions(classes: DataFrame, size_threshold: int, content_threshold: int) -> DataFrame:
    """(mail_hash, one, two, like): the pairs of ``classes`` (settled, see ``judge``) whose diff decides otherwise than their costs.

    Both kinds share a line. A pair whose costs are too high is alike only if common lines weigh as much as the
    bound ``need`` of the pair; so in any order of lines, the first common one has as much from it to the end, in both
    bodies. Lines are taken from the rarest of the set on, for the lighter body by the bound that holds against heavier
    ones. A pair whose costs allow it offends only by headers of more hunks, between common lines that are
    shorter than half a header.
    """
    t, c = size_threshold, content_threshold
    sets = Window.partitionBy("mail_hash")
    facts = classes.select("mail_hash", "id", "size", "weight", "cost", "n_lines", (F.col("weight") - F.col("size")).alias("over"), "body_lines").filter("n_lines > 0")
    slack = facts.groupBy("mail_hash").agg(F.min("over").alias("over"), F.min("weight").alias("lightest"), F.max("n_lines").alias("most"), F.min("cost").alias("cheapest"))
    rows = facts.drop("over").join(slack, "mail_hash")
    lightest = F.greatest(F.col("weight") + 24 - c, F.col("lightest"), *([F.col("size") - t + F.col("over")] if t >= 0 else []))
    need = lambda other: F.greatest(F.lit(1), F.ceil((F.col("weight") + other + 24 - c) / 2))
    # A common line may part two hunks: it adds a header and takes its two marked copies from the diff. A header is
    # longest by the digits of the set's longest body.
    header = HUNK + 2 * (2 * F.length(F.col("most").cast("string")) + 1)
    short = lambda x: F.greatest(F.lit(0), F.col("header") - 2 * (F.length(x) + 1))
    rows = rows.select("mail_hash", "id", "size", "weight", "cost", "cheapest", need(lightest).alias("probe"), need(F.col("weight")).alias("index"), header.alias("header"), "body_lines")
    rows = rows.withColumn("bonus", F.aggregate("body_lines", F.lit(0).cast("bigint"), lambda n, x: n + short(x)))
    each = rows.select("*", F.explode("body_lines").alias("line")).drop("body_lines")
    kept = ["size", "weight", "cost", "bonus", "header"]
    lines = each.groupBy("mail_hash", "id", F.xxhash64("line").alias("line")).agg(F.sum(F.length("line") + 1).alias("mass"), F.max(short(F.col("line"))).alias("short"), *[F.first(x).alias(x) for x in (*kept, "probe", "index", "cheapest")])
    lines = lines.withColumn("common", F.count("*").over(Window.partitionBy("mail_hash", "line"))).filter("common > 1")
    # Lines of no other body come first in the order, and need no place in it.
    after = F.sum("mass").over(Window.partitionBy("mail_hash", "id").orderBy(F.desc("common"), "line").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("after", after)
    far = lines.filter("after >= probe").select("mail_hash", "line", "id", *kept, (F.col("after") >= F.col("index")).alias("index"))
    a, b = far.filter("index").alias("a"), far.alias("b")
    same = (F.col("a.mail_hash") == F.col("b.mail_hash")) & (F.col("a.line") == F.col("b.line"))
    near = F.lit(True) if t < 0 else F.abs(F.col("a.size") - F.col("b.size")) <= t
    lighter = F.struct("a.weight", "a.id") < F.struct("b.weight", "b.id")
    costs = F.col("a.cost") + F.col("b.cost") + TITLES + HUNK
    close = a.join(b, same & near & lighter & (costs > c)).select(F.col("a.mail_hash").alias("mail_hash"), F.col("a.id").alias("one"), F.col("b.id").alias("two"))
    cut = lines.filter((F.col("short") > 0) & (F.col("cost") + F.col("cheapest") + TITLES + HUNK <= c) & (F.col("bonus") > 0)).select("mail_hash", "line", "id", *kept)
    a, b = cut.alias("a"), cut.alias("b")
    most = F.col("a.weight") + F.col("b.weight") + TITLES + F.col("a.header") + F.least("a.bonus", "b.bonus")
    torn = a.join(b, same & near & lighter & (costs <= c) & (most > c)).select(F.col("a.mail_hash").alias("mail_hash"), F.col("a.id").alias("one"), F.col("b.id").alias("two"))
    pairs = close.unionByName(torn).distinct()
    body = classes.select("id", "first", "cost", "body_lines")
    both = pairs.join(body.select(F.col("id").alias("one"), F.struct("first", "cost", "body_lines").alias("a")), "one").join(body.select(F.col("id").alias("two"), F.struct("first", "cost", "body_lines").alias("b")), "two")
    turn = F.col("a.first") > F.col("b.first")
    asked = both.select("mail_hash", "one", "two", (F.col("a.cost") + F.col("b.cost") + TITLES + HUNK).alias("apart"), F.when(turn, F.col("b.body_lines")).otherwise(F.col("a.body_lines")).alias("x"), F.when(turn, F.col("a.body_lines")).otherwise(F.col("b.body_lines")).alias("y"))

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                like = within(batch["x"][i].as_py(), batch["y"][i].as_py(), c)
                if like != (batch["apart"][i].as_py() <= c):
                    out.append((i, like))
            at = pa.array([i for i, _ in out], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch[x].take(at) for x in ("mail_hash", "one", "two")], pa.array([x for _, x in out], pa.bool_())], ["mail_hash", "one", "two", "like"])

    return asked.mapInArrow(compare, PAIRS)


def judge(members: DataFrame, size_threshold: int, content_threshold: int) -> DataFrame:
    """(mail_hash, size, body_hash, evicted, gate_skip): one row a class of contested members (mail_hash, repr, size,
    body_hash, body_lines); without body_hash where contents aren't compared. A body has one size.
    """
    keys = class_keys(content_threshold)
    verdict = ", ".join(f"{k} {'bigint' if k == 'size' else 'string'}" for k in keys) + ", evicted boolean, gate_skip string"

    def run(classes: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        classes = classes.sort_values("first", ignore_index=True)
        size, count = classes["size"].to_numpy(np.int64), classes["count"].to_numpy(np.int64)
        place = pd.Index(classes["id"])
        one, two = (place.get_indexer(pairs[x]) for x in ("one", "two"))
        out = outcasts(size, classes["cost"].to_numpy(np.int64), count, one, two, pairs["like"].to_numpy(bool), size_threshold, content_threshold)
        return classes[keys].assign(evicted=out, gate_skip=reason(size, count, out, size_threshold))

    facts = [F.count("*").alias("count"), F.min("repr").alias("first")]
    if content_threshold < 0:
        none = pd.DataFrame({"one": [], "two": [], "like": []})
        sizes = members.groupBy(*keys).agg(*facts).withColumns({"cost": F.lit(0), "id": F.col("size")})
        return sizes.groupBy("mail_hash").applyInPandas(lambda pdf: run(pdf, none), verdict)
    classes = measured(members.groupBy(*keys).agg(*facts, F.first("body_lines").alias("body_lines")))
    classes = settle(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    pairs = exceptions(classes, size_threshold, content_threshold)
    left = classes.select(*keys, "count", "first", "cost", "id").groupBy("mail_hash")
    return left.cogroup(pairs.groupBy("mail_hash")).applyInPandas(run, verdict)


def class_keys(content_threshold: int) -> list[str]:
    """The columns that make a class."""
    return ["mail_hash", "size"] + (["body_hash"] if content_threshold >= 0 else [])
